"""Personal data by weak supervision, in DataFrame functions only.

Four kinds have a base rule each (pattern and filter). Wider patterns add candidates: card numbers with a wrong check digit, local
phone numbers, written-out e-mail addresses. Three labelers vote on every candidate: the base rule (regex), a gazetteer (top-level
domains, issuer and country prefixes, reserved networks) and the context (cue words before, free edges). Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is per kind; its posteriors train a
logistic span classifier on votes and span shape. Base spans always stay; a wider candidate is added if the classifier
says so and it overlaps no base span.

Only counts of (kind, votes, shape) reach the driver: at most kinds x 2^7 rows, whatever the table's size. Positions come
from ``split`` and ``regexp_extract_all`` with one pattern: gaps and matches alternate, so starts are running lengths.
"""
from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from highwater.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats and edges so that no input makes them slow. A look-behind or \G
# (the end of the last match) starts each run of characters once, which is where the leftmost match starts.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # shorter runs fail the filter anyway
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
WRITTEN_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[a-z0-9-]{1,63}+(?: ?[(\[]dot[)\]] ?[a-z0-9-]{2,63}+|\.[a-z0-9-]{2,63}+){1,4}"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Gazetteers and cue words
TOP_LEVEL = r"(?i)[.\])](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|test|example)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
COUNTRIES = r"^(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
RESERVED = r"^(?:0|127|255)\."
CUES = {"email": r"(?i)(?:mail|contact|write|address|courriel|correo)[^\n]{0,24}$", "ip": r"(?i)(?:\bip\b|host|server|login|address|from)[^\n]{0,24}$",
        "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)[^\n]{0,24}$", "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact)[^\n]{0,24}$"}
FREE_EDGE = r"(?:^|[\s,;:.!?()<>\[\]\"'|])$"
FEATURES = ("regex", "gazetteer", "context", "free", "long", "separated", "paired")


def running_starts(gaps: Column, hits: Column) -> Column:
    """Code-point starts of the matches: running sums in blocks of about sqrt(n), so many matches stay affordable."""
    lens = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), (F.length(g) + F.length(h)).alias("s")))
    n = F.size(hits)
    b = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda k: F.slice(lens, k * b + 1, b))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v["s"]))
    return F.flatten(F.transform(blocks, lambda x, k: F.transform(x, lambda v, i: v["g"] + F.aggregate(F.slice(x, F.lit(1), i), F.lit(0), lambda acc, y: acc + y["s"])
                                                                  + F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda acc, y: acc + y))))


def luhn(digits: Column) -> Column:
    """Doubled every second digit from the right, the sum divides by ten."""
    def one(i):
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0


def _judge(kind: str, base: bool, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    """The labelers' votes and the span's shape, all 0 or 1."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    rule = {"email": F.lit(True), "ip": hit.rlike(OCTETS), "card": n.between(13, 19) & luhn(digits), "phone": n.between(9, 15)}[kind] if base else F.lit(False)
    known = {"email": hit.rlike(TOP_LEVEL), "ip": ~hit.rlike(RESERVED), "card": digits.rlike(ISSUERS) & n.between(13, 19),
             "phone": digits.rlike(COUNTRIES) if base else digits.rlike("^[2-9][0-9]{2}[2-9]")}[kind]
    tail = F.substring(before, -40, 40)
    free = tail.rlike(FREE_EDGE) & F.reverse(F.substring(after, 1, 1)).rlike(FREE_EDGE)
    votes = {"regex": rule, "gazetteer": known, "context": tail.rlike(CUES[kind]), "free": free, "long": F.length(hit) > 16,
             "separated": hit.rlike("[ ().-]"), "paired": known & free}
    return {k: v.cast("int") for k, v in votes.items()}


def _found(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    return F.when(guard, F.split(text, pattern, -1)).otherwise(none), F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, base, votes and shape) per row; null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digit = t.rlike("[0-9]")
    plan = [("email", True, EMAIL, F.contains(t, F.lit("@"))), ("ip", True, IP, digit), ("card", True, CARD, digit), ("phone", True, PHONE, F.contains(t, F.lit("+"))),
            ("phone", False, LOCAL_PHONE, digit), ("email", False, WRITTEN_EMAIL, t.rlike(r"(?i)[(\[]at[)\]]"))]
    none = F.array().cast("array<string>")
    keep = docs.columns
    names = [f"__pii{i}" for i in range(len(plan))]
    df = docs.withColumns({f"{n}g": F.when(g, F.split(t, p, -1)).otherwise(none) for n, (_, _, p, g) in zip(names, plan, strict=True)})
    df = df.withColumns({f"{n}h": F.when(F.size(f"{n}g") > 1, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, (_, _, p, _) in zip(names, plan, strict=True)})
    df = df.withColumns({f"{n}s": F.when(F.size(f"{n}h") > 0, running_starts(F.col(f"{n}g"), F.col(f"{n}h"))) for n in names})

    def spans(n, kind, base):
        def one(start, i):
            hit, before, after = (F.element_at(f"{n}{c}", i + d) for c, d in (("h", 1), ("g", 1), ("g", 2)))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), F.lit(base).alias("base"),
                            *[v.alias(k) for k, v in _judge(kind, base, hit, before, after).items()])
        return F.transform(f"{n}s", one)

    df = df.withColumns({n: F.when(F.size(f"{n}h") > 0, spans(n, kind, base)) for n, (kind, base, _, _) in zip(names, plan, strict=True)})
    every = F.flatten(F.array_compact(F.array(*names)))
    df = df.select(*[F.col(f"`{c}`") for c in keep], every.alias("__all"))
    passed = F.filter("__all", lambda x: x["base"] & (x["regex"] == 1))
    wider = F.filter("__all", lambda x: ~x["base"] | (F.lit(KINDS.index("card")) == x["kind"]) & (x["regex"] == 0))
    df = df.withColumns({"__in": passed, "__out": wider})
    out = F.filter("__out", lambda x: ~F.exists("__in", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    out = F.transform(out, lambda x: x.withField("base", F.lit(False)))
    return df.withColumn("spans", F.array_sort(F.concat("__in", F.when(F.size("__out") > 0, out).otherwise(F.col("__out"))))).drop("__all", "__in", "__out")


def fit(candidates: DataFrame) -> dict[int, list[float]]:
    """Weights of the span classifier per kind (intercept first), from the votes on all candidate spans of the table."""
    counts = candidates.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{f}" for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for r in counts.collect():
        by[r["kind"]].append((tuple(r[f] for f in FEATURES), r["n"]))
    return {kind: train(rows, reliabilities(rows)) for kind, rows in sorted(by.items())}


def reliabilities(rows: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Expectation maximisation for three voters with two classes; returns the posterior of each vote pattern."""
    votes: dict[tuple[int, ...], int] = defaultdict(int)
    for f, n in rows:
        votes[f[:3]] += n
    prior, yes, no = 0.6, [0.9, 0.7, 0.4], [0.1, 0.4, 0.1]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in votes:
            a, b = prior, 1 - prior
            for j in range(3):
                a *= yes[j] if v[j] else 1 - yes[j]
                b *= no[j] if v[j] else 1 - no[j]
            post[v] = a / (a + b)
        total, sure = sum(votes.values()), sum(n * post[v] for v, n in votes.items())
        prior = min(0.98, max(0.02, (sure + 1) / (total + 2)))
        for j in range(3):
            yes[j] = (sum(n * post[v] for v, n in votes.items() if v[j]) + 9 * (0.9, 0.7, 0.4)[j]) / (sure + 9)
            no[j] = (sum(n * (1 - post[v]) for v, n in votes.items() if v[j]) + 9 * (0.1, 0.4, 0.1)[j]) / (total - sure + 9)
    return post


def train(rows: list[tuple[tuple[int, ...], int]], post: dict[tuple[int, ...], float], steps: int = 400) -> list[float]:
    """Logistic regression on votes and shape with the posteriors as soft labels, by gradient steps with decay."""
    w = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, n in rows)
    for step in range(steps):
        grad = [0.001 * x for x in w]
        for f, n in rows:
            x = (1, *f)
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for j, v in enumerate(x):
                grad[j] += v * n / total * (p - post[f[:3]])
        w = [a - 2.0 / (1 + step / 200) * g for a, g in zip(w, grad, strict=True)]
    return w


def chosen(weights: dict[int, list[float]]) -> Column:
    """``spans`` with the base spans and those that the classifier accepts, by kind and start."""
    def accept(s):
        score = F.lit(-1.0)
        for kind, w in weights.items():
            here = F.lit(float(w[0]))
            for f, x in zip(FEATURES, w[1:], strict=True):
                here = here + F.lit(float(x)) * s[f]
            score = F.when(s["kind"] == kind, here).otherwise(score)
        return s["base"] | (score >= 0)
    return F.filter("spans", accept)


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; the counts are of base spans.

    A null or empty text has no spans. Repeated rows are answered again, rows without doc_id stay, extra columns are
    ignored. An empty table gives an empty result.
    """
    s = scratch or Scratch(docs.sparkSession)
    found = s.table(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans"), "candidates")
    found = found.withColumn("spans", chosen(fit(found)))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; n_chars follows if it is there. Spans that
    overlap become one, named after the first. Null texts stay null."""
    s = scratch or Scratch(docs.sparkSession)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    found = s.table(with_candidates(row), "candidates")  # once, for the labelers and for the replacement
    df = found.withColumn("spans", chosen(fit(found.select("spans"))))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    name = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    cut = F.aggregate(order, first, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1))).alias("parts")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))))
    df = df.withColumn("cut", F.when(F.size("spans") > 0, cut))
    df = df.withColumn("new", F.when(F.size("spans") > 0, F.concat(F.array_join("cut.parts", ""), F.substring(F.col("text"), F.col("cut.at") + 1, F.length("text")))).otherwise(F.col("text")))
    length = F.when(F.size("spans") > 0, F.length("new").cast("long"))
    given = {"text": F.col("new"), "n_chars": F.coalesce(length, F.col("row").getField("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return df.select(*[given.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
