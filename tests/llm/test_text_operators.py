"""Personal data, token files, token counts, packing, decontamination and URL lists against plain Python."""
import bisect
import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict
from urllib.parse import quote

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from highwater.llm.decontaminate import contained_items, without_items
from highwater.llm.encoders import Encoder
from highwater.llm.packing import CARRY, FAN, _merge, best_fit, pack, packed
from highwater.llm.pii import find_personal_data, redact, reliabilities
from highwater.llm.token_counts import ChunkMap, TokenCounter, token_counts
from highwater.llm.token_files import EliasFano, read_token_files, write_token_files
from highwater.llm.url_filter import judge_urls
from test_ngram_join import plain_set

SCHEMA = "doc_id long, text string, start int, spans string, n_tokens int"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", "  a", " \n\n x ", "<s>foo</s>", "▁a b", "\x00\x01", "é́ é", "日本語 テスト", "\"'s ...!!", "a\u00a0b\u00a0 \n x", "\t\ttab\x1c x  \n y", "<|endoftext|>x <|endoftext|> y",
       "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ final", "it's IT'S we'll", "İstanbul ﬁ ² Ⅷ ½", "a" * 3000, "word " * 3000]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def noise(seed, n, letters=" \n\t'ab.é1²<|\x1c !A~Σσ"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def sample(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# ---- personal data

def plain_base(text):
    text = text or ""
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
             "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]}
    found["card"], found["phone"] = [], []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found["phone"].append(m.span())
    return found


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in found[k])


def test_base_spans(spark, sample):
    rows = sample + [(1000 + i, t) for i, t in enumerate(noise(2, 400, "a@.b- +1234567890()_é😀\n") + noise(4, 300, "0123456789 -.+") + ODD + [
        None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111111111111112", "x" * 50_000 + "@", "1 " * 20_000, "mail me (at) é a@b.co " * 900,
        "000255.1.1.1 256.1.1.1", "+1 (743) 555-3824 tel (743) 555-3824", "phone: 212-555-0123"])]
    got = {r.doc_id: r for r in find_personal_data(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, r = plain_base(t), got[i]
        text = joined(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in ("email", "ip", "card", "phone")), t[:80]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t[:80]
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text, t[:80]


def test_redacted_text(spark):
    rows = [(1, "write to a@b.co or +1 743 555 3824."), (2, None), (3, "nothing"), (None, "1.2.3.4")]
    out = redact(table(spark, rows))
    assert out.columns == ["doc_id", "text", "start", "spans", "n_tokens"] and {r.spans for r in out.collect()} == {"x"}
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "write to <email> or <phone>.", 2: None, 3: "nothing", None: "<ip>"}


def test_empty_personal_data(spark):
    assert find_personal_data(table(spark, [])).count() == 0 and redact(table(spark, [])).count() == 0


def test_reliabilities_follow_agreement():
    rows = [((1, 1, 1, 1, 1, 1, 1), 90), ((1, 1, 0, 1, 1, 1, 1), 60), ((0, 0, 0, 0, 1, 1, 0), 80), ((0, 1, 0, 1, 1, 1, 1), 5)]
    post = reliabilities(rows)
    assert post[1, 1, 1] > 0.9 > 0.5 > post[0, 0, 0]


# ---- token ids

@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path, sample):
    enc = Encoder(path, limit=2000)
    texts = [t for _, t in sample if t] + ODD + noise(3, 1500)
    for t, e in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t) == array("I", e.ids).tobytes(), t


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 70000, 2**40]])
def test_elias_fano(values):
    e, end = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert e.values().tolist() == values and [e.select(i) for i in range(len(values))] == values
    r = np.random.default_rng(len(values))
    big = np.sort(r.integers(0, 10**7, 3000))
    e = EliasFano.build(big)
    assert e.values().tolist() == big.tolist() and all(e.select(int(i)) == big[i] for i in r.integers(0, 3000, 200))
    assert 8 * len(e.to_bytes()) < 3000 * 16


def test_token_files(spark, sample, tmp_path):
    rows = sample + [(-5, "below"), (7, "again"), (None, "no id"), (None, None), (10**12, "")] + [(2000 + i, t) for i, t in enumerate(ODD)]
    write_token_files(table(spark, rows), str(tmp_path / "t"), BYTE, 2)
    got = read_token_files(spark, str(tmp_path / "t")).collect()
    tok = Tokenizer.from_file(BYTE)
    ids = {(i, t): array("I", [*tok.encode(t or "", add_special_tokens=False).ids, 2]).tobytes() for i, t in rows}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(ids[i, t]) // 4, zlib.crc32(ids[i, t])) for i, t in rows)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def test_empty_token_files(spark, tmp_path):
    write_token_files(table(spark, []), str(tmp_path / "t"), BYTE, 2)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


# ---- token counts

def test_token_counts(spark, sample):
    rows = sample + [(3000 + i, t) for i, t in enumerate(ODD + noise(6, 500))] + [(1, "again"), (None, "no id"), (5000, None)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    got = token_counts(table(spark, rows), PIECE, 100).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts(table(spark, []), PIECE).count() == 0


def test_chunk_maps_compose():
    c, sp = TokenCounter(PIECE, limit=500), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    r = random.Random(4)
    for t in ODD[1:-2] + noise(8, 300) + ["abcdefghij" * 5, "a b c d e f g"]:
        text, want = "▁" + t.replace(" ", "▁"), len(sp.encode(t))
        for _ in range(3):
            cuts = sorted(r.randint(0, len(text)) for _ in range(6))
            maps = [c.chunk_map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
            while len(maps) > 1:
                i = r.randrange(len(maps) - 1)
                maps[i:i + 2] = [c.compose(maps[i], maps[i + 1])]
            m: ChunkMap = maps[0]
            assert c.plain(m.head) + m.count + (c.plain(m.tail) if m.tail else 0) == want, t


# ---- packing

def test_best_fit():
    r = random.Random(2)
    lengths = [r.randint(1, 100) for _ in range(400)]
    where, at, fills = best_fit(lengths, 100)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):  # the same rule with a sorted list of rooms
        i = bisect.bisect_left(rooms, n)
        left = rooms.pop(i) - n if i < len(rooms) else 100 - n
        bisect.insort(rooms, left)
    assert len(fills) == len(rooms) and max(fills) <= 100
    assert sorted(100 - f for f in fills) == rooms


def test_no_open_bin_is_left_out():
    """More open bins than one lane takes: the others go up in lanes behind it."""
    n = 2 * CARRY + 100
    made = packed([(i, 0, 0, 1500, 0) for i in range(n)], 0, 2048)[0].to_pandas()
    assert (made["fill"] == 1500).all() and made["lane"].value_counts().to_dict() == {0: CARRY, 1: CARRY, 2: 100}
    up = _merge(2048, 2040)(pd.DataFrame({"bin": made["bin"], "fill": made["fill"], "part": 0, "lane": 1}))
    assert up["goes_up"].all() and up["lane"].value_counts().to_dict() == {FAN: CARRY, FAN + 1: CARRY, FAN + 2: 100}


def test_packing(spark, sample):
    rows = sample * 3 + [(None, "no id"), (9000, None), (9001, "")] + [(9100 + i, t) for i, t in enumerate(ODD)]
    got = pack(table(spark, rows).repartition(8), WORD, 0, 512).collect()
    tok = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512]
            want.append((i is not None, i or 0, k // 512, k, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(w[4] for w in want)
    assert len(bins) <= 1.03 * -(-total // 512) + 2
    assert pack(table(spark, []), WORD, 0).count() == 0


# ---- decontamination

@pytest.mark.parametrize("block", [1 << 21, 40])
def test_contained_items(spark, block):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "the on er at re en".split() for b in "st nd ing ly ha".split()]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 6, 15, 40, 70])))) for i in range(30)] + [(30, None), (31, ""), (3, "second text of this item id"), (None, "item without an id")]
    docs = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.choice([10, 300]))]
        for _ in range(2):
            w = (r.choice(items)[1] or "").split()
            if w and r.random() < 0.5:
                w[r.randrange(len(w))] = "X"
            at = r.randrange(len(t))
            t[at:at] = w
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (1, docs[1][1]), (None, items[3][1]), (62, items[0][1].upper())]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t, 0) for i, t in items + items[:2]], "item_id long, text string, doc_id int")
    want = []
    for d, t in docs:
        have = plain_set(t, 5)
        for i, x in items:
            s = plain_set(x, 5)
            if s and 100 * len(s & have) >= 80 * len(s):
                want.append((str(d), str(i), len(s), len(s & have)))
    got = [(str(r.doc_id), str(r.item_id), r.n_shingles, r.n_shared) for r in contained_items(df, it, block_shingles=block).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    clean = {str(r.doc_id) for r in without_items(df, it).collect()}
    assert clean == {str(d) for d, _ in docs} - {w[0] for w in want if w[0] != "None"}
    assert contained_items(df.limit(0), it).count() == 0 == contained_items(df, it.limit(0)).count()


# ---- URL lists

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def plain_url(url, blocked):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(r):
        h, p = r[:r.index("/")], r[r.index("/"):]
        return (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((r for r in RULES if fits(r[1])), key=lambda r: len(r[1]), default=None)
    return host, path, best and best[1], best[0] if best else "block" if any(map(fits, blocked)) else "allow"


@pytest.mark.parametrize("part_bits", [1 << 28, 8])
def test_urls(spark, part_bits):
    r = random.Random(3)
    hosts = ["a.org", "example.org", "x.example.org", "notexample.org", "B.Example.COM", "com", "spam.net", "a.spam.net", "org", "", "é.net", "a..org"]
    urls = ["".join((r.choice(["http", "://x"]), "://", r.choice(hosts), r.choice(["", "/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/" + quote("ü"), "/fr"]),
                     r.choice(["", "?q=/es/", "#/fr/"]))) for _ in range(600)] + [None, "", "no scheme", "mailto:x", "a://", "x://?y", "http://A.ORG"]
    blocked = ["spam.net/", "never.example/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.org/", "h"), (3, urls[3], "h")], "page_id long, url string, host string")
    got = judge_urls(df, RULES, blocked, part_bits).collect()
    assert len(got) == len(urls) + 2
    for row in got:
        if row.page_id is not None:
            assert (row.host, row.path, row.rule, row.verdict) == plain_url(urls[row.page_id], blocked), urls[row.page_id]
    assert judge_urls(df.limit(0), RULES, blocked).count() == 0
