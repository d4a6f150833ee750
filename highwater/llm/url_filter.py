"""URL lists as Bloom filter cascades: exact answers over the corpus's own keys, without a join.

Level 0 holds the listed keys. Level 1 holds the unlisted keys of the corpus that level 0 takes for listed, level 2 the
listed ones that level 1 takes for unlisted, and so on until no key is mistaken. As every key that can be asked occurs in
the universe the cascade was built over, the first level that lacks a key tells by its parity whether it is listed.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from highwater.llm.common import Scratch, mix, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_BITS = 1 << 28  # bits of one part of a cascade, 32 MB; larger lists are parted by key hash and asked part by part
BITS_PER_KEY, HASHES = 10, 4
U = np.uint64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host after the first ``://`` in ASCII lower case, path up to ``?`` or ``#``; null or no ``://``: empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, lengths: Iterable[int]) -> Column:
    """Every ``host/path`` that may be listed: the host and its parent domains, with the path's first n characters."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p)))))


@dataclass
class Bloom:
    bits: np.ndarray
    seed: int

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [(mix(h, self.seed * HASHES + i) % U(8 * len(self.bits))).astype(np.int64) for i in range(HASHES)]

    def holds(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at in self.places(h):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def listed(self, h: np.ndarray) -> np.ndarray:
        """Of 64-bit key hashes, which are listed."""
        out, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for n, level in enumerate(self.levels):
            held = level.holds(h[open_])
            out[open_[~held]] = n % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, s: Scratch, name: str, max_levels: int = 60) -> Cascade:
    """listed, universe: (h long), distinct. Levels shrink by the filter's error rate, so there are few."""
    yes = s.table(listed.select("h"), f"{name}_0")
    no = universe.join(listed, "h", "left_anti").select("h")
    cascade = Cascade()
    for n in range(max_levels):
        count = yes.count()
        if not count:
            return cascade
        cascade.levels.append(_bloom(yes, count, n))
        wrong = s.table(_held(no, cascade.levels[-1]), f"{name}_{n + 1}")
        yes, no = wrong, yes
    raise RuntimeError("the cascade did not end")


def _bloom(keys: DataFrame, count: int, seed: int) -> Bloom:
    size = max(64, count * BITS_PER_KEY // 8)

    def add(batches):
        bloom = Bloom(np.zeros(size, np.uint8), seed)
        for b in batches:
            for at in bloom.places(b["h"].to_numpy().view(U)):
                np.bitwise_or.at(bloom.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bloom.bits.tobytes(), 1)], pa.binary())], ["bits"])

    bits = np.zeros(size, np.uint8)
    for r in keys.coalesce(8).mapInArrow(add, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return Bloom(bits, seed)


def _held(keys: DataFrame, bloom: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.holds(b["h"].to_numpy().view(U))))
    return keys.mapInArrow(run, "h long")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: list[str], part_bits: int = PART_BITS, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    rules: (allow or block, ``host/path``). A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest that fits decides. Without one, ``blocked`` (same form) decides: block if an entry fits, else allow.
    Null URLs and those without ``://`` have empty host and path, fit nothing and are allowed. Repeated rows are judged
    again, rows without page_id stay, extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    s = scratch or Scratch(spark)
    lists = {"allow": [r for v, r in rules if v == "allow"], "block": [r for v, r in rules if v == "block"], "default": list(blocked)}
    lengths = {len(r) - r.index("/") for keys in lists.values() for r in keys}
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = s.table(rows.select(F.explode("keys").alias("key")).distinct().select(F.xxhash64("key").alias("h")).distinct(), "universe")
    rows = rows.withColumns({name: F.array().cast("array<string>") for name in lists})
    for name, keys in lists.items():
        if not keys:
            continue
        listed = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string").select(F.xxhash64("key").alias("h")).distinct()
        parts = -(-len(set(keys)) * BITS_PER_KEY // part_bits)
        for i in range(parts):
            own = F.pmod(F.xxhash64("h"), F.lit(parts)) == i
            cascade = spark.sparkContext.broadcast(build_cascade(listed.where(own), universe.where(own), s, f"{name}_{i}"))
            rows = _asked(rows, name, cascade, parts, i)
            if parts > 1:
                rows = s.table(rows, f"{name}_{i}_rows")
    longest = lambda c: F.element_at(F.reverse(F.array_sort(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))), 1)["k"]
    rows = rows.withColumns({"a": F.when(F.size("allow") > 0, longest(F.col("allow"))), "b": F.when(F.size("block") > 0, longest(F.col("block")))})
    allow_wins = F.coalesce(F.length("a"), F.lit(-1)) > F.coalesce(F.length("b"), F.lit(-1))
    rule = F.when(allow_wins, F.col("a")).otherwise(F.col("b"))
    verdict = (F.when(rule.isNull(), F.when(F.size("default") > 0, "block").otherwise("allow"))
               .when(allow_wins, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _asked(rows: DataFrame, name: str, cascade, parts: int, part: int) -> DataFrame:
    """Adds to column ``name`` the keys of each row that the cascade lists."""
    hashes = F.transform("keys", lambda k: F.xxhash64(k))
    mine = F.transform("keys", lambda k: F.pmod(F.xxhash64(F.xxhash64(k)), F.lit(parts)) == part)
    flat, columns = rows.withColumns({"hashes": hashes, "mine": mine}), rows.columns

    def run(batches):
        for b in batches:
            h, mine, keys = b["hashes"], b["mine"].flatten().to_numpy(zero_copy_only=False).astype(bool), b["keys"]
            listed = cascade.value.listed(h.flatten().to_numpy().view(U)) & mine
            ends = np.r_[0, np.cumsum(h.value_lengths().to_numpy())]
            names = keys.flatten()
            before = b[name].to_pylist()
            for at in np.flatnonzero(listed):
                before[int(np.searchsorted(ends, at, "right")) - 1].append(names[int(at)].as_py())
            i = b.schema.get_field_index(name)
            yield b.set_column(i, b.schema.field(i).name, pa.array(before, pa.list_(pa.string()))).select(columns)
    return flat.mapInArrow(run, rows.schema)
