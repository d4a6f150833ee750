"""Importance resampling toward a target set, on hashed runs of one to three words.

A feature's bucket is the crc32 of its bytes, so bucket totals must be exact for any vocabulary. The frequent head is
prepared once and broadcast: for each frequent word the crc state after "word ", for each frequent pair its state and
bucket. What is not in the head (the tail) takes its crc directly: a tail word from its bytes, a longer run by carrying
the state of its beginning over the bytes of its last word, which is a linear map that depends on the number of bytes
only. Both routes give the same 32 bits, so the head changes the time and never a result.

Three passes over the texts: count candidates for the head, bucket totals, weights. Python workers hold one slice of
text and 10,000 totals; the driver sees the head and the totals, both of fixed size. The order of the draw is a
range-partitioned sort with partition offsets.

Defined results. Null and empty texts have no feature and weight 0. Every row is a document, also under a repeated doc_id;
a row without doc_id has no random part, so its score and rank are null and it does not count as a document to draw from.
Very long texts are read in windows of two megabytes, and a word of any length keeps only its crc and length. Without
documents there are no rows; without target texts all gains come from the corpus alone. Other columns are not read.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import FOLDED, SLICE, Scratch, slices, small_batches, span_hash, texts, word_spans
from highwater.operators.ranges import number_rows

BUCKETS = 10_000
HEAD = 1 << 14  # frequent words, and as many frequent pairs
LONGEST = 64    # bytes of a word that may be in the head; also the byte counts with a table of their own
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAIR = np.uint64(0xD6E8FEB86659FD93)


def _byte_steps() -> np.ndarray:
    """For the four bytes of a crc: what one further zero byte makes of it."""
    at = np.arange(256, dtype=np.uint32)
    t = at.copy()
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return np.stack([t, at, at << np.uint32(8), at << np.uint32(16)])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


class Carry:
    """crc(ab) = carry of crc(a) over len(b) bytes, xor crc(b). One table per small length, one per power of two beyond."""

    def __init__(self):
        one, at = _byte_steps(), np.arange(256, dtype=np.uint32)
        by_length = [np.stack([at << np.uint32(8 * i) for i in range(4)])]
        for _ in range(LONGEST):
            by_length.append(_apply(one, by_length[-1]))
        self.tables = np.stack(by_length)
        self.powers = [one]
        for _ in range(40):
            self.powers.append(_apply(self.powers[-1], self.powers[-1]))
        self.blank = np.uint32(zlib.crc32(b" "))

    def over(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.minimum(length, LONGEST)
        out = (self.tables[short, 0, crc & 255] ^ self.tables[short, 1, crc >> 8 & 255]
               ^ self.tables[short, 2, crc >> 16 & 255] ^ self.tables[short, 3, crc >> 24])
        for i in np.flatnonzero(length > LONGEST):
            c, n = crc[i:i + 1], int(length[i])
            for bit in range(n.bit_length()):
                if n >> bit & 1:
                    c = _apply(self.powers[bit], c)
            out[i] = c[0]
        return out

    def then_blank(self, crc: np.ndarray) -> np.ndarray:
        return _apply(self.powers[0], crc) ^ self.blank


class Words:
    """Words of a run of texts in order: hash, crc (tail words: None yet), length, and where each text's words start."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end = word_spans(data, off, GAP)
        self.hash = span_hash(data, self.start, self.end, FOLDED) if len(self.start) else np.zeros(0, np.uint64)
        self.length = self.end - self.start
        self.at = np.searchsorted(self.start, off)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def _windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of one long text, after a byte that ends a word. A word longer than a window is a window of its own."""
    a = 0
    while a < len(data):
        b = min(a + SLICE, len(data))
        if b < len(data):
            gaps = np.flatnonzero(GAP[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < len(data) and not (seen := GAP[data[b:b + SLICE]]).any():
                    b = min(b + SLICE, len(data))
                if b < len(data):
                    b += int(seen.argmax())
        yield a, b
        a = b


def frequent_runs(df: DataFrame, head: int = HEAD) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and pairs: each task counts all its words and keeps the commonest, the sums are ranked."""

    def best(seen: dict, n: int) -> dict:
        return dict(sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[bytes, int]] = [{}, {}]
        for batch in batches:
            for _, off, data in slices(batch.column(0)):
                for a, b in _windows(data) if len(data) > SLICE else [(0, len(data))]:
                    if b - a > SLICE and not GAP[data[a]]:
                        continue  # one word, longer than any in the head
                    cut = np.unique(np.r_[0, np.clip(off - a, 0, b - a), b - a])
                    w = Words(data[a:b], cut)
                    near = np.ones(max(len(w.hash) - 1, 0), bool)
                    inner = w.at[(w.at > 0) & (w.at < len(w.hash))]
                    near[inner - 1] = False
                    fits = w.length <= LONGEST
                    with np.errstate(over="ignore"):
                        keys = [w.hash[fits], (w.hash[:-1] * PAIR + w.hash[1:])[near & fits[:-1] & fits[1:]]]
                    rows = [np.flatnonzero(fits), np.flatnonzero(near & fits[:-1] & fits[1:])]
                    for k in (0, 1):
                        _, first, n = np.unique(keys[k], return_index=True, return_counts=True)
                        top = np.argsort(-n, kind="stable")[:2000]
                        for i, c in zip(rows[k][first[top]].tolist(), n[top].tolist()):
                            name = w.bytes_of(i) if k == 0 else w.bytes_of(i) + b" " + w.bytes_of(i + 1)
                            seen[k][name] = seen[k].get(name, 0) + c
                        if len(seen[k]) > 16 * head:
                            seen[k] = best(seen[k], 4 * head)
        for k in (0, 1):
            kept = best(seen[k], head)
            yield pa.record_batch([pa.array([k] * len(kept), pa.int32()), pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())],
                                  ["kind", "run", "n"])

    counted = Scratch(df.sparkSession).table(
        df.select("text").mapInArrow(run, "kind int, run binary, n long").groupBy("kind", "run").agg(F.sum("n").alias("n")), "runs")
    found = [counted.where(F.col("kind") == k).orderBy(F.desc("n"), "run").limit(head).select("run").collect() for k in (0, 1)]
    return [bytes(r["run"]) for r in found[0]], [bytes(r["run"]) for r in found[1]]


class Head:
    """What is broadcast: crc states of frequent words by hash, states and buckets of frequent pairs by their two words."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        words = list(dict.fromkeys(words + [w for p in pairs for w in p.split(b" ")]))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        h = span_hash(data, np.r_[np.int64(0), ends[:-1]], ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        place = dict(zip((words[i] for i in order), range(len(words))))
        self.hash = h[order]
        self.crc = np.array([zlib.crc32(words[i]) for i in order], np.uint32)
        self.length = np.array([len(words[i]) for i in order], np.int64)
        named = [tuple(place[w] for w in p.split(b" ")) for p in pairs]
        key = np.array([a * len(words) + b for a, b in named], np.int64)
        order = np.argsort(key)
        self.pair = key[order]
        self.pair_crc = np.array([zlib.crc32(pairs[i]) for i in order], np.uint32)
        self.pair_bucket = (self.pair_crc % BUCKETS).astype(np.int64)

    def states(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(crc of each word, its place in the head or -1)."""
        n = len(w.hash)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hash, w.hash), max(len(self.hash) - 1, 0))
        known = (self.hash[place] == w.hash) & (self.length[place] == w.length) if len(self.hash) else np.zeros(n, bool)
        crc = np.zeros(n, np.uint32)
        crc[known] = self.crc[place[known]]
        tail = np.flatnonzero(~known)
        if len(tail):
            _, first, back = np.unique(w.hash[tail], return_index=True, return_inverse=True)
            crc[tail] = np.array([zlib.crc32(w.data[w.start[i]:w.end[i]]) for i in tail[first].tolist()], np.uint32)[back]
        return crc, np.where(known, place, -1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs that are in the head, else -1."""
        if not len(self.pair):
            return np.full(len(a), -1)
        key = np.where((a >= 0) & (b >= 0), a * len(self.hash) + b, -1)
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[place] == key, place, -1)


def _buckets(head: Head, carry: Carry, crc: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of one, two and three neighbours, by the run's first word. Texts are not looked at here."""
    one = (crc % BUCKETS).astype(np.int64)
    if len(crc) < 2:
        return one, one[:0], one[:0]
    known = head.pairs(place[:-1], place[1:])
    two = np.zeros(len(crc) - 1, np.uint32)
    seen = known >= 0
    two[seen] = head.pair_crc[known[seen]]
    rest = np.flatnonzero(~seen)
    two[rest] = carry.over(carry.then_blank(crc[rest]), length[rest + 1]) ^ crc[rest + 1]
    bucket = (two % BUCKETS).astype(np.int64)
    bucket[seen] = head.pair_bucket[known[seen]]
    three = carry.over(carry.then_blank(two[:-1]), length[2:]) ^ crc[2:]
    return one, bucket, (three % BUCKETS).astype(np.int64)


def _doc_runs(head: Head, carry: Carry, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each feature from there, its bucket, words of each row). A long text comes in windows."""
    for first, off, data in slices(col):
        n_rows = len(off) - 1
        past = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a, b in _windows(data) if n_rows == 1 and len(data) > SLICE else [(0, len(data))]:
            # a word that fills a window needs no hash, which would take eight bytes per byte of it
            if b - a > SLICE and not GAP[data[a]]:
                crc = 0
                for i in range(a, b, SLICE):
                    crc = zlib.crc32(LOWER[data[i:min(i + SLICE, b)]], crc)
                fresh, row = (np.array([crc], np.uint32), np.array([-1]), np.array([b - a])), np.zeros(1, np.int64)
            else:
                w = Words(data[a:b], off if n_rows > 1 else np.array([0, b - a]))
                fresh, row = (*head.states(w), w.length), np.repeat(np.arange(n_rows), np.diff(w.at))
            k = len(past[0])
            crc, place, length = (np.r_[p, f] for p, f in zip(past, fresh))
            row = np.r_[np.zeros(k, np.int64), row]
            one, two, three = _buckets(head, carry, crc, place, length)
            same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
            same2[:max(k - 1, 0)] = False  # runs that end before this window were given out with the last one
            same3[:max(k - 2, 0)] = False
            yield (first, np.r_[row[k:], row[:-1][same2], row[:-2][same3]], np.r_[one[k:], two[same2], three[same3]],
                   np.bincount(row[k:], minlength=n_rows))
            past = tuple(x[-2:] for x in (crc, place, length)) if n_rows == 1 else past


def bucket_totals(df: DataFrame, head) -> np.ndarray:
    """Exact feature counts of all texts by bucket. ``head`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, total = Carry(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket, _ in _doc_runs(head.value, carry, batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in df.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each bucket."""
    big_s, big_t = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(t + 1) * big_s) / (float(s + 1) * big_t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def document_weights(docs: DataFrame, head, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = Carry()
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, row, bucket, words in _doc_runs(head.value, carry, batch.column(1)):
                at = slice(first, first + len(words))
                n_words[at] += words
                n_features[at] += np.bincount(row, minlength=len(words))
                weight[at] += np.bincount(row, weights=gain[bucket], minlength=len(words)).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, head: int = HEAD) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the documents drawn without replacement by weight and seeded Gumbel noise.

    The ``percent`` highest scores of the N documents with at least ``min_words`` words are drawn, ties to the smaller id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    target = texts(target)
    shared = spark.sparkContext.broadcast(Head(*frequent_runs(docs, head)))
    gain = gains(bucket_totals(docs, shared), bucket_totals(target, shared))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = Scratch(spark).table(document_weights(docs, shared, gain).withColumn("score", F.col("weight") + noise), "scored")
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    n_drawn = scored.where(may).count() * percent // 100
    ranked = number_rows(scored.withColumn("_may", may), [F.desc("_may"), F.desc("score"), F.asc("doc_id")], "_n")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_may") & (F.col("_n") <= n_drawn), F.col("_n")).alias("rank"), "n_words")
