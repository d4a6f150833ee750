"""Importance resampling against a plain loop over features."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from highwater.llm import resample as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain(docs, target):
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, may = [], []
    for i, text in docs:
        n, fs = features(text)
        weight, score = sum(gain[bucket(f)] for f in fs), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                may.append((-score, i))
        out.append([i, len(fs), weight, score, None])
    rank = {k: r + 1 for r, k in enumerate(sorted(may)[:5 * len(may) // 100])}
    for row in out:
        row[4] = rank.get((-row[3], row[0])) if row[3] is not None else None
    return sorted(map(tuple, out), key=str)


def corpus():
    rng = np.random.default_rng(3)
    words = ["Fluß", "river", "ÉTÉ", "été", "Road", "a1", "x" * 70, "z" * 200, "of", "the", "日本", "naïve"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "-", "\n", "\x00", "_"]) for _ in range(int(rng.integers(1, 60))))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "one two"), (7, "a repeated id with other words"), (None, "no id " * 30), (905, "same text " * 15), (906, "same text " * 15)]
    return docs, ["the river of the Road", None, "", "été 日本 " * 8]


def frame(spark, docs, target):
    return (spark.createDataFrame([Row(doc_id=i, text=t, score=0.5, n=i) for i, t in docs], "doc_id long, text string, score double, n long"),
            spark.createDataFrame([(t,) for t in target], "text string"))


@pytest.mark.parametrize("head", [16384, 3])
def test_rows_equal_a_plain_loop(spark, head):
    docs, target = corpus()
    got = m.resample(*frame(spark, docs, target), head=head).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, target)


def test_empty_tables(spark):
    docs, target = frame(spark, [(1, "some words here")], [])
    assert m.resample(docs.limit(0), target).count() == 0
    assert [tuple(r)[:4] for r in m.resample(docs, target).collect()] == [r[:4] for r in plain([(1, "some words here")], [])]


@pytest.mark.parametrize("unit", ["ab cd efg ", "word" * 40, "ÄÖ ü " + "q" * 70 + " "])
def test_long_texts_in_windows(monkeypatch, unit):
    text = unit * 50 + " end"
    monkeypatch.setattr(m, "SLICE", 128)
    head, carry = m.Head([b"ab", b"cd", b"end"], [b"ab cd", b"efg ab"]), m.Carry()
    got = Counter()
    for _, row, buckets, words in m._doc_runs(head, carry, pa.array([text])):
        assert not row.any()
        got.update(buckets.tolist())
    assert got == Counter(bucket(f) for f in features(text)[1])
