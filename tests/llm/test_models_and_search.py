"""Classifiers by held-out accuracy, neighbour search by recall against brute force, and the pipeline stage by stage."""
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from highwater.llm.ann import nearest
from highwater.llm.quality import quality_scores
from highwater.llm.toxicity import toxicity_scores

BIG = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, label int, score double"


@pytest.mark.parametrize("score,column,folds,fold,least", [(quality_scores, "quality", 4, 2, 0.95), (toxicity_scores, "toxic", 3, 1, 0.97)])
def test_held_out_accuracy(spark, score, column, folds, fold, least):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[column]).mean() >= least
    assert got["score"].between(0, 1).all()
    ids = got["doc_id"].head(20)
    assert all(zlib.crc32(str(i).encode()) % folds == fold for i in ids)


@pytest.mark.parametrize("score,column", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_odd_documents(spark, score, column):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("the on er you at idiot".split() if i % 2 else "the on er at".split()) for _ in range(30)) + (" idiot" if i % 2 else ""), 0, 0.0) for i in range(200)]
    rows += [(None, "no id", 0, 0.0), (900, None, 0, 0.0), (901, "", 0, 0.0), (902, "x" * 200_000, 0, 0.0), (3, rows[3][1], 0, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(200)] + [(0, 1, "t"), (None, 1, "t"), (5000, 1, "t"), (4, None, "t")], f"doc_id long, {column} int, text string")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert np.mean([x.predicted == x.doc_id % 2 for x in got if x.doc_id is not None and x.doc_id < 200]) > 0.95
    assert [x.held_out for x in got if x.doc_id is None] == [False]
    one = score(docs, labels.limit(0)).collect()
    assert {x.score for x in one} == {0.5}
    assert score(docs.limit(0), labels).count() == 0


def plain_nearest(rows, k, every):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in ok:
        if q % every == 0:
            best = sorted(((-float(ok[q] @ ok[i]), i) for i in ok if i != q))[:k]
            out[q] = [i for _, i in best]
    return out


@pytest.mark.parametrize("n,block", [(300, 4096), (15, 4096), (300, 5)])
def test_neighbours(spark, n, block):
    r = np.random.default_rng(n)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [None] + [1.0] * 7), (2080, [float("nan")] * 8), (2100, [math.inf] * 8),
                                                      (2120, [1.0]), (None, same), (1000, same)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got, want = {}, plain_nearest(rows, 20, 20)
    for x in sorted(nearest(df, query_block=block).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.vec_id)
        a, b = (np.array(dict((i, v) for i, v in rows if i is not None)[j]) for j in (x.query_id, x.vec_id))
        assert abs(x.score - float(a @ b)) < 1e-12
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    if n == 300:
        assert got[1000] == [3, *range(1001, 1020)]  # ties by id
    assert nearest(df.limit(0)).count() == 0


def test_tables_find_what_lies_within_the_radius():
    """The tables give the rows within the radius, at a small price also where most values are within reach."""
    import time
    from highwater.llm.ann import Tables
    rng = np.random.default_rng(6)
    for width, n in ((12, 8192), (3, 700)):
        codes = rng.integers(0, 1 << 16, (n, width)).astype(np.uint16)
        codes[n // 2:] = codes[rng.integers(0, n // 2, n - n // 2)] ^ (1 << rng.integers(0, 16, (n - n // 2, width))).astype(np.uint16)
        tables = Tables(codes)
        for radius in (0, 7 * width, 16 * width):
            for q in codes[:20]:
                far = np.array([[bin(v).count("1") for v in row] for row in (codes[:300] ^ q).tolist()]).sum(1)
                found = tables.within(q, radius)
                assert np.all(np.diff(found) > 0) and np.array_equal(found[found < 300], np.flatnonzero(far <= radius))
        if width == 12:
            spent = []
            for q in codes[:100]:
                start = time.thread_time()
                tables.within(q, 84)
                spent.append(time.thread_time() - start)
            assert np.median(spent) < 0.003, np.median(spent)


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{BIG}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    got = nearest(df).toPandas().groupby("query_id")["vec_id"].agg(set)
    share = []
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        share.append(len(found & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert len(share) == (ids % 20 == 0).sum() and np.mean(share) >= 0.9


@pytest.mark.parametrize("name", ["op4_decontaminate", "op5_url_filter"])
def test_queries_with_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, sf).toPandas()[want.columns.tolist()]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns and 0 < out.count() <= kept
        docs, kept = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert entry.queries()["pipeline"](spark, sf).count() == len(packed)
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
