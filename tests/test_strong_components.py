"""Strongly connected components against plain reach sets."""
import random

import pytest

from highwater.operators import graph as N


def plain(arcs):
    nodes, out = sorted({n for a in arcs for n in a}), {}
    for u, v in arcs:
        out.setdefault(u, set()).add(v)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen
    far = {n: reach(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes}


def got(spark, arcs):
    return {r["id"]: r["component"] for r in N.strong_components(spark.createDataFrame(arcs, "u int, v int")).collect()}


@pytest.mark.parametrize("n,m", [(40, 55), (60, 75)])
def test_random_graphs(spark, n, m):
    rnd = random.Random(n)
    arcs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    arcs += [(n + i, n + (i + 1) % 7) for i in range(7)] + [(n + 3, 0), (n + 20, n + 21), (n + 21, n + 20), (n + 30, n + 30)]  # a closed chain, a two-way pair, a loop
    assert got(spark, arcs) == plain(arcs)


def test_a_long_chain_of_dead_ends_takes_few_tables(spark, monkeypatch):
    """Ten thousand one-way nodes, a closed chain of five hundred, a ring with a tail on either side."""
    arcs = [(i, i + 1) for i in range(10_000)] + [(20_000 + i, 20_000 + (i + 1) % 500) for i in range(500)]
    arcs += [(30_001, 30_002), (30_002, 30_003), (30_003, 30_001), (30_001, 30_003), (5_000, 30_001), (30_002, 9_000)]
    made = []
    keep = N.stored
    monkeypatch.setattr(N, "stored", lambda df: made.append(1) or keep(df))
    found = got(spark, arcs)
    assert all(found[20_000 + i] == 20_000 for i in range(500)) and {found[30_001], found[30_002], found[30_003]} == {30_001}
    assert all(found[i] == i for i in range(0, 10_001, 7)) and len(made) <= 60, len(made)
    big = N.largest_scc(spark.createDataFrame(arcs, "u int, v int"))
    assert big.count() == 500


def test_all_rounds_together_store_a_few_times_the_arcs(spark, monkeypatch):
    """A two-way line of 3,000 nodes: a round works on what the last one left, not on all nodes again."""
    n, rows = 3000, []
    arcs = [a for i in range(n - 1) for a in ((i, i + 1), (i + 1, i))]
    for name in ("stored", "cut_lineage"):
        keep = getattr(N, name)
        monkeypatch.setattr(N, name, lambda df, k=keep: (lambda t: rows.append(t.count()) or t)(k(df)))
    assert set(got(spark, arcs + [(n, n)]).items()) == {(i, 0) for i in range(n)} | {(n, n)}
    assert sum(rows) <= 10 * n, rows


def test_a_hub_and_its_leaves_are_one(spark):
    arcs = [a for i in range(1, 500) for a in ((i, 250), (250, i))] + [(600, 601), (601, 602), (602, 600), (601, 600), (3, 600)]
    assert got(spark, arcs) == plain([a for a in arcs if a[0] != a[1]])
    assert {r["id"] for r in N.largest_scc(spark.createDataFrame(arcs, "u int, v int")).collect()} == set(range(1, 500))


def test_missing_ids_tie_nothing(spark):
    arcs = [(1, 2), (2, 1), (None, 2), (2, None), (3, None), (None, None), (7, 7), (9, 8), (8, 9), (9, 8)]
    assert got(spark, arcs) == {1: 1, 2: 1, 3: 3, 7: 7, 8: 8, 9: 8}
    assert {r["id"] for r in N.largest_scc(spark.createDataFrame(arcs, "u int, v int")).collect()} == {1, 2}


def test_the_query_reads_two_columns_once(spark, tmp_path, monkeypatch):
    """Names, numbers and coordinates of roads are not derived or kept for a query that asks for their ends."""
    from highwater.plans.catalog import QUERIES
    rnd = random.Random(5)
    rows = [(k, rnd.randrange(120), rnd.choice("FOP"), 1000.0 + k, "1-URGENT") for k in range(400)]
    spark.createDataFrame([(k,) for k in range(120)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").selectExpr(
        "*", "timestamp '2024-01-01 00:00:00' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    keep, read = N.largest_scc, []
    monkeypatch.setattr(N, "largest_scc", lambda e: read.append(e) or keep(e))
    found = {r["id"] for r in QUERIES["g3_largest_scc"](spark, str(tmp_path)).collect()}
    arcs = []
    for k, u, status, _, _ in rows:
        v = u + (1, 40, 41, 39)[k % 4]
        if v < 120:
            arcs += [(u, v)] + [(v, u)] * (status != "P")
    names = list(plain(arcs).items())
    sizes = {c: sum(d == c for _, d in names) for _, c in names}
    best = min(sizes, key=lambda c: (-sizes[c], c))
    assert found == {n for n, c in names if c == best}
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "InMemoryRelation" not in plan, plan
