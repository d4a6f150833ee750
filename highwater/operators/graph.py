"""Iterative jobs on edge tables: components, strongly connected parts, least-cost paths.

Each round is a few joins and partial aggregates. Rounds end in a reliable checkpoint, so the plan stays short and
a lost executor costs at most one round. What the driver sees is one number per round.
"""
from pyspark.sql import Column, DataFrame, functions as F

from highwater.session import cut_lineage, stored


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): connected groups named by their smallest id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node is tied to the smallest
    neighbour, so chains shrink fast and a hub's edges are only ever joined to its minimum, never to each other.
    """
    nodes = pairs.select(F.col(a).alias("id")).unionByName(pairs.select(F.col(b).alias("id"))).distinct()
    e = stored(pairs.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    last = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
            .alias("p")).select("p.*").where(F.col("u") != F.col("v")).distinct()
        e = stored(small)
        now = _signature(e)
        if now == last:
            break
        last = now
    return nodes.join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def ticket_groups(streets: DataFrame, links: DataFrame) -> DataFrame:
    """Streets that share a ticket belong to one split group. links: street_id, source, ticket_id.

    A ticket ties each of its streets to its smallest one: as many pairs as links, not pairs of pairs.
    """
    link = links.select("street_id", "source", "ticket_id").distinct()
    first = link.groupBy("source", "ticket_id").agg(F.min("street_id").alias("first"))
    ties = link.join(first, ["source", "ticket_id"]).where(F.col("street_id") != F.col("first"))
    groups = components(ties, "street_id", "first")
    return streets.join(groups.withColumnRenamed("id", "street_id"), "street_id", "left").withColumn(
        "split_group", F.coalesce("component", "street_id")).drop("component")


def cell_components(cells: DataFrame) -> DataFrame:
    """cells: cx, cy (only the wet ones) -> the same with ``component`` = smallest cell id of the connected area."""
    c = cells.select("cx", "cy").distinct().withColumn("id", cell_id(F.col("cx"), F.col("cy")))
    right = c.select((F.col("cx") - 1).alias("cx"), "cy", F.col("id").alias("o"))
    up = c.select("cx", (F.col("cy") - 1).alias("cy"), F.col("id").alias("o"))
    touching = c.join(right.unionByName(up), ["cx", "cy"]).select(F.col("id").alias("a"), F.col("o").alias("b"))
    comp = components(touching).withColumnRenamed("id", "cell_id")
    keyed = cells.withColumn("cell_id", cell_id(F.col("cx"), F.col("cy")))
    return keyed.join(comp, "cell_id", "left").withColumn("component", F.coalesce("component", "cell_id")).drop("cell_id")


def cell_id(cx: Column, cy: Column) -> Column:
    """One number per raster cell. Columns outside 0 to a billion would share numbers, so they raise an error."""
    cx = cx.cast("bigint")
    return F.when((cx >= 0) & (cx < 1_000_000_000), cy.cast("bigint") * F.lit(1_000_000_000) + cx).when(
        cx.isNotNull(), F.raise_error(F.lit("raster column outside 0..999999999")).cast("bigint"))


def reachable(edges: DataFrame, start: DataFrame, src: str = "u", dst: str = "v", rounds_per_job: int = 6) -> DataFrame:
    """Nodes that a breadth-first search from ``start`` (id) gets to, start included.

    Only nodes reached in the last round are extended. Each node also has an arc to itself, which carries it over to the
    next round, so a round reads the table of seen nodes once and plans grow by one join, not by doubling.
    """
    arcs = edges.select(F.col(src).alias("id"), F.col(dst).alias("next"))
    nodes = arcs.select("id").unionByName(arcs.select(F.col("next").alias("id"))).unionByName(start.select("id")).distinct()
    arcs = cut_lineage(arcs.withColumn("self", F.lit(False)).unionByName(nodes.select("id", F.col("id").alias("next"), F.lit(True).alias("self"))))
    seen = cut_lineage(start.select("id", F.lit(True).alias("fresh")).distinct())
    while True:
        for _ in range(rounds_per_job):
            step = seen.join(arcs, "id").where(F.col("self") | F.col("fresh"))
            seen = step.groupBy(F.col("next").alias("id")).agg(F.min(~F.col("self")).alias("fresh"))
        seen = cut_lineage(seen)
        if seen.where("fresh").isEmpty():
            return seen.select("id")


def largest_scc(edges: DataFrame) -> DataFrame:
    """Nodes (id) of the largest strongly connected component (ties: the one with the smallest id)."""
    scc = stored(_strong_groups(edges))
    best = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).orderBy(F.desc("n"), "low").limit(1)
    return scc.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of arcs u, v, named by their smallest id.

    The graph is made small first, by steps that take few rounds whatever their length: nodes with arcs both ways are one
    (undirected components), a node with one way in and one way out is bypassed, whole chains at once by pointer doubling, and
    nodes without a way in or out are dropped. What is left is coloured: the largest id spreads forward, and where it gets back
    to its owner inside its colour, a component is found; all colours are worked on at once. The removed nodes then get their
    answer in reverse order: a bypassed one belongs where both its ends belong together.
    """
    full = _strong_groups(edges)
    least = full.groupBy(F.col("component").alias("any")).agg(F.min("id").alias("low"))
    return full.join(least, F.col("component").eqNullSafe(F.col("any"))).select("id", F.col("low").alias("component"))


def _strong_groups(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of arcs u, v, each named by any one of its nodes."""
    pairs, steps = stored(_pairs(edges)), []
    nodes = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    size = _n_arcs(pairs)
    while size:
        # both ends of a two-way pair get the same name, so only one-way arcs have to be renamed
        two_way, arcs = pairs.where("fwd and bwd"), _arcs(pairs)
        if not two_way.isEmpty():
            groups = _merged(two_way.select("lo", "hi"))
            steps.append(("merge", groups.where("id != component").select("id", "component")))
            name = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))  # noqa: E731,B023
            arcs = stored(_plain(_arcs(pairs.where("fwd <> bwd")).join(name("u"), "u", "left").join(name("v"), "v", "left").select(
                F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))))
            if arcs.isEmpty():
                break
        arcs, found = _bypass(_with_both_ways(arcs))
        steps += found
        pairs = stored(_pairs(_with_both_ways(stored(arcs) if found else arcs)))
        now = _n_arcs(pairs)
        if now > 0.7 * size:
            scc = _coloured(stored(_arcs(pairs)))
            steps.append(("scc", scc))
            gone = scc.select(F.col("id").alias("lo"))
            pairs = stored(pairs.join(gone, "lo", "left_anti").join(gone.withColumnRenamed("lo", "hi"), "hi", "left_anti"))
            now = _n_arcs(pairs)
        size = now
    return _unwind(nodes, steps)


def _pairs(arcs: DataFrame) -> DataFrame:
    """One row per pair of nodes that arcs join: lo, hi, fwd and bwd (whether an arc goes up, down). Loops have neither."""
    up = F.col("u") <= F.col("v")
    return arcs.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("lo"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("hi"),
                       (F.col("u") < F.col("v")).alias("fwd"), (F.col("u") > F.col("v")).alias("bwd")).groupBy("lo", "hi").agg(
        F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd"))


def _arcs(pairs: DataFrame) -> DataFrame:
    """The arcs u, v that ``_pairs`` were made of, each once, without loops."""
    return pairs.where("fwd").select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        pairs.where("bwd").select(F.col("hi").alias("u"), F.col("lo").alias("v")))


def _n_arcs(pairs: DataFrame) -> int:
    return pairs.agg(F.coalesce(F.sum(F.col("fwd").cast("int") + F.col("bwd").cast("int")), F.lit(0)).alias("n")).first()["n"]


def _twice(step: DataFrame) -> DataFrame:
    """id, to: where two steps lead. Every ``to`` has a row of its own."""
    return step.join(step.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to"))


def _merged(pairs: DataFrame) -> DataFrame:
    """(id, component): connected groups of pairs lo, hi, each named by one of its nodes.

    Every round each node takes four steps, each to the one of its neighbourhood with the smallest hash; nodes that steps end
    at, and pairs of them, are what the next round works on. Hashes differ from round to round, so a good part of the nodes is
    expected to go whatever their links, and all rounds together cost little more than the first (after Boegeholz et al. 2018).
    """
    levels = []
    while True:
        rank = lambda c, k=len(levels): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = pairs.select(F.col("lo").alias("id"), rank("hi").alias("r")).unionByName(pairs.select(F.col("hi").alias("id"), rank("lo").alias("r")))
        first = stored(both.groupBy("id").agg(F.min("r").alias("r")).select("id", F.least("r", rank("id"))["to"].alias("to")))
        goal = stored(_twice(_twice(first)))
        levels.append(goal)
        end = lambda c, g=goal: g.select(F.col("id").alias(c), F.col("to").alias(f"_{c}"))
        pairs = stored(pairs.join(end("lo"), "lo").join(end("hi"), "hi").where("_lo <> _hi").select(
            F.least("_lo", "_hi").alias("lo"), F.greatest("_lo", "_hi").alias("hi")).distinct())
        if pairs.isEmpty():
            break
    known = levels.pop().select("id", F.col("to").alias("component"))
    for goal in reversed(levels):
        known = stored(goal.join(known.select(F.col("id").alias("to"), "component"), "to", "left").select("id", F.coalesce("component", "to").alias("component")))
    return known


def _plain(arcs: DataFrame) -> DataFrame:
    return arcs.where(F.col("u") != F.col("v")).distinct()


def _with_both_ways(arcs: DataFrame, rounds: int = 3) -> DataFrame:
    """Without arcs from nodes that have no way in and arcs to nodes that have no way out; repeated a few times.

    Every round is stored, as it names its arcs three times.
    """
    for _ in range(rounds):
        heads, tails = arcs.select(F.col("v").alias("u")).distinct(), arcs.select(F.col("u").alias("v")).distinct()
        arcs = stored(arcs.join(heads, "u", "left_semi").join(tails, "v", "left_semi"))
    return arcs


def _bypass(arcs: DataFrame) -> tuple[DataFrame, list]:
    """Chains of nodes with one arc in and one arc out become single arcs; closed chains are components of their own."""
    after = arcs.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("_o"), F.min("v").alias("next")).where("_o = 1")
    before = arcs.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("_i"), F.min("u").alias("prev")).where("_i = 1")
    state = stored(after.join(before, "id").select("id", "next", "prev", F.col("id").alias("low")))
    total, reach = state.count(), 1
    if not total:
        return arcs, []
    chain = state.select("id")
    inside = lambda c: chain.select(F.col("id").alias(c))
    while reach < total and not state.join(inside("next"), "next", "left_semi").isEmpty():
        for _ in range(2):
            n = state.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("low").alias("_ln"))
            p = state.select(F.col("id").alias("prev"), F.col("prev").alias("_p"), F.col("low").alias("_lp"))
            state = state.join(n, "next", "left").join(p, "prev", "left").select(
                "id", F.coalesce("_n", "next").alias("next"), F.coalesce("_p", "prev").alias("prev"), F.least("low", "_ln", "_lp").alias("low"))
            reach *= 2
        state = stored(state)
    closed = state.join(inside("next"), "next", "left_semi").select("id", F.col("low").alias("component"))
    passed = stored(state.join(inside("next"), "next", "left_anti").select("id", "next", "prev"))
    rest = arcs.join(inside("u"), "u", "left_anti").join(inside("v"), "v", "left_anti")
    return _plain(rest.unionByName(passed.select(F.col("prev").alias("u"), F.col("next").alias("v")))), [("scc", stored(closed)), ("bypass", passed)]


def _coloured(arcs: DataFrame, rounds_per_job: int = 6) -> DataFrame:
    """(id, component) of the nodes whose component holds the largest id that reaches them."""
    nodes = arcs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    step = cut_lineage(arcs.select(F.col("u").alias("id"), F.col("v").alias("to"), F.lit(False).alias("own")).unionByName(
        nodes.select("id", F.col("id").alias("to"), F.lit(True).alias("own"))))
    seen = stored(nodes.select("id", F.col("id").alias("colour"), F.lit(True).alias("fresh")))
    while not seen.where("fresh").isEmpty():
        for _ in range(rounds_per_job):
            met = seen.join(step, "id").where(F.col("own") | F.col("fresh"))
            seen = met.groupBy(F.col("to").alias("id")).agg(F.max(F.struct("colour", "own")).alias("b")).select("id", "b.colour", (~F.col("b.own")).alias("fresh"))
        seen = stored(seen)
    side = lambda c: seen.select(F.col("id").alias(c), F.col("colour").alias(f"_{c}"))
    same = arcs.join(side("u"), "u").join(side("v"), "v").where(F.col("_u") == F.col("_v")).select("u", "v")
    back = reachable(same, seen.where(F.col("id") == F.col("colour")).select("id"), "v", "u")
    return stored(seen.join(back, "id", "left_semi").select("id", F.col("colour").alias("component")))


def _unwind(nodes: DataFrame, steps: list) -> DataFrame:
    """Components of all nodes, from the last step back to the first. A node without a row is alone so far."""
    known = None
    for kind, table in reversed(steps):
        if kind == "scc":
            more = table.select("id", "component")
        elif kind == "merge":
            more = table if known is None else table.join(known.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component", "left").select(
                "id", F.coalesce("_c", "component").alias("component"))
        else:
            side = lambda c, k=known: (table.select(c).distinct() if k is None else table.select(c).distinct().join(  # noqa: E731,B023
                k.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left")).select(c, F.coalesce(f"_{c}", c).alias(f"_{c}") if k is not None else F.col(c).alias(f"_{c}"))
            more = table.join(side("next"), "next").join(side("prev"), "prev").where(F.col("_next") == F.col("_prev")).select("id", F.col("_next").alias("component"))
        known = stored(more if known is None else known.unionByName(more))
    if known is None:
        return nodes.select("id", F.col("id").alias("component"))
    # a component goes by any of its nodes; that node itself may have no row
    return nodes.where("id is not null").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def batch_paths(edges: DataFrame, pairs: DataFrame, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Least-cost paths for many (source, target) pairs under several costs at once, on a partitioned overlay.

    ``edges``: u, v, edge_id, kind, cost (one row per cost kind; closed edges left out). ``pairs``: source, target.
    ``parts`` (node, part) may name parts of the graph, see ``overlay``.
    Returns (paths: kind, source, target, seq, edge_id, cost) and (summary: kind, source, target, total, null when
    unreachable). Of equally cheap paths the one with fewest edges wins, then the one whose first edge has the smallest id,
    then the second, whatever other pairs are asked.
    """
    from highwater.operators.overlay import overlay_paths  # which itself needs components
    return overlay_paths(edges, pairs, parts)


def batch_routes(edges: DataFrame, pairs: DataFrame, facts: DataFrame, how: dict[str, str], of_edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``batch_paths`` whose summary also has what ``facts`` (edge_id, marked, numbers) come to along each path, without listing
    it; and (kind, source, target, columns of ``of_edge``) for the marked edges of each path. ``how``: sum, max or xor by column."""
    from highwater.operators.overlay import overlay_routes
    return overlay_routes(edges, pairs, facts, how, of_edge)
