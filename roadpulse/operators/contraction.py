"""Betweenness on a network whose chains are contracted.

Roads are mostly chains: nodes with two neighbours between junctions. Frontier
jobs over all nodes need as many rounds as the longest path has edges. Here

1. pointer doubling finds, for every directed edge, the junction its chain
   leads to, with length and number of edges: log2(longest chain) rounds. A
   closed ring without a junction gets its smallest node as one;
2. distances, path counts and flows run between junctions only, over chains as
   single arcs. A source inside a chain starts at the chain's two ends;
3. nodes inside a chain are reached from its two ends. Up to where both ways
   are equally long they hang on one end, beyond it on the other; a node just
   there splits its unit by the path counts. So a source and a chain give two
   numbers of nodes, added to the ends' units, and a credit per edge that is a
   linear function of the edge's place on each side of the meeting point, plus
   what flows through the whole chain. Such functions are added up as changes
   of constant and slope at places of the chain, and running sums over the
   chain's edges give every edge its credit.

The state is (source, junction) and (source, chain) instead of (source, node).
A source's own chain counts as two, one on either side of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.ranks import running_sums
from roadpulse.session import stored, stored_with_metrics

MERGE_ROUNDS = 8


def _junctions(arcs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    found = arcs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("deg")).where("deg <> 2").select("node")
    return stored(found if extra is None else found.union(extra).distinct())


def _reach(arcs: DataFrame, junctions: DataFrame, n_nodes: int) -> DataFrame:
    """Per directed arc (a, b): last arc (la, lb) of its chain, length and edges
    up to there; pa is null if a junction was reached, else low is the smallest
    node of the closed ring."""
    j = junctions.select(F.col("node").alias("b"), F.lit(True).alias("stop"))
    on = arcs.join(j, "b", "left")
    nxt = arcs.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    inner = on.where("stop is null").join(nxt, (F.col("b") == F.col("pa")) & (F.col("a") != F.col("pb")))
    start = lambda d, pa, pb: d.select("a", "b", pa.alias("pa"), pb.alias("pb"), F.col("a").alias("la"), F.col("b").alias("lb"),
                                       F.col("w").alias("len"), F.lit(1).cast("long").alias("hops"), F.col("b").alias("low"))
    none = F.lit(None).cast("long")
    state = stored(start(inner, F.col("pa"), F.col("pb")).unionByName(start(on.where("stop"), none, none)))
    for _ in range(n_nodes.bit_length() + 1):
        to = state.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("pa").alias("npa"), F.col("pb").alias("npb"),
                          F.col("la").alias("nla"), F.col("lb").alias("nlb"), F.col("len").alias("nlen"), F.col("hops").alias("nhops"),
                          F.col("low").alias("nlow"))
        jumped = state.where("pa is not null").join(to, (F.col("pa") == F.col("ta")) & (F.col("pb") == F.col("tb"))).select(
            "a", "b", F.col("npa").alias("pa"), F.col("npb").alias("pb"), F.col("nla").alias("la"), F.col("nlb").alias("lb"),
            (F.col("len") + F.col("nlen")).alias("len"), (F.col("hops") + F.col("nhops")).alias("hops"), F.least("low", "nlow").alias("low"))
        state, m = stored_with_metrics(state.where("pa is null").unionByName(jumped), open=F.count("pa"))
        if not m["open"]:
            break
    return state


def chains(arcs: DataFrame, n_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chain, end_a, end_b, length, hops), (node, chain, pre, i) of the nodes inside
    them, and (u, v, chain, j) of the edges, counted from end_a on."""
    junctions = _junctions(arcs)
    reach = _reach(arcs, junctions, n_nodes)
    rings = reach.where("pa is not null").select(F.col("low").alias("node")).distinct()
    if not rings.isEmpty():
        junctions = _junctions(arcs, rings)
        reach = _reach(arcs, junctions, n_nodes)
    # a chain is seen from both ends; the smaller of the two first arcs names it
    first = reach.join(junctions, F.col("a") == F.col("node"), "left_semi")
    named = first.where(F.struct(F.col("a"), F.col("b")) <= F.struct(F.col("lb"), F.col("la")))
    table = stored(named.select(F.monotonically_increasing_id().alias("chain"), F.col("a").alias("end_a"), F.col("b").alias("first"),
                                F.col("lb").alias("end_b"), F.col("len").alias("length"), "hops"))
    # an arc that leads to A has A's first arc, reversed, as its last one
    to_a = stored(reach.join(table.select("chain", "end_a", "first"), (F.col("lb") == F.col("end_a")) & (F.col("la") == F.col("first")))
                  .select("a", "b", "chain", "len", F.col("hops").alias("i")))
    inside = to_a.join(junctions, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), "chain", F.col("len").alias("pre"), "i")
    edges = to_a.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "chain", (F.col("i") - 1).alias("j"))
    return table.drop("first"), stored(inside), edges


def _distances(start: DataFrame, arcs: DataFrame) -> DataFrame:
    """(s, node, d) from the rows of ``start``, over ``arcs(a, b, w)``."""
    frontier = stored(start)
    written = [frontier]

    def best() -> DataFrame:
        whole = written[0]
        for part in written[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy("s", "node").agg(F.min("d").alias("d"))

    while True:
        cand = frontier.join(arcs, F.col("node") == F.col("a")).groupBy("s", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("cd"))
        better = cand.join(best(), ["s", "node"], "left").where(F.col("d").isNull() | (F.col("cd") < F.col("d")))
        frontier, m = stored_with_metrics(better.select("s", "node", F.col("cd").alias("d")), n=F.count(F.lit(1)))
        if not m["n"]:
            return stored(best())
        written.append(frontier)
        if len(written) > MERGE_ROUNDS:
            written = [stored(best())]


def _accumulated(first: DataFrame, step, keys: list[str], value: str) -> tuple[DataFrame, bool]:
    """Sum of ``value`` by ``keys`` over ``first`` and what ``step`` makes of it
    round after round, until nothing is left; merged every few rounds."""
    level, held = first, [first]
    while True:
        level, m = stored_with_metrics(step(level), n=F.count(F.lit(1)))
        if not m["n"]:
            break
        held.append(level)
        if len(held) > MERGE_ROUNDS:
            whole = held[0].select(*keys, value)
            for part in held[1:]:
                whole = whole.unionByName(part.select(*keys, value))
            held = [stored(whole.groupBy(*keys).agg(F.sum(value).alias(value)))]
    whole = held[0].select(*keys, value)
    for part in held[1:]:
        whole = whole.unionByName(part.select(*keys, value))
    return stored(whole.groupBy(*keys).agg(F.sum(value).alias(value)))


def _nodes_before(asked: DataFrame, inside: DataFrame) -> DataFrame:
    """(chain, t, ka, tie): nodes of the chain with 2 * pre < t, and whether one has 2 * pre = t."""
    at = inside.select("chain", (2 * F.col("pre")).alias("t"))
    both = asked.select("chain", "t", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ka")).unionByName(
        at.select("chain", "t", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("ka")))
    ranked = running_sums(both, "chain", ["t", "kind"], ["ka"]).where("kind = 0").drop("kind")
    return ranked.join(at.withColumn("tie", F.lit(1)), ["chain", "t"], "left").select("chain", "t", "ka", F.coalesce("tie", F.lit(0)).alias("tie"))


def _event(at: Column, constant: Column, slope=None) -> Column:
    return F.struct(at.cast("long").alias("at"), constant.cast("double").alias("dk"), (F.lit(0.0) if slope is None else F.lit(slope)).alias("dm"))


def credits(arcs: DataFrame, sources: DataFrame, n_nodes: int) -> DataFrame:
    """(u, v, credit): Brandes dependency of every edge, summed over ``sources(s)``."""
    table, inside, edges = chains(arcs, n_nodes)
    edges = stored(edges)
    own = sources.join(inside, F.col("s") == F.col("node")).select("s", "chain", "pre", "i")
    own = stored(own.join(table, "chain"))  # sources inside a chain
    ends = stored(table.select("end_a").union(table.select("end_b")).distinct().toDF("node"))
    at_junction = sources.join(ends, F.col("s") == F.col("node")).select("s", "node")
    zero = F.lit(0).cast("long")
    start = at_junction.select("s", "node", zero.alias("d")).unionByName(own.select("s", F.col("end_a").alias("node"), F.col("pre").alias("d"))).unionByName(
        own.select("s", F.col("end_b").alias("node"), (F.col("length") - F.col("pre")).alias("d")))
    both = table.where("end_a <> end_b")
    every = stored(both.select("chain", F.col("end_a").alias("a"), F.col("end_b").alias("b"), F.col("length").alias("w"), "hops").unionByName(
        both.select("chain", F.col("end_b").alias("a"), F.col("end_a").alias("b"), F.col("length").alias("w"), "hops")))
    dist = _distances(start.groupBy("s", "node").agg(F.min("d").alias("d")), every.groupBy("a", "b").agg(F.min("w").alias("w")))

    # arcs on shortest paths: between junctions, and from a source inside a chain to its ends
    da, db = dist.select("s", F.col("node").alias("a"), F.col("d").alias("da")), dist.select("s", F.col("node").alias("b"), F.col("d").alias("db"))
    tight = da.join(every, "a").join(db, ["s", "b"]).where(F.col("da") + F.col("w") == F.col("db")).select(
        "s", "a", "b", "chain", zero.alias("lo"), F.col("hops").alias("hi"))
    tight = stored(tight)
    to_a = own.select("s", F.col("end_a").alias("b"), "chain", F.col("pre").alias("d"), zero.alias("lo"), F.col("i").alias("hi"))
    to_b = own.select("s", F.col("end_b").alias("b"), "chain", (F.col("length") - F.col("pre")).alias("d"), F.col("i").alias("lo"), F.col("hops").alias("hi"))
    begin = stored(to_a.unionByName(to_b).join(db, ["s", "b"]).where("d = db").select("s", "b", "chain", "lo", "hi"))

    first = at_junction.select("s", "node", F.lit(1.0).alias("n")).unionByName(
        begin.groupBy("s", F.col("b").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    ahead = tight.select("s", F.col("a").alias("node"), F.col("b").alias("next"))
    sigma = _accumulated(stored(first), lambda level: level.join(ahead, ["s", "node"]).groupBy("s", F.col("next").alias("node")).agg(
        F.sum("n").alias("n")), ["s", "node"], "n")

    # every source against every chain with nodes inside: where do the two ways meet?
    seen = sigma.join(dist, ["s", "node"])
    left = seen.select("s", F.col("node").alias("end_a"), F.col("d").alias("dA"), F.col("n").alias("sa"))
    right = seen.select("s", F.col("node").alias("end_b"), F.col("d").alias("dB"), F.col("n").alias("sb"))
    wide = table.where("hops > 1")
    at = own.select("s", "chain", F.lit(True).alias("own"))
    whole = left.join(wide, "end_a").join(right, ["s", "end_b"]).join(at, ["s", "chain"], "left").where("own is null").select(
        "s", "chain", zero.alias("lo"), F.col("hops").alias("hi"), "hops", "length", F.col("end_a").alias("le"), F.col("end_b").alias("re"),
        (F.col("length") + F.col("dB") - F.col("dA")).alias("t"), "sa", "sb")
    none, one = F.lit(None).cast("long"), F.lit(1.0)
    near_a = own.join(left, ["s", "end_a"]).select(
        "s", "chain", zero.alias("lo"), F.col("i").alias("hi"), "hops", "length", F.col("end_a").alias("le"), none.alias("re"),
        (F.col("pre") - F.col("dA")).alias("t"), "sa", one.alias("sb"))
    near_b = own.join(right, ["s", "end_b"]).select(
        "s", "chain", F.col("i").alias("lo"), F.col("hops").alias("hi"), "hops", "length", none.alias("le"), F.col("end_b").alias("re"),
        (F.col("length") + F.col("pre") + F.col("dB")).alias("t"), one.alias("sa"), "sb")
    parts = stored(whole.unionByName(near_a).unionByName(near_b))
    between = (F.col("t") > 0) & (F.col("t") < 2 * F.col("length"))
    asked = stored(parts.where(between).select("chain", "t").distinct())
    plain = parts.where(~between).withColumn("ka", F.when(F.col("t") <= 0, zero).otherwise(F.col("hops") - 1)).withColumn("tie", F.lit(0))
    met = plain if asked.isEmpty() else plain.unionByName(parts.where(between).join(_nodes_before(asked, inside), ["chain", "t"]))
    # on a half chain all its nodes hang on the source where the way round is longer
    met = met.withColumn("ka", F.least(F.greatest("ka", "lo"), F.col("hi") - 1))
    met = stored(met.withColumn("share", F.when(F.col("tie") == 1, F.col("sa") / (F.col("sa") + F.col("sb"))).otherwise(0.0)))

    ka, kb, lo, hi, tie, share = (F.col("ka"), F.col("ka") + F.col("tie"), F.col("lo"), F.col("hi"), F.col("tie"), F.col("share"))
    other = tie - share
    events = F.array(_event(lo, ka + share, -1.0), _event(ka, -ka, 1.0), _event(kb, -share),
                     _event(kb, other - kb, 1.0), _event(hi, kb - other, -1.0))
    changes = met.select("chain", F.explode(events).alias("e")).select("chain", "e.*")
    units = met.select("s", F.explode(F.array(F.struct(F.col("le").alias("b"), (ka - lo + share).alias("x")),
                                              F.struct(F.col("re").alias("b"), (hi - 1 - kb + other).alias("x")))).alias("e")).select("s", "e.*")

    # units flow back to the source
    n_b, n_a = sigma.select("s", F.col("node").alias("b"), F.col("n").alias("nb")), sigma.select("s", F.col("node").alias("a"), F.col("n").alias("na"))
    ratio = tight.join(n_a, ["s", "a"]).select("s", "a", "b", "chain", "lo", "hi", "na").unionByName(
        begin.select("s", none.alias("a"), "b", "chain", "lo", "hi", one.alias("na")))
    ratio = stored(ratio.join(n_b, ["s", "b"]).withColumn("r", F.col("na") / F.col("nb")).drop("na", "nb"))
    own_unit = sigma.where("node <> s").select("s", F.col("node").alias("b"), one.alias("x"))
    packets = own_unit.unionByName(units.where("b is not null and b <> s and x > 0")).groupBy("s", "b").agg(F.sum("x").alias("x"))

    def push(level: DataFrame) -> DataFrame:
        moved = level.join(ratio.where("a is not null and a <> s"), ["s", "b"])
        return moved.groupBy("s", F.col("a").alias("b")).agg(F.sum(F.col("x") * F.col("r")).alias("x"))

    arrived = _accumulated(stored(packets), push, ["s", "b"], "x")
    through = arrived.join(ratio, ["s", "b"]).groupBy("chain", "lo", "hi").agg(F.sum(F.col("x") * F.col("r")).alias("f"))
    flows = through.select("chain", F.explode(F.array(_event(lo, F.col("f")), _event(hi, -F.col("f")))).alias("e")).select("chain", "e.*")

    changes = changes.unionByName(flows).groupBy("chain", "at").agg(F.sum("dk").alias("k"), F.sum("dm").alias("m"))
    places = changes.select("chain", "at", F.lit(0).alias("kind"), "k", "m", none.alias("u"), none.alias("v")).unionByName(
        edges.select("chain", F.col("j").alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("k"), F.lit(0.0).alias("m"), "u", "v"))
    summed = running_sums(places, "chain", ["at", "kind"], ["k", "m"]).where("kind = 1")
    return summed.select("u", "v", (F.col("k") + F.col("m") * F.col("at")).alias("credit"))
