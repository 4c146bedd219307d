"""Road-graph operators.

The graph is two DataFrames: ``nodes(node_id)`` and ``edges(u, v, w)``.
Edge betweenness is computed Brandes-style for a set of sources at once, as
iterative DataFrame jobs whose state is partitioned by ``(source, node)``:

1. distances  — frontier relaxation: join the improved frontier with the arcs,
   keep the minimum per (source, node), keep only rows that improve;
2. path counts — hop levels over *tight* arcs (``d(s,a) + w = d(s,b)``): each
   level holds the number of shortest paths with exactly that many arcs, so
   the count per node is the sum over levels (no ordering by distance needed;
   the tight graph is acyclic because lengths are positive);
3. dependencies — every reached node injects one unit that flows back along
   tight arcs split in proportion ``sigma(a)/sigma(b)``; the flow crossing an
   arc, summed over rounds and sources, is the arc's Brandes credit.

Each round is one job, whose output (only what the round improved) is written
to the shared folder; the improvements of several rounds are merged by their
minimum now and then, so plans stay short and a round writes its frontier, not
the whole state. The driver only reads row counts.

Lengths are metres as doubles; inside they are whole millimetres, which makes
the tight-arc test exact. A length that is missing or not at least a
millimetre is an error: a cycle of zero length has no shortest paths to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.hashing import seeded_order
from roadpulse.operators import contraction
from roadpulse.session import RoundState, stored_with_metrics, stored

# Exact below this many nodes, else k pivots with this seed.
EXACT_THRESHOLD_NODES = 3000
K_PIVOTS = 500
SEED = 42
DEFAULT_LENGTH = 1.0


def collapse_simple(arcs: DataFrame, u: str = "u", v: str = "v", length: str = "length",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Multigraph -> simple undirected graph, shortest parallel edge kept.

    Missing lengths count as 1.0; self-loops stay (as ``u = v``). Columns in
    ``carry`` (its key, its geometry) are those of the edge that is kept; of
    equally short ones that is the first by these columns, then by its source.
    """
    a, b = F.least(F.col(u), F.col(v)), F.greatest(F.col(u), F.col(v))
    metres = F.coalesce(F.col(length).cast("double"), F.lit(DEFAULT_LENGTH))
    if not carry:
        return arcs.groupBy(a.alias("u"), b.alias("v")).agg(F.min(metres).alias("length"), F.count(F.lit(1)).alias("n_parallel"))
    edge = F.struct(metres.alias("length"), *[F.col(c).alias(c) for c in carry], F.col(u).alias("source"))
    kept = arcs.groupBy(a.alias("u"), b.alias("v")).agg(F.min(edge).alias("kept"), F.count(F.lit(1)).alias("n_parallel"))
    return kept.select("u", "v", "kept.length", "n_parallel", *[F.col(f"kept.{c}").alias(c) for c in carry])


def graph_metadata(arcs: DataFrame, simple: DataFrame, nodes: DataFrame, n_sources: int | None = None,
                   seed: int = SEED) -> DataFrame:
    """Graph size before/after the collapse and the centrality method."""
    a = arcs.agg(F.count(F.lit(1)).alias("n_edges_before"))
    s = simple.agg(F.count(F.lit(1)).alias("n_edges_after"), F.sum(F.col("n_parallel") - 1).alias("n_collapsed"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    rows = (a.select("n_edges_before", F.lit(None).cast("long").alias("n_edges_after"),
                     F.lit(None).cast("long").alias("n_collapsed"), F.lit(None).cast("long").alias("n_nodes"))
            .unionByName(s.select(F.lit(None).cast("long").alias("n_edges_before"), "n_edges_after",
                                  F.col("n_collapsed").cast("long").alias("n_collapsed"),
                                  F.lit(None).cast("long").alias("n_nodes")))
            .unionByName(n.select(*[F.lit(None).cast("long").alias(c) for c in
                                    ("n_edges_before", "n_edges_after", "n_collapsed")], "n_nodes")))
    one = rows.agg(*[F.max(c).alias(c) for c in ("n_edges_before", "n_edges_after", "n_collapsed", "n_nodes")])
    exact = F.col("n_nodes") <= F.lit(EXACT_THRESHOLD_NODES)
    k = F.lit(n_sources) if n_sources is not None else F.when(exact, F.col("n_nodes")).otherwise(
        F.least(F.lit(K_PIVOTS), F.col("n_nodes") - 1))
    return one.select("*", F.when(exact & F.lit(n_sources is None), "exact").otherwise("approximate").alias("method"),
                      k.cast("long").alias("k_pivots"), F.lit(seed).alias("seed"))


def pivot_sources(nodes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """K sources, the first in md5(seed:node) order (a distributed top-k)."""
    return nodes.orderBy(seeded_order(seed, "node_id"), "node_id").limit(k).select(F.col("node_id").alias("s"))


def _arcs(edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("u") != F.col("v")).select("u", "v", "w")
    return (e.select(F.col("u").alias("a"), F.col("v").alias("b"), "w")
            .unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b"), "w")))


MERGE_ROUNDS = 8  # rounds whose rows are kept apart


def _summed(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The sum of ``value`` per ``keys`` over the rounds' tables."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys).agg(F.sum(value).alias(value))


def _distances(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """Frontier relaxation: each round writes the (source, node) rows that it
    improved, which are the next frontier. The best distance so far is the
    minimum over all that was written."""
    frontier = stored(sources.select("s", F.col("s").alias("node"), F.lit(0).cast("long").alias("d")))
    written = [frontier]

    def best() -> DataFrame:
        whole = written[0]
        for part in written[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy("s", "node").agg(F.min("d").alias("d")) if len(written) > 1 else whole

    while True:
        cand = (frontier.join(arcs, frontier.node == arcs.a)
                .groupBy("s", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("cd")))
        better = cand.join(best(), ["s", "node"], "left").where(F.col("d").isNull() | (F.col("cd") < F.col("d")))
        frontier, m = stored_with_metrics(better.select("s", "node", F.col("cd").alias("d")), n=F.count(F.lit(1)))
        if not m["n"]:
            return stored(best())
        written.append(frontier)
        if len(written) > MERGE_ROUNDS:
            written = [stored(best())]


def _tight(dist: DataFrame, arcs: DataFrame, st: RoundState) -> DataFrame:
    da = dist.select("s", F.col("node").alias("a"), F.col("d").alias("da"))
    db = dist.select("s", F.col("node").alias("b"), F.col("d").alias("db"))
    return st.keep(da.join(arcs, "a").join(db, ["s", "b"])
                   .where(F.col("da") + F.col("w") == F.col("db")).select("s", "a", "b"))


def _path_counts(sources: DataFrame, tight: DataFrame, st: RoundState) -> DataFrame:
    level = sources.select("s", F.col("s").alias("node"), F.lit(1.0).alias("n"))
    levels = [level]
    step = tight.select("s", F.col("a").alias("node"), F.col("b").alias("next"))
    while True:
        nxt, n = st.step(level.join(step, ["s", "node"])
                         .groupBy("s", F.col("next").alias("node")).agg(F.sum("n").alias("n")))
        if n == 0:
            break
        levels.append(nxt)
        level = nxt
        if len(levels) > MERGE_ROUNDS:
            levels = [st.keep(_summed(levels, ["s", "node"], "n"))]
    return st.keep(_summed(levels, ["s", "node"], "n").withColumnRenamed("n", "sigma"))


def _credits(sigma: DataFrame, tight: DataFrame, st: RoundState) -> DataFrame:
    sa = sigma.select("s", F.col("node").alias("a"), F.col("sigma").alias("sig_a"))
    sb = sigma.select("s", F.col("node").alias("b"), F.col("sigma").alias("sig_b"))
    ratio = st.keep(tight.join(sa, ["s", "a"]).join(sb, ["s", "b"])
                    .select("s", "a", "b", (F.col("sig_a") / F.col("sig_b")).alias("r")))
    packets = sigma.where(F.col("node") != F.col("s")).select("s", F.col("node").alias("b"), F.lit(1.0).alias("x"))
    pushes = []
    while True:
        push, n = st.step(packets.join(ratio, ["s", "b"]).select("s", "a", "b", (F.col("x") * F.col("r")).alias("f")))
        if n == 0:
            break
        pushes.append(push.groupBy("a", "b").agg(F.sum("f").alias("f")))
        if len(pushes) > MERGE_ROUNDS:
            pushes = [st.keep(_summed(pushes, ["a", "b"], "f"))]
        packets = (push.where(F.col("a") != F.col("s"))
                   .groupBy("s", F.col("a").alias("b")).agg(F.sum("f").alias("x")))
    if not pushes:
        return sigma.sparkSession.createDataFrame([], "u long, v long, credit double")
    return (_summed(pushes, ["a", "b"], "f").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .agg(F.sum("f").alias("credit")))


MILLIMETRES = 1000


def n_sources(n: int, k: int | None = None) -> int | None:
    """How many pivots: None (every node is a source) up to the exact
    threshold, else ``min(500, n - 1)``; a given ``k`` holds as it is."""
    return k if k is not None else None if n <= EXACT_THRESHOLD_NODES else min(K_PIVOTS, n - 1)


def edge_betweenness(edges: DataFrame, nodes: DataFrame | None = None, k: int | None = None,
                     seed: int = SEED, normalized: bool = True, every: bool = False) -> DataFrame:
    """Weighted edge betweenness of a simple undirected graph.

    ``edges(u, v, w)`` with ``u <= v`` and lengths ``w`` in metres (a millimetre
    at least). All nodes are sources up to ``EXACT_THRESHOLD_NODES``; beyond,
    or with ``k``, md5-chosen pivots are, and the result is rescaled by n/k.
    With ``every`` all nodes are sources, whatever the size of the graph.
    Normalised as ordered-pair dependency sum / (n(n-1)). Returns
    ``(u, v, centrality)`` for every input edge (0 when on no shortest path).
    """
    if nodes is None:
        nodes = (edges.select(F.col("u").alias("node_id"))
                 .unionByName(edges.select(F.col("v").alias("node_id"))).distinct())
    n = nodes.count()
    k = None if every else n_sources(n, k)
    sources = (pivot_sources(nodes, k, seed) if k is not None
               else nodes.select(F.col("node_id").alias("s")))
    st = RoundState()
    sources = st.keep(sources)
    # the arcs are static and small next to the (source, node) state; they are
    # kept unpartitioned so each frontier join shuffles both sides and AQE can
    # split the partition of a high-degree hub (skew join)
    whole = F.round(F.col("w").cast("double") * MILLIMETRES).cast("long")
    arcs, m = stored_with_metrics(_arcs(edges.select("u", "v", whole.alias("w"))),
                                  bad=F.count_if(F.coalesce(F.col("w"), F.lit(0)) <= 0))
    if m["bad"]:
        raise ValueError(f"{m['bad'] // 2} edges have no length or one below a millimetre")
    two = arcs.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).where("deg = 2")
    if not two.isEmpty():
        # chains of nodes with two neighbours: rounds by junctions, not by nodes
        credit = stored(contraction.credits(arcs, sources, n))
    else:
        dist = _distances(sources, arcs)
        tight = _tight(dist, arcs, st)
        sigma = _path_counts(sources, tight, st)
        credit = stored(_credits(sigma, tight, st))
    scale = 1.0
    if normalized:
        scale = 1.0 / (n * (n - 1)) if n > 1 else 0.0
        if k is not None:
            scale *= n / k
    out = edges.select("u", "v").join(credit, ["u", "v"], "left")
    return out.select("u", "v", (F.coalesce("credit", F.lit(0.0)) * F.lit(scale)).alias("centrality"))


def assign_centrality(points: DataFrame, centrality: DataFrame, u: str = "nearest_u",
                      v: str = "nearest_v") -> DataFrame:
    """Unordered-pair lookup of an edge score; a miss gives NULL."""
    c = centrality.select(F.col("u").alias("__cu"), F.col("v").alias("__cv"),
                          F.col("centrality").alias("centrality_score"))
    a, b = F.least(F.col(u), F.col(v)), F.greatest(F.col(u), F.col(v))
    return points.join(c, (a == F.col("__cu")) & (b == F.col("__cv")), "left").drop("__cu", "__cv")
