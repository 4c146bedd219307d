"""Sharding by balanced label propagation (operator 7).

Documents that belong together (here: equal texts) are members of a group.
All start on shards of equal size; in each round every member looks at where
the members of its groups are and wishes to move to the shard that holds most
of them. Wishes are granted under quotas that leave every shard's size as it
is: moves from s to t are matched by wishes from t to s, or by documents
without any link that move from t to s, which cuts nothing. Within a pair of
shards larger gains go first. So row counts stay at most one apart (law
``rows``) while fewer and fewer links are cut.

Where a shard has nothing left to give for the wishes from s to t, those from
s go to their next best shard from then on, until t has free documents or
wishes to s again. So a group larger than a shard fills its best shard, then
its second best, and so on. Rounds that find such a pair of shards don't count
among ``rounds``, up to one a shard.

Only counts per pair of shards and size of gain come to the driver (at most
shards x shards x 64 rows). A group that a third of all rows belong to is one
row of counts; its members are never gathered.

Defined results: null texts are empty texts and are equal to each other; null
or repeated ids need no care, rows are told apart by a number of their own; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_rank, materialize, text_key, text_of

SHARDS = 8
ROUNDS = 6
SETTLED = 0.001  # stop when fewer than this share of the members move
PART_ROWS = 50_000  # rows numbered by one window


def _parts(n: int) -> int:
    return max(16, n // PART_ROWS)


def equal_shards(nodes: DataFrame, shards: int, n: int) -> DataFrame:
    """(node, shard): sizes at most one apart, in an order given by a hash."""
    ranked = exact_rank(nodes.select("node"), [], F.xxhash64("node"), "rank", _parts(n))
    return ranked.select("node", (F.col("rank") % shards).cast("int").alias("shard"))


def _wishes(members: DataFrame, labels: DataFrame, shards: int, blocked: set[tuple[int, int]], room: set[int]) -> DataFrame:
    """(node, shard, target, level): one row per member that would rather be
    elsewhere, at a shard it isn't ``blocked`` (from, to) from. Ties between
    shards are settled by ``room`` for more, then by a hash of the group, so
    that all members of a group agree."""
    cols = [f"n{s}" for s in range(shards)]
    placed = members.join(labels, "node")
    counts = placed.groupBy("group").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(c) for s, c in enumerate(cols)])
    seen = placed.join(counts, "group").groupBy("node", "shard").agg(
        F.min("group").alias("group"), *[F.sum(c).alias(c) for c in cols])
    turn = F.pmod(F.xxhash64("group"), F.lit(shards))
    best = F.array_max(F.array(*[F.when(
        ~F.col("shard").isin([f for f, t in blocked if t == s]),
        F.struct(F.col(c).alias("n"), F.lit(s in room).alias("room"), F.pmod(turn + s, F.lit(shards)).alias("turn"),
                 F.lit(s).alias("s"))) for s, c in enumerate(cols)]))  # nulls don't count
    own: Column = F.get(F.array(*cols), F.col("shard"))
    w = seen.select("node", "shard", best.alias("best"), own.alias("own"))
    w = w.where(F.col("best.s") != F.col("shard"))
    gain = F.col("best.n") - F.col("own")
    return w.select("node", "shard", F.col("best.s").alias("target"), F.floor(F.log2(gain + 1)).cast("int").alias("level"))


def _quotas(wanted: dict[tuple[int, int, int], int], free: dict[int, int], shards: int
            ) -> tuple[dict[tuple[int, int, int], int], dict[tuple[int, int], int]]:
    """Granted wishes by (from, to, level), and moves of free documents by
    (from, to), such that every shard gives as many as it takes."""
    total = {}
    for (s, t, _), n in wanted.items():
        total[s, t] = total.get((s, t), 0) + n
    left, granted, filled = dict(free), {}, {}
    for s in range(shards):
        for t in range(s):
            a, b = total.get((s, t), 0), total.get((t, s), 0)
            granted[s, t] = granted[t, s] = min(a, b)
    for (s, t), n in sorted(total.items(), key=lambda x: -x[1]):
        more = min(n - granted[s, t], left.get(t, 0))
        if more > 0:
            granted[s, t] += more
            filled[t, s] = filled.get((t, s), 0) + more
            left[t] -= more
    quota = {}
    for (s, t, level), n in sorted(wanted.items(), reverse=True):  # larger gains first
        quota[s, t, level] = min(n, granted[s, t])
        granted[s, t] -= quota[s, t, level]
    return quota, filled


def _blocked(before: set[tuple[int, int]], wanted: dict[tuple[int, int, int], int], quota: dict[tuple[int, int, int], int],
             room: set[int]) -> set[tuple[int, int]]:
    """Pairs (from, to) of shards whose wishes can't be granted any more."""
    refused = {(s, t) for (s, t, level), n in wanted.items() if n > quota[s, t, level]}
    still = {(s, t) for s, t in before if (t, s) not in refused}
    # wishes against a blocked pair's direction are matched once it is open
    new = {(s, t) for s, t in refused if (t, s) not in before}
    return {(s, t) for s, t in still | new if t not in room}


def _lookup(table: dict[tuple, int], *columns: str) -> Column:
    """Value for a key of small integers, 0 if there is none; at most a few
    hundred literals."""
    entries = [x for k, v in table.items() if v for x in (F.lit("/".join(map(str, k))), F.lit(v))]
    if not entries:
        return F.lit(0)
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0))


def propagate(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for every row of ``nodes`` (column node, unique), given
    ``members`` (columns node, group; groups of one are of no use)."""
    n = nodes.count()
    labels = materialize(equal_shards(nodes, shards, n), "labels")
    linked = materialize(members.select("node").distinct(), "linked")
    m = linked.count()
    blocked, room = set(), set(range(shards))
    left, extra, round_no = rounds if m else 0, shards, 0
    while left:
        wishes = materialize(_wishes(members, labels, shards, blocked, room), "wishes")
        wanted = {(r["shard"], r["target"], r["level"]): r["n"] for r in wishes.groupBy("shard", "target", "level").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        idle = labels.join(linked, "node", "left_anti")
        free = {r["shard"]: r["n"] for r in idle.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        quota, filled = _quotas(wanted, free, shards)
        moved = sum(quota.values())
        after = dict(free)
        for (t, s), k in filled.items():  # free documents of t go to s
            after[t] -= k
            after[s] = after.get(s, 0) + k
        room = {s for s, k in after.items() if k}
        now = _blocked(blocked, wanted, quota, room)
        last, news = moved <= SETTLED * m and now == blocked, bool(now - blocked)
        blocked = now
        round_no += 1
        if news and extra:
            extra -= 1
        else:
            left -= 1
        if not moved:
            if last:
                break
            continue
        order = F.xxhash64("node", F.lit(round_no))
        go = exact_rank(wishes, ["shard", "target", "level"], order, "rank", max(4, _parts(m) // 16))
        go = go.where(F.col("rank") < _lookup(quota, "shard", "target", "level")).select("node", F.col("target").alias("to"))
        if filled:
            # free documents of shard t, by rank: the first ones go to the first shard that is owed some, and so on
            spread = exact_rank(idle, ["shard"], order, "rank", _parts(n))
            to, owed = F.lit(None).cast("int"), {}
            for (t, s), k in sorted(filled.items()):
                begin = owed.get(t, 0)
                owed[t] = begin + k
                to = F.when((F.col("shard") == t) & (F.col("rank") >= begin) & (F.col("rank") < begin + k), s).otherwise(to)
            go = go.union(spread.select("node", to.alias("to")).where("to is not null"))
        labels = materialize(labels.join(go, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels")
        if last:
            break
    return labels


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Groups are equal texts; the slot is the document's place on its shard."""
    t = text_of(text)
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        text_key(t).alias("group")), "nodes")
    many = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members = materialize(rows.select("node", "group").join(many, "group", "left_semi"), "members")
    labels = propagate(rows, members, shards, rounds)
    n = rows.count()
    placed = exact_rank(rows.drop("group").join(labels, "node"), ["shard"], F.col("node"), "slot", _parts(n))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
