"""Suffix-array dedup of repeated byte strings (operator 1).

Wanted is every byte covered by a ``length``-byte string that starts anywhere
else too. Only suffixes that can take part are sorted, and of these one per
stretch of text:

1. *Anchors.* The k-gram with the smallest hash inside a window of ``length``
   bytes depends on the window alone, so equal windows have equal anchors at
   equal offsets. A stretch of consecutive windows has one anchor; its
   surrounding (the union of these windows) is its context.
2. Anchors whose k-gram occurs once in the corpus are done: none of their
   windows repeats. Of the others, those with the same context are a class.
   Of a class with two members or more all windows repeat.
3. One representative of every class goes into a sparse suffix array: the
   suffixes that begin at the anchors are sorted into runs, the runs are
   *front-coded* (length of the common prefix with the one before and the
   rest), *exchanged* by k-gram, and merged by a *loser tree that knows common
   prefixes*: of two strings whose common prefixes with the last winner differ,
   the longer prefix wins without looking at a byte; only for equal ones the
   comparison goes on, behind the known prefix.
4. What repeats is read off the merge. Two suffixes share at least the smallest
   common prefix between them, so the merge yields nested groups of suffixes
   with a common prefix of d bytes. Inside a group the bytes before the anchors,
   read backwards, are kept in order; neighbours in that order that share e of
   them have d + e equal bytes around their anchors, and if these are ``length``
   or more, all windows inside are repeats of both. When two groups join, the
   smaller one is put into the larger one, so that a string is moved few times.
5. A k-gram with more than ``GROUP`` classes (a passage set into very many
   different texts) must not be in one task. Its windows are hashed (with the
   k-gram 128 bits), split by that hash and counted.

Results depend on texts only, so rows are linked by a digest of the text.

Defined results: null is an empty text; texts shorter than ``length`` lose
nothing; strings are compared within and across documents, never over their
ends; repeated rows are occurrences of their own; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key, text_of
from .rolling import doubled, mix, sliding_min, window_hashes

LENGTH = 400
GRAM = 32
CHUNK = 1 << 18  # bytes hashed at a time
PLACE = np.uint64((1 << 24) - 1)
RUN_ROWS = 20_000  # representatives of a sorted run
BUCKET_ROWS = 50_000  # representatives merged by one task
WINDOWS = 1_000_000  # window hashes compared at a time, beyond it up to the end of a group
GROUP = 20_000  # contexts of one k-gram that are merged by one task


# ---- 1. anchors -------------------------------------------------------------

def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Stretches of the texts data[starts[i]:ends[i]] (all shorter than 2**24):
    text, first and last window start, how many starts one stretch has
    (width + 1), the anchor, and hashes of k-gram and context. Consecutive equal
    stretches of a text (periodic runs) are one row of weight n."""
    levels = doubled(data, length)
    some = ends - starts >= length
    if not some.any():
        z = np.zeros(0, np.int64)
        return dict(text=z, lo=z, last=z, width=z, at=z, n=z, g=z.view(np.uint64), x=z.view(np.uint64))
    g = mix(levels[gram])
    least = sliding_min((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[some]] += 1
    edge[ends[some] - length + 1] -= 1
    s = np.flatnonzero(np.cumsum(edge[:len(least)]))
    p = (least[s] & PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
    lo, hi, at = s[cut], s[np.r_[cut[1:], len(s)] - 1], p[cut]
    width = hi - lo
    text = np.searchsorted(starts, lo, side="right") - 1
    # two overlapping windows cover the context
    x = mix(window_hashes(levels, length, lo) * np.uint64(3) + window_hashes(levels, length, hi) + width.astype(np.uint64))
    own = g[at]
    new = np.r_[True, (x[1:] != x[:-1]) | (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (lo[1:] != hi[:-1] + 1)]
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(lo)]
    base = starts[text[first]]
    return dict(text=text[first], lo=lo[first] - base, last=hi[end - 1] - base, width=width[first], at=at[first] - base,
                n=end - first, g=own[first], x=x[first])


def anchor_table(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """key, lo, last, width, at, n, g, x for every stretch of every text."""
    names = ["lo", "last", "width", "at", "n"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = batch.column(0), batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < len(raw):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                begin, end = int(offsets[i]), int(offsets[j])
                # a text longer than a chunk is taken in overlapping parts
                for a in range(begin, max(end, begin + 1), CHUNK if j == i + 1 else end - begin + 1):
                    b = min(end, a + CHUNK + length - 1) if j == i + 1 else end
                    if b - a < length:
                        continue
                    starts, ends = (np.array([0]), np.array([b - a])) if j == i + 1 else (offsets[i:j] - a, offsets[i + 1:j + 1] - a)
                    got = anchors(data[a:b], starts, ends, length, gram)
                    shift = a - begin if j == i + 1 else 0
                    for c in ("lo", "last", "at"):
                        got[c] = got[c] + shift
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(got["text"] + i)), *[pa.array(got[c].astype(np.int32)) for c in names],
                         pa.array(got["g"].view(np.int64)), pa.array(got["x"].view(np.int64))], names=["key", *names, "g", "x"])
                i = j

    t = text_of(text)
    d = docs.select(text_key(t).alias("key"), t.cast("binary").alias("raw"))
    return d.mapInArrow(found, "key binary, lo int, last int, width int, at int, n int, g long, x long")


# ---- 3. front-coded runs and the loser tree ---------------------------------

def _varint(n: int, out: bytearray) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    step = 16
    while known < most and a[known:known + step] == b[known:known + step]:
        known = min(most, known + step)
        step *= 2
    while step > 1 and known < most:
        step //= 2
        if known + step <= most and a[known:known + step] == b[known:known + step]:
            known += step
    return known


def front_coded(sorted_strings: list[tuple[bytes, bytes]]) -> bytes:
    """A run of (string, what comes with it) as common prefix length and rest."""
    out, before = bytearray(), b""
    for s, more in sorted_strings:
        h = common_prefix(before, s)
        for n in (h, len(s) - h, len(more)):
            _varint(n, out)
        out += s[h:]
        out += more
        before = s
    return bytes(out)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(string, common prefix with the one before, what comes with it), in order."""
    at, s = 0, b""
    while at < len(run):
        told = []
        for _ in range(3):
            n = shift = 0
            while True:
                byte = run[at]
                at += 1
                n |= (byte & 127) << shift
                if byte < 128:
                    break
                shift += 7
            told.append(n)
        h, rest, more = told
        s = s[:h] + run[at:at + rest]
        at += rest + more
        yield s, h, run[at - more:at]


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
    """(string, common prefix with the one before, what comes with it) over all
    runs in order.

    A loser tree over the runs' heads. Each head knows its common prefix with
    the string that left the tree last; that string is no larger than any
    head, so the head with the longer common prefix is smaller. Only when both
    are equal, bytes are compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [decoded(r) for r in runs]
    string: list[bytes | None] = [None] * k
    prefix, more = [0] * k, [b""] * k
    for i, h in enumerate(heads):
        got = next(h, None)
        if got:
            string[i], _, more[i] = got

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        x, y = string[a], string[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        h = common_prefix(x, y, prefix[a])
        if len(x) == h or (len(y) > h and x[h] < y[h]):
            prefix[b] = h
            return a, b
        prefix[a] = h
        return b, a

    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1)
    while string[win] is not None:
        yield string[win], prefix[win], more[win]
        got = next(heads[win], None)
        if got:
            string[win], prefix[win], more[win] = got
        else:
            string[win] = None
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


# ---- 4. repeats from common prefixes ----------------------------------------

HEAD = "<qq?"  # k-gram and context hash, whether the class has several members


def repeated_windows(strings: Iterable[tuple[bytes, int, bytes]], length: int, gram: int) -> Iterator[tuple[int, int, int, int | None]]:
    """(k-gram hash, context hash, first, last): ranges of a class's windows that
    repeat; no last one means all of them. ``strings`` are merged suffixes, with
    HEAD and the bytes before the anchor, backwards."""
    own: list[tuple[int, int, int, list[tuple[int, int]] | None]] = []
    groups: list[tuple[int, list[tuple[bytes, int]]]] = []  # common prefix with the group before, members by what is before

    def note(member: int, before: int, behind: int) -> None:
        _, _, at, ranges = own[member]
        if ranges is not None:
            ranges.append((at - before, at - (length - behind)))

    def join(least: int) -> None:
        while len(groups) > 1 and groups[-1][0] >= least:
            behind, a = groups.pop()
            shared, b = groups.pop()
            small, large = (a, b) if len(a) < len(b) else (b, a)
            for entry in small:
                place = bisect_left(large, entry)
                for near in large[max(0, place - 1):place + 1]:
                    before = common_prefix(entry[0], near[0])
                    if before + behind >= length:
                        note(entry[1], before, behind)
                        note(near[1], before, behind)
                large.insert(place, entry)
            groups.append((shared, large))

    def close() -> Iterator[tuple[int, int, int, int | None]]:
        join(0)
        for g, x, _, ranges in own:
            if ranges is None:
                yield g, x, 0, None
                continue
            end = -1
            for a, b in sorted(ranges):
                if end < 0:
                    first, end = a, b
                elif a > end + 1:
                    yield g, x, first, end
                    first, end = a, b
                else:
                    end = max(end, b)
            if end >= 0:
                yield g, x, first, end
        own.clear()
        groups.clear()

    for _, shared, more in strings:
        if shared < gram:  # no window in common with those before
            yield from close()
        join(shared)
        g, x, several = struct.unpack_from(HEAD, more)
        left = more[struct.calcsize(HEAD):]
        groups.append((shared, [(left, len(own))]))
        own.append((g, x, len(left), None if several else []))
    yield from close()


def merged_repeats(reps: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(g, x, first, last), as ``repeated_windows``, for classes (columns context,
    at, g, x, m)."""
    buckets = max(1, -(-n // BUCKET_ROWS))

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            bucket = sorted(held)
            runs = [front_coded(sorted(held[b])) for b in bucket]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(runs, pa.binary())], names=["bucket", "run"])

        for batch in batches:
            for context, at, g, x, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(g % buckets, []).append((context[at:], struct.pack(HEAD, g, x, m > 1) + context[:at][::-1]))
                size += 1
            if size > RUN_ROWS:
                yield flush()
                size = 0
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def done() -> pa.RecordBatch:
            told = list(zip(*repeated_windows(merged(runs), length, gram), strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, kinds, strict=True)], names=["g", "x", "first", "last"])

        for batch in batches:
            for bucket, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and runs:
                    yield done()
                    runs = []
                now = bucket
                runs.append(run)
        if runs:
            yield done()

    runs = reps.select("context", "at", "g", "x", "m").mapInArrow(sorted_runs, "bucket int, run binary")
    return runs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "g long, x long, first int, last int")


# ---- the whole --------------------------------------------------------------

def _contexts(docs: DataFrame, reps: DataFrame, text: str, length: int) -> DataFrame:
    """``reps`` (key, lo, width, at, g, x, m, parts) with the bytes of their contexts.

    Copies of a text are folded before the shuffle, so a text that a third of
    all rows hold travels once per task."""
    t = text_of(text)
    texts = docs.where(F.octet_length(t) >= length).groupBy(text_key(t).alias("key")).agg(F.first(t.cast("binary")).alias("raw"))
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("lo", "width", "at", "g", "x", "m", "parts")).alias("own"))
    joined = texts.join(wanted, "key").select("key", "raw", "own")
    return joined.select("raw", F.explode("own").alias("r")).select(
        (F.col("r.at") - F.col("r.lo")).alias("at"), "r.g", "r.x", "r.m", "r.parts",
        F.substring(F.col("raw"), F.col("r.lo") + 1, F.col("r.width") + length).alias("context"))


def _windows(reps: DataFrame, length: int) -> DataFrame:
    """(g, part, x, m, at, hashes): the hashes of every representative's windows,
    split into ``parts`` by window hash; at: the numbers of the windows."""
    schema = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("x", pa.int64()), ("m", pa.int64()),
                        ("at", pa.binary()), ("hashes", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = len(r["context"]) - length + 1
                h = window_hashes(doubled(np.frombuffer(r["context"], np.uint8), length), length, np.arange(n))
                at = np.arange(n, dtype=np.uint16)
                for part in range(r["parts"]):
                    own = h % np.uint64(r["parts"]) == part
                    if own.any():
                        out.append((r["g"], part, r["x"], r["m"], at[own].tobytes(), h[own].tobytes()))
            columns = list(zip(*out, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return reps.select("g", "parts", "x", "m", "context").mapInArrow(
        hashed, "g long, part int, x long, m long, at binary, hashes binary")


def _hashed_repeats(windows: DataFrame) -> DataFrame:
    """(g, x, first, last): runs of windows that another representative has too.
    ``windows`` lies sorted by (g, part), so equal windows are in one stretch."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done(rows: list[dict]) -> pa.RecordBatch:
            h = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            n = np.array([len(x) for x in h], np.int64)
            # a window's k-gram and hash, told apart among the rows held here
            gram = mix(np.array([r["g"] for r in rows], np.int64).view(np.uint64) + np.uint64(1))
            whole = np.concatenate(h) ^ np.repeat(gram, n) if len(h) else np.zeros(0, np.uint64)
            _, place, count = np.unique(whole, return_inverse=True, return_counts=True)
            twice = count[place] > 1
            out: list[tuple[int, int, int, int]] = []
            for r, a, b in zip(rows, np.cumsum(n) - n, np.cumsum(n), strict=True):
                if r["m"] == 1 and twice[a:b].any():  # classes of several members repeat as a whole
                    at = np.frombuffer(r["at"], np.uint16)[twice[a:b]].astype(np.int64)
                    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
                    last = at[np.r_[cut[1:], len(at)] - 1]
                    out += [(r["g"], r["x"], i, j) for i, j in zip(at[cut].tolist(), last.tolist(), strict=True)]
            told = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, kinds, strict=True)], names=["g", "x", "first", "last"])

        for batch in batches:
            for r in batch.to_pylist():
                if size > WINDOWS and (held[-1]["g"], held[-1]["part"]) != (r["g"], r["part"]):
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["hashes"]) // 8
        yield done(held)

    dealt = windows.repartition("g", "part").sortWithinPartitions("g", "part")
    return dealt.mapInArrow(counted, "g long, x long, first int, last int")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans): for every distinct text with something repeated, the
    maximal runs of bytes (start, end) covered by repeated strings."""
    if not 2 * gram <= length:
        raise ValueError("the gram must be at most half as long as the strings")
    found = materialize(anchor_table(docs, text, length, gram), "anchors")
    grams = found.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("g").alias("_g"))
    found = materialize(found.join(grams, found["g"] == grams["_g"]).drop("_g"), "repeated-anchors")
    least = F.min(F.struct("key", "lo", "width", "at")).alias("r")
    classes = materialize(found.groupBy("g", "x").agg(F.sum("n").alias("m"), least), "classes")
    many = classes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")).where("parts > 1")
    reps = classes.join(many, "g", "left").select("r.key", "r.lo", "r.width", "r.at", "g", "x", "m", F.coalesce("parts", F.lit(1)).alias("parts"))
    reps = materialize(_contexts(docs, reps, text, length), "contexts")

    cold, hot = reps.where("parts = 1"), reps.where("parts > 1")
    repeats = merged_repeats(cold, cold.count(), length, gram).union(_hashed_repeats(_windows(hot, length))).union(
        hot.where("m > 1").select("g", "x", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last")))
    repeats = materialize(repeats, "repeats").select(F.col("g").alias("_g"), F.col("x").alias("_x"), "first", F.col("last").alias("until"))
    spans = found.join(repeats, (found["g"] == repeats["_g"]) & (found["x"] == repeats["_x"])).select(
        "key", (F.col("lo") + F.col("first")).alias("start"),
        (F.coalesce(F.col("lo") + F.col("until"), F.col("last")) + length).alias("end"))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return spans.mapInArrow(_joined_spans, "key binary, spans array<struct<start:int,end:int>>")


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        lists = batch.column(1)
        at, flat = lists.offsets.to_numpy(), lists.flatten()
        start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
        out, base = [], at[0] if len(at) else 0
        for i in range(len(lists)):
            a, b = at[i] - base, at[i + 1] - base
            order = np.argsort(start[a:b], kind="stable")
            lo, hi = start[a:b][order], np.maximum.accumulate(end[a:b][order])
            new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
            out.append([{"start": x, "end": y} for x, y in zip(lo[new].tolist(), hi[np.r_[new[1:], len(hi)] - 1].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["key", "spans"])


def _kept(raw: Column, spans: Column) -> Column:
    """The bytes outside the spans, one after the other."""
    left = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")), lambda acc, x: F.struct(
        x["end"].alias("at"), F.concat(acc["out"], F.substring(raw, acc["at"] + 1, x["start"] - acc["at"])).alias("out")))
    return F.when(spans.isNull(), raw).otherwise(
        F.concat(left["out"], F.substring(raw, left["at"] + 1, F.length(raw))))


def deduplicate_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                      gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed, null if none), kept (bytes)."""
    spans = materialize(repeated_spans(docs, text, length, gram), "spans")
    t = text_of(text)
    d = docs.select(F.col(doc_id).alias("doc_id"), t.cast("binary").alias("raw"), text_key(t).alias("key"))
    d = d.join(spans, "key", "left")
    return d.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), "spans", _kept(F.col("raw"), F.col("spans")).alias("kept"))
