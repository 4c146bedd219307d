"""Cross-tokenizer alignment with external spill counting (operator 11).

Every text is encoded by two tokenizers. Where tokens of both end at one byte
the text is cut into groups; tokens of a group are linked with each other. How
many documents hold an id pair linked is counted over the corpus, and every
document gets back what its links' counts say.

1. Texts are cut into chunks before a space that follows a non-space, where
   both tokenizers always begin a new token; a block of texts encodes each of
   its distinct chunks once. A block's pair-document records are sorted by
   (radix of the first id, first id, second id, document) and leave as one run
   of zstd frames a radix part, written to the shared folder.
2. Runs of a part are merged, ``FAN_IN`` at a time, by a heap over the runs'
   frames: up to the smallest last key of the open frames all is known. Merging
   goes on in rounds until each part has one run. What is merged is a pair and
   its number of documents, so a pair that every document holds costs one entry
   a run, and a part is bounded by the vocabularies, whatever the input's size.
3. The last merge sees the pairs of one first id one after the other, so it
   notes each id's highest count, and leaves a sorted file a part. Runs look
   their pairs up there and give every document its share.

Defined results: a text that is null or empty, or that a tokenizer's bytes do
not give back, has no tokens: zeros and an empty ``groups_sha256``. Repeated
rows and ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.session import scratch_path

from .common import materialize
from .files import map_file, open_output
from .tokens import _byte_symbols, public_path

RADIX = 16
BLOCK_BYTES = 2 << 20  # of texts, whose records are sorted at once
FAN_IN = 64
FRAME = 1 << 14  # pairs in a zstd frame
FRAMES = 16  # in a row
LINKS = 1 << 19  # links expanded at once

# white space of any kind: a space after one of these starts no chunk
SPACES = "\t-\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks, offsets): space+text i is the chunks offsets[i]:offsets[i + 1] joined."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    marked = pc.replace_substring_regex(spaced, pattern=f"([^{SPACES}]) ", replacement="\\1\x00 ")
    cut = pc.split_pattern(marked, "\x00")
    if pc.any(pc.match_substring(texts, "\x00")).as_py():  # the mark itself is in a text
        plain = [p if "\x00" not in t else re.split(r"(?<=\S)(?= )", t)
                 for t, p in zip(spaced.to_pylist(), cut.to_pylist(), strict=True)]
        cut = pa.array(plain, pa.list_(pa.large_string()))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    return cut.flatten(), offsets - offsets[0]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {s: i for i, s in enumerate(_byte_symbols())}
        n = self.a.get_vocab_size()
        told = [self.a.id_to_token(i) or "" for i in range(n)]
        a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in told]
        b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.lone = self.b.piece_to_id("\u2581")
        self.sides = []
        for table in (a_bytes, b_bytes):
            size = np.array([len(t) for t in table], np.int64)
            self.sides.append((pa.array(table, pa.large_binary()), size))
        # an id as it is written in ``groups``, with each of the signs that can follow
        self.written = [pa.array([f"{i}{s}".encode() for i in range(len(t)) for s in (",", end)], pa.large_binary())
                        for (t, _), end in zip(self.sides, "|;", strict=True)]

    def ids(self, distinct: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side (ids, tokens by chunk)."""
        a = [e.ids for e in self.a.encode_batch_fast(distinct, add_special_tokens=False)]
        # B puts a space before what it is given; of a lone space nothing is left to give
        b = [x or [self.lone] for x in self.b.encode([c[1:] for c in distinct], num_threads=1)] if distinct else []
        return [(np.fromiter(chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b)]


def _whole(flat: np.ndarray, ids: np.ndarray, owner: np.ndarray, side, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per chunk: do its tokens' bytes give it back?"""
    table, size = side
    have = np.bincount(owner, size[ids], len(sizes)).astype(np.int64)
    same = have == sizes
    took = table.take(pa.array(ids[same[owner]]))
    joined = np.frombuffer(took.buffers()[2], np.uint8) if len(took) and took.buffers()[2] is not None else np.zeros(0, np.uint8)
    own = np.repeat(same, sizes)
    differ = np.flatnonzero(own)[joined[:own.sum()] != flat[own]]
    same[np.searchsorted(starts, differ, side="right") - 1] = False
    return same


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … counts[0] of them, then those of the next."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


class Block:
    """What a block of texts says: figures and digest per document, and its
    pair-document records sorted by (pair, document)."""

    def __init__(self, aligner: Aligner, texts: pa.Array):
        n = len(texts)
        filled = texts.cast(pa.large_string()).fill_null("")
        flat, offsets = chunks(filled)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        m = len(distinct)
        codes = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        data = distinct.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[:sizes.sum()] if data is not None else np.zeros(0, np.uint8)
        sides = aligner.ids(distinct.to_pylist())
        owners = [np.repeat(np.arange(m), k) for _, k in sides]
        good = np.ones(m, bool)
        for (ids, _), owner, side in zip(sides, owners, aligner.sides, strict=True):
            good &= _whole(raw, ids, owner, side, sizes, starts)
        ids, own, ends = [], [], []
        for (i, _), owner, (_, size) in zip(sides, owners, aligner.sides, strict=True):
            i, owner = i[good[owner]], owner[good[owner]]
            kept = np.where(good, sizes, 0)
            shift = starts - (np.cumsum(kept) - kept)  # bytes of chunks left out before
            ids.append(i)
            own.append(owner)
            ends.append(np.cumsum(size[i]) + shift[owner])
        common = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
        group = [np.cumsum(c) - c for c in common]
        n_groups = int(common[0].sum())
        count = [np.bincount(g, minlength=n_groups).astype(np.int64) for g in group]
        group_owner = own[0][common[0]]
        figures = [np.bincount(own[0], minlength=m), np.bincount(own[1], minlength=m), np.bincount(group_owner, minlength=m)]
        links = np.zeros(m, np.int64)
        np.add.at(links, group_owner, count[0] * count[1])

        full = np.zeros(n, bool)
        full[pc.greater(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False)] = True
        full[doc[~good[codes]]] = False
        use = full[doc]
        doc, codes = doc[use], codes[use]
        self.figures = []
        for f in (*figures, links):
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, f[codes])
            self.figures.append(total)
        self.digests = self._digests(aligner, n, doc, codes, full, m, ids, own, group, count, common)
        self._records(n, doc, codes, m, ids, own, group, count)

    @staticmethod
    def _digests(aligner, n, doc, codes, full, m, ids, own, group, count, common) -> list[str]:
        # the two sides' tokens in written order, each with the sign after it
        before = [np.cumsum(c) - c for c in count]
        place = [np.arange(len(ids[0])) + before[1][group[0]],
                 np.arange(len(ids[1])) + before[0][group[1]] + count[0][group[1]]]
        total = len(ids[0]) + len(ids[1])
        order, owner = np.zeros(total, np.int64), np.zeros(total, np.int64)
        shift = len(aligner.written[0])
        for s in (0, 1):
            order[place[s]] = 2 * ids[s] + common[s] + s * shift
            owner[place[s]] = own[s]
        table = pa.concat_arrays(aligner.written)
        lengths = pc.binary_length(table).to_numpy()[order]
        took = table.take(pa.array(order))
        edges = np.concatenate([[0], np.cumsum(np.bincount(owner, lengths, m))]).astype(np.int64)
        per_chunk = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(edges), took.buffers()[2]]) \
            if total else pa.array([b""] * m, pa.large_binary())
        texts = per_chunk.take(pa.array(codes))
        data = texts.buffers()[2]
        view = memoryview(data) if data is not None else memoryview(b"")
        size = np.zeros(n, np.int64)
        np.add.at(size, doc, np.diff(edges)[codes])
        stop = np.cumsum(size)
        return [sha256(view[e - s:e - 1]).hexdigest() if f else "" for e, s, f in zip(stop.tolist(), size.tolist(), full.tolist(), strict=True)]

    def _records(self, n, doc, codes, m, ids, own, group, count) -> None:
        # distinct pairs of every chunk, from slices of its links
        first_b = np.cumsum(count[1]) - count[1]
        fan = count[1][group[0]]
        reach = np.cumsum(fan)
        chunk_at, key_at, times = [], [], []
        at = 0
        while at < len(fan):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + LINKS, side="right")))
            a = np.repeat(ids[0][at:to], fan[at:to])
            b = ids[1][_ranges(first_b[group[0][at:to]], fan[at:to])]
            owner = np.repeat(own[0][at:to], fan[at:to])
            keys, back = np.unique((a % RADIX) << 56 | a << 28 | b, return_inverse=True)
            both, n_times = _summed(owner * len(keys) + back, np.ones(len(back), np.int64))
            chunk_at.append(both // len(keys))
            key_at.append(keys[both % len(keys)])
            times.append(n_times)
            at = to
        chunk = np.concatenate(chunk_at) if chunk_at else np.zeros(0, np.int64)
        key = np.concatenate(key_at) if key_at else np.zeros(0, np.int64)
        times = np.concatenate(times) if times else np.zeros(0, np.int64)
        known, pair = np.unique(key, return_inverse=True)
        per = np.bincount(chunk, minlength=m).astype(np.int64)
        start = np.cumsum(per) - per
        held, repeats = _summed(doc * m + codes, np.ones(len(doc), np.int64))
        d, c = held // max(m, 1), held % max(m, 1)
        at = _ranges(start[c], per[c])
        both, mult = _summed(pair[at] * n + np.repeat(d, per[c]), times[at] * np.repeat(repeats, per[c]))
        self.docs, self.mult = (both % max(n, 1)).astype(np.int32), mult.astype(np.int32)
        self.keys, self.counts = _summed(known[both // max(n, 1)], np.ones(len(both), np.int64))


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _frames(keys: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    for at in range(0, len(keys), FRAME):
        yield _pack(np.diff(keys[at:at + FRAME], prepend=0), counts[at:at + FRAME].astype(np.int64))


def _opened(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def merged(runs: list[Iterable[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of all runs in ascending order, every key once.

    The heap holds each run's open frame by its last key. When the run with the
    smallest last key opens its next frame, nothing up to that key can follow,
    so all that is held up to it is added up and given out.
    """
    heap: list[tuple[int, int]] = []
    sources = [iter(r) for r in runs]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def pull(i: int) -> None:
        frame = next(sources[i], None)
        if frame is not None:
            keys, counts = _opened(frame)
            held.append((keys, counts))
            heapq.heappush(heap, (int(keys[-1]), i))

    for i in range(len(sources)):
        pull(i)
    while heap:
        last, i = heapq.heappop(heap)
        ready, rest = [], []
        for keys, counts in held:
            k = int(np.searchsorted(keys, last, side="right"))
            if k:
                ready.append((keys[:k], counts[:k]))
            if k < len(keys):
                rest.append((keys[k:], counts[k:]))
        held[:] = rest
        yield _summed(np.concatenate([k for k, _ in ready]), np.concatenate([c for _, c in ready])) if ready else (
            np.zeros(0, np.int64), np.zeros(0, np.int64))
        pull(i)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(part, lot, runs) from rows sorted by part, lot, run, seq."""
    now, run, runs = None, None, []
    for batch in batches:
        for part, lot, own, frames in zip(*[batch.column(c).to_pylist() for c in ("part", "lot", "run", "frames")], strict=True):
            if (part, lot) != now:
                if now is not None:
                    yield *now, runs
                now, run, runs = (part, lot), None, []
            if own != run:
                run = own
                runs.append([])
            runs[-1] += frames
    if now is not None:
        yield *now, runs


RUN = "part int, run long, seq int, frames array<binary>"


def _rows(frames: Iterable[bytes], part: int, run: int) -> Iterator[pa.RecordBatch]:
    def row(seq: int, some: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([seq], pa.int32()),
                                           pa.array([some], pa.list_(pa.binary()))], names=["part", "run", "seq", "frames"])
    held, seq = [], 0
    for f in frames:
        held.append(f)
        if len(held) == FRAMES:
            yield row(seq, held)
            held, seq = [], seq + 1
    if held:
        yield row(seq, held)


def _dealt(runs: DataFrame, lots: int, round_no: int) -> DataFrame:
    lot = F.pmod(F.xxhash64("run", F.lit(round_no)), F.lit(lots))
    return (runs.select("part", lot.alias("lot"), "run", "seq", "frames").repartition(RADIX * lots, "part", "lot")
            .sortWithinPartitions("part", "lot", "run", "seq"))


def _merge_round(runs: DataFrame, lots: int, round_no: int) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lot, held in _grouped(batches):
            yield from _rows((f for k, c in merged(held) if len(k) for f in _frames(k, c)), part, lot)
    return materialize(_dealt(runs, lots, round_no).mapInArrow(merge, RUN), "pair-runs")


def _final(runs: DataFrame, round_no: int, folder: str) -> dict[int, tuple[str, int]]:
    """part -> (file, pairs): sorted keys, counts and whether a count is the
    highest of its first id. At most ``RADIX`` rows come to the driver."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, held in _grouped(batches):
            address = f"{folder}/part-{part}-{uuid.uuid4().hex}"
            n, keys, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            with open_output(address) as f:
                for k, c in chain(merged(held), [(None, None)]):
                    if k is not None:
                        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
                    if not len(keys):
                        continue
                    side = keys >> 28
                    to = len(keys) if k is None else int(np.searchsorted(side, side[-1]))  # the last id may go on
                    if not to:
                        continue
                    first = np.flatnonzero(np.r_[True, side[1:to] != side[:to - 1]])
                    most = np.repeat(np.maximum.reduceat(counts[:to], first), np.diff(np.r_[first, to]))
                    rows = np.stack([keys[:to], 2 * counts[:to] + (counts[:to] == most)], 1)
                    f.write(np.ascontiguousarray(rows).tobytes())
                    n += to
                    keys, counts = keys[to:], counts[to:]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([address]), pa.array([n], pa.int64())],
                                             names=["part", "file", "n"])
    told = _dealt(runs, 1, round_no).mapInArrow(write, "part int, file string, n long").collect()
    return {r["part"]: (r["file"], r["n"]) for r in told}


ENCODED = ("block long, doc int, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "part int, run long, seq int, frames array<binary>, docs binary")
_open: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    return _open[a_path, b_path]


def _encoded(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """Rows of documents (part null) and of runs (doc null)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = ENCODED.format(d.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        al = _aligner(a_path, b_path)
        number = (TaskContext.get().partitionId() << 32) - 1

        def table(n: int, **columns) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "doc": pa.int32(), "doc_id": id_type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                     "n_links": pa.int64(), "groups_sha256": pa.string(), "part": pa.int32(), "run": pa.int64(), "seq": pa.int32(),
                     "frames": pa.list_(pa.binary()), "docs": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else
                                               columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)
                                               for c, t in kinds.items()], names=list(kinds))

        for batch in batches:
            id_type = batch.schema.field(0).type
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                part = batch.slice(at, to - at)
                block = Block(al, part.column(1).take(pa.array(np.arange(part.num_rows))))
                number += 1
                n = part.num_rows
                yield table(n, block=np.full(n, number), doc=np.arange(n, dtype=np.int32), doc_id=part.column(0),
                            n_a=block.figures[0], n_b=block.figures[1], n_groups=block.figures[2], n_links=block.figures[3],
                            groups_sha256=block.digests)
                edge = np.searchsorted(block.keys, np.arange(RADIX + 1) << 56)
                upto = np.concatenate([[0], np.cumsum(block.counts)])
                for p in range(RADIX):
                    for seq, lo in enumerate(range(edge[p], edge[p + 1], FRAME * FRAMES)):
                        hi = min(lo + FRAME * FRAMES, edge[p + 1])
                        own = slice(upto[lo], upto[hi])
                        yield table(1, block=[number], part=[p], run=[number], seq=[seq],
                                    frames=[list(_frames(block.keys[lo:hi], block.counts[lo:hi]))],
                                    docs=[_pack(block.docs[own], block.mult[own])])
                at = to

    return d.mapInArrow(encode, schema)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``."""
    spark = docs.sparkSession
    both = materialize(_encoded(docs, a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model"),
                                doc_id, text), "aligned")
    told = both.where("part is null").select("block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    records = both.where("part is not null")
    runs, left, round_no = records.select("part", "run", "seq", "frames"), records.select("block").distinct().count(), 0
    while left > FAN_IN:
        left, round_no = -(-left // FAN_IN), round_no + 1
        runs = _merge_round(runs, left, round_no)
    files = _final(runs, round_no + 1, scratch_path(spark, f"pair-counts-{uuid.uuid4().hex}"))

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        open_part, keys, said = None, None, None
        for batch in batches:
            for block, part, frames, docs_of in zip(*[batch.column(c).to_pylist() for c in ("block", "part", "frames", "docs")], strict=True):
                if part != open_part:
                    file, n = files[part]
                    rows = map_file(file)[:16 * n].view(np.int64).reshape(-1, 2)
                    open_part, keys, said = part, np.ascontiguousarray(rows[:, 0]), rows[:, 1]
                k, c = zip(*map(_opened, frames), strict=True)
                found = said[np.searchsorted(keys, np.concatenate(k))]
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(docs_of), np.int32).reshape(2, -1)
                which, back = np.unique(raw[0], return_inverse=True)
                found = np.repeat(found, np.concatenate(c))
                best, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
                np.add.at(best, back, (found & 1) * raw[1])
                np.add.at(total, back, (found >> 1) * raw[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), block)), pa.array(which), pa.array(best), pa.array(total)],
                                                 names=["block", "doc", "n_best", "count_sum"])

    # runs of a part follow one another, so that a task opens few files
    dealt = records.select("block", "part", "frames", "docs").repartition(F.col("part"), F.pmod(F.xxhash64("block"), F.lit(64)))
    shares = dealt.sortWithinPartitions("part").mapInArrow(contribute, "block long, doc int, n_best long, count_sum long")
    of = shares.groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return told.join(of, ["block", "doc"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
