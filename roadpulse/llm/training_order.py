"""Training-order materialisation (operator 3).

Texts are tokenised and laid end to end (an end token after each) within
blocks of documents; every ``stride`` tokens of a block are one sequence, the
last one of a block is padded. A keyed Feistel network permutes the sequence
numbers 0..N-1: it works on the smallest even number of bits that holds N, and
numbers that fall outside are walked along their cycle until they are inside.
So each sequence has its slot in training order from its number, the key and N
alone; no table of random numbers, sort or driver is needed, and the order can
be reproduced.

Slots are cut into ranges; each range goes to one task by its number, and that
task writes it as one file: a shard of ``slots`` records of ``stride`` unsigned
16 or 32-bit ids at fixed places. Record s of the order is at byte (s mod slots) * stride * width of shard
s div slots: a reader resumes anywhere by that arithmetic and reads on.

A shard is written under a name of its own attempt and only listed once its
task has ended, so a lost executor leaves no half shard behind that is read.

Defined results: a null or empty text is its end token; repeated rows are
texts of their own; an empty table gives no sequences and no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import scratch_path

from .common import materialize
from .files import open_output, read_range
from .tokens import public_path, tokenizer

STRIDE = 2048
SLOTS = 4096  # records in a shard: 16 MB at two bytes an id
KEY = 20_240_601
ROUNDS = 6
END = 1
PAD = 0
TEXTS = 4000  # of a block


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of public domain (multiply and fold twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> bits, out[todo] & low
            for r in range(rounds):
                told = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
                left, right = right, left ^ (_mixed(right + told) & low)
            out[todo] = (left << bits) | right
            todo = todo[out[todo] >= n]  # walk on along the cycle
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
              stride: int = STRIDE, end: int = END) -> DataFrame:
    """Per sequence: block, nth, ids (compressed), parts: what it holds of which
    document (doc_id, start in the document, offset in the sequence, length)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    id_type = docs.select(F.col(doc_id).alias("doc_id"))
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    part = pa.struct([("doc_id", id_type), ("start", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pack = tokenizer(tokenizer_path), zstandard.ZstdCompressor(3)
        width = "<u2" if tok.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts = batch.slice(at, TEXTS)
                ids, offsets = tok.encode(texts.column(2))
                flat = np.insert(ids, offsets[1:], end).astype(width)
                begin = offsets + np.arange(len(offsets))  # of each text in ``flat``
                owner = texts.column(1).to_pylist()
                n = -(-len(flat) // stride)
                blobs, parts = [], []
                for s in range(n):
                    a, b = s * stride, min((s + 1) * stride, len(flat))
                    blobs.append(pack.compress(flat[a:b].tobytes()))
                    i, own = int(np.searchsorted(begin, a, side="right")) - 1, []
                    while i < len(owner) and begin[i] < b:
                        lo, hi = max(a, int(begin[i])), min(b, int(begin[i + 1]))
                        own.append({"doc_id": owner[i], "start": lo - int(begin[i]), "offset": lo - a, "length": hi - lo})
                        i += 1
                    parts.append(own)
                block = texts.column(0)[0].as_py()  # the first row's id names the block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(blobs, pa.binary()),
                     pa.array(parts, pa.list_(part))], names=["block", "nth", "ids", "parts"])

    d = docs.select(F.monotonically_increasing_id().alias("row"),
                    F.col(doc_id).cast("string" if id_type == pa.string() else kind).alias("doc_id"),
                    F.col(text).cast("string").alias("text"))
    sql = "string" if id_type == pa.string() else kind
    return d.mapInArrow(chunked, f"block long, nth long, ids binary, parts "
                                 f"array<struct<doc_id:{sql},start:bigint,offset:int,length:int>>")


def _numbered(seqs: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``number``: the blocks laid end to end. One count per block is
    summed up by a window over bounded runs of blocks."""
    from pyspark.sql import Window
    blocks = seqs.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    # the upper bits of a row id are the partition it was read in
    blocks = blocks.withColumn("part", F.shiftright("block", 33))
    parts = blocks.groupBy("part").agg(F.sum("m").alias("pm"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pm").over(ahead), F.lit(0)).alias("before"), "pm")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("own", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(parts, "part")
    # one row a block, written, so that its size is known: it is broadcast if it
    # is small, and the sequences are not shuffled to find their number
    first = materialize(first.select("block", (F.col("own") + F.col("before")).alias("first")), "block-starts")
    n = seqs.count()
    return seqs.join(first, "block").withColumn("number", F.col("first") + F.col("nth")), n


def write_order(docs: DataFrame, folder: str, tokenizer_path: str | None = None, doc_id: str = "doc_id",
                text: str = "text", stride: int = STRIDE, slots: int = SLOTS, key: int = KEY,
                end: int = END) -> DataFrame:
    """Write the shards into ``folder`` (any place pyarrow's file systems reach
    from all executors). One row per part of a sequence: slot, shard, path,
    record_offset, n_tokens, ids_crc32 (of the record's ids), doc_id, start,
    offset, length."""
    path = tokenizer_path or public_path("word_bpe_49k.json")
    seqs = materialize(sequences(docs, path, doc_id, text, stride, end), "sequences")
    numbered, n = _numbered(seqs)
    import json
    with open(path) as f:
        told = json.load(f)
    ids = max([*told["model"]["vocab"].values(), *[a["id"] for a in told["added_tokens"]]])
    width = "<u2" if ids < 1 << 16 else "<u4"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = feistel(b.column("number").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // slots), b.column("ids"), b.column("parts")],
                                             names=["slot", "shard", "ids", "parts"])

    parts = seqs.schema["parts"].dataType.simpleString()
    order = numbered.select("number", "ids", "parts").mapInArrow(
        placed, f"slot long, shard long, ids binary, parts {parts}")
    shards = max(1, -(-n // slots))
    order = order.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out, now, name = zstandard.ZstdDecompressor(), None, None, ""
        for b in batches:
            crc, count, names = [], [], []
            for shard, slot, blob in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(),
                                         b.column("ids").to_pylist(), strict=True):
                if shard != now:
                    if out:
                        out.close()
                    name, now = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.bin", shard
                    out = open_output(name)
                own = np.frombuffer(unpack.decompress(blob), width)
                out.write(own.tobytes() + np.full(stride - len(own), PAD, width).tobytes())
                crc.append(zlib.crc32(own.tobytes()))
                count.append(len(own))
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [b.column("slot"), b.column("shard"), pa.array(names, pa.string()), pa.array(count, pa.int32()),
                 pa.array(crc, pa.int64()), b.column("parts")], names=["slot", "shard", "path", "n_tokens", "ids_crc32", "parts"])
        if out:
            out.close()

    listed = materialize(order.mapInArrow(
        written, f"slot long, shard long, path string, n_tokens int, ids_crc32 long, parts {parts}"), "order")
    size = stride * np.dtype(width).itemsize
    return listed.withColumn("record_offset", F.col("slot") % slots * size).select(
        "slot", "shard", "path", "record_offset", "n_tokens", "ids_crc32", F.explode("parts").alias("part")).select(
        "slot", "shard", "path", "record_offset", "n_tokens", "ids_crc32", "part.*")


def read_record(path: str, record_offset: int, n_tokens: int, width: str = "<u2") -> np.ndarray:
    """The ids of one record, read by its place alone."""
    return np.frombuffer(read_range(path, record_offset, n_tokens * np.dtype(width).itemsize), width)


def training_order(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``write_order`` into a folder of its own beside the checkpoints."""
    return write_order(docs, scratch_path(spark, f"order-{uuid.uuid4().hex}"), **options)
