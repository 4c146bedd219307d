"""Operators that link, place or write rows, against brute force and round trips."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from .test_text_operators import counted, rows_of


# ---- operator 4 ---------------------------------------------------------------

def simhash(t, n=3):
    import xxhash
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, prints, distance=3):
    label = list(range(len(ids)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                label[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [least.get(find(a)) for a in range(len(ids))]


def test_golay_code_is_perfect_and_keys_cover():
    from roadpulse.llm import golay
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    nearest = golay.codeword(words)
    _, _, error = golay._tables()
    assert len(set(error.tolist())) == 2048 and np.bitwise_count(error).max() == 3
    assert nearest.max() < 4096
    row, _ = golay.fuzzy(words, 23)
    assert set(np.bincount(row).tolist()) <= {1, 6}
    x = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    for errors in (1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, errors, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        keys = [set(zip(*map(np.ndarray.tolist, golay.fuzzy_keys(z)), strict=True)) for z in (x, y)]
        assert {r for r, _ in keys[0] & keys[1]} == set(range(len(x)))


def test_links_connect_all_within_distance(monkeypatch):
    from roadpulse.llm import golay
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64)) for c in centres]))
    want = linked(list(range(len(x))), [int(v) for v in x])
    for wide, deep in ((16, 20_000), (2, 20_000), (2, 4)):
        monkeypatch.setattr(golay, "WIDE", wide)
        monkeypatch.setattr(golay, "DEEP", deep)
        u, v = golay.links(np.zeros(len(x), np.int64), x)
        assert (np.bitwise_count(u ^ v) <= 3).all()
        place = {int(f): i for i, f in enumerate(x)}
        label = list(range(len(x)))
        for _ in range(len(x)):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                label[place[a]] = label[place[b]] = min(label[place[a]], label[place[b]])
        assert label == want


def test_simhash_near_dedup(awkward, nothing):
    from roadpulse.llm.golay import near_duplicates, one_of_each
    rows = rows_of(awkward)
    prints = [simhash(t) for _, t in rows]
    group = linked([i for i, _ in rows], prints)
    got = near_duplicates(awkward).collect()
    assert counted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == counted(
        (i, p, g) for (i, _), p, g in zip(rows, prints, group, strict=True))
    kept = one_of_each(awkward)
    assert kept.schema.names == awkward.schema.names
    have = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in have if x is not None) == sorted({g for g in group if g is not None})
    assert near_duplicates(nothing).count() == 0 and one_of_each(nothing).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    """Components are told apart by themselves, whatever their ids are."""
    from roadpulse.llm.golay import one_of_each
    texts = [" ".join(f"{topic}{i * i % 89}" for i in range(300)) for topic in ("road", "bread", "music")]
    near = texts[2].replace("music49 ", "other ", 1)
    prints = [simhash(t) for t in (*texts, near)]
    assert len(set(prints)) == 4 and (prints[2] ^ prints[3]).bit_count() <= 3
    assert all((prints[a] ^ prints[b]).bit_count() > 3 for a in range(3) for b in range(a))
    rows = [(1, texts[0]), (7, texts[0]), (1, texts[1]), (8, texts[1]), (None, texts[2]), (None, near), (None, near)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    have = sorted((r["doc_id"] or 0, texts.index(r["text"]) if r["text"] in texts else 2) for r in kept.collect())
    assert have == [(0, 2), (1, 0), (1, 1)]


def test_components(spark):
    from roadpulse.llm.components import components
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- operator 5 ---------------------------------------------------------------

PAGES = [(3, "http://b/x", "<p>same</p>"), (1, "http://a/\r\nEvil: 1", "<p>same</p>"), (1, "http://a", "<p>same</p>"), (2, None, "é" * 5000),
         (4, "http://c", None), (5, "http://d", ""), (None, "http://e", "<p>same</p>"), (6, "http://f", "line\r\n\r\nWARC/1.1\r\n" * 50),
         (None, "http://g", "alone"), (None, "http://h", "alone"), (7, "http://i", "x" * 300_000)]


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, tmp_path, monkeypatch, zip64):
    from roadpulse.llm import ziparchive
    monkeypatch.setattr(ziparchive, "MEMBER_BYTES", 300)
    monkeypatch.setattr(ziparchive, "ARCHIVE_BYTES", 700)
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, payload string, n string")
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        b, first = (h or "").encode(), least.get(h or "")
        again = first is not None and i != first
        want.append((None if i is None else str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                     "revisit" if again else "response", str(first) if again else None, None if again else b))
    # a payload that only has null ids is a response each time
    listed = ziparchive.write_archives(pages, f"file://{tmp_path}/a", zip64=zip64)
    assert listed.count() > 1 and sum(r["n_records"] for r in listed.collect()) == len(PAGES)
    got = [(r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
            None if r["payload"] is None else bytes(r["payload"])) for r in ziparchive.read_archives(listed).collect()]
    assert counted(got) == counted(want)
    empty = ziparchive.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert empty.count() == 0 and ziparchive.read_archives(empty).count() == 0


def test_zip_files_are_ordinary_ones(tmp_path):
    """Other tools read what is written here, and the other way round."""
    import zipfile

    from roadpulse.llm.files import open_input, open_output
    from roadpulse.llm.ziparchive import ZipWriter, directory, member_bytes
    for zip64 in (False, True):
        path = f"file://{tmp_path}/w{zip64}.zip"
        z = ZipWriter(open_output(path), zip64)
        z.add("a/é.txt", b"abc" * 100)
        z.add("b", b"")
        z.close()
        with zipfile.ZipFile(path[7:]) as other:
            assert other.testzip() is None and other.read("a/é.txt") == b"abc" * 100 and other.namelist() == ["a/é.txt", "b"]
        with open_input(path) as f:
            members = directory(f)
            assert member_bytes(f, members["a/é.txt"]) == b"abc" * 100 and member_bytes(f, members["b"]) == b""
    path = f"{tmp_path}/other.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as other:
        other.writestr("indexes/x", b"deflated " * 500)
        with other.open(zipfile.ZipInfo("stored"), "w", force_zip64=True) as f:
            f.write(b"plain")
        other.comment = b"PK\x05\x06 a comment with the mark of an end in it, longer than such a record is"
    with open_input(f"file://{path}") as f:
        members = directory(f)
        assert member_bytes(f, members["indexes/x"]) == b"deflated " * 500 and member_bytes(f, members["stored"]) == b"plain"


# ---- operator 7 ---------------------------------------------------------------

def test_balanced_propagation(spark, awkward, nothing):
    from roadpulse.llm.propagation import shard_documents
    for df in (awkward, awkward.unionAll(awkward).unionAll(awkward.limit(5))):
        rows = rows_of(df)
        got = shard_documents(df).collect()
        told = counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == told
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        sizes = [len(by[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert shard_documents(nothing).count() == 0


def test_propagation_gathers_groups(spark):
    from roadpulse.llm.propagation import propagate
    # 400 nodes: a group of 150 (more than a shard holds), 60 pairs, the rest free
    group = [(i, 0) for i in range(150)] + [(150 + i, 1 + i // 2) for i in range(120)]
    nodes = spark.range(400).withColumnRenamed("id", "node")
    labels = {r["node"]: r["shard"] for r in propagate(nodes, spark.createDataFrame(group, "node long, group long"), 8, 8).collect()}
    sizes = collections.Counter(labels.values())
    assert set(sizes.values()) == {50}
    assert max(collections.Counter(labels[i] for i in range(150)).values()) >= 45  # one shard is almost all of the large group's
    cut = sum(labels[150 + 2 * i] != labels[151 + 2 * i] for i in range(60))
    assert cut <= 6  # at random, 52 of the 60 pairs would be cut


def test_propagation_fills_several_shards_with_a_large_group(spark):
    from roadpulse.llm.propagation import propagate
    # a third of all rows on shards of 75 each: two whole shards and two thirds of another
    nodes = spark.range(600).withColumnRenamed("id", "node")
    group = [(i, 0) for i in range(200)]
    found = propagate(nodes, spark.createDataFrame(group, "node long, group long")).collect()
    assert set(collections.Counter(r["shard"] for r in found).values()) == {75}
    held = sorted(collections.Counter(r["shard"] for r in found if r["node"] < 200).values(), reverse=True)
    assert held == [75, 75, 50]


# ---- operators 9 and 3 --------------------------------------------------------

def encoded(texts):
    from roadpulse.llm.tokens import public_path
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_token_ids_are_the_tokenizers_own(spark):
    from roadpulse.llm.tokens import WordTokenizer, public_path
    texts = [None, "", " ", "a<|endoftext|>b c", "It's WE'LL don't 'sad ÉcoleΣΑΣ ǅ İx 12a3 ½ x\x1cz", "é ́x ﬁ ẞ ŉ ſ Ÿ ÷×",
             "日本語 テ!!??’s", "a​b \u0085 c… don''t 'S 'Re"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts += [r["text"] for r in docs.select("text").collect()]
    ids, at = WordTokenizer(public_path("word_bpe_49k.json")).encode(pa.array(texts))
    for k, want in enumerate(encoded(texts)):
        assert ids[at[k]:at[k + 1]].tolist() == want[:-1], texts[k]


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(awkward, nothing, capacity):
    from roadpulse.llm.packing import pack
    rows = rows_of(awkward)
    want, total = [], 0
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        total += len(ids)
        for k in range(0, len(ids), capacity):
            own = ids[k:k + capacity]
            want.append((i, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = pack(awkward, capacity=capacity).collect()
    assert counted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == counted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-total // capacity) * 1.05 + 1
    if capacity == 4096:
        assert pack(nothing).count() == 0


def test_plan_is_best_fit():
    import random

    from roadpulse.llm.packing import plan
    rnd = random.Random(1)
    for _ in range(40):
        counts = collections.Counter(rnd.randint(1, 100) if rnd.random() < 0.5 else rnd.choice([34, 50, 51, 66, 100, 7]) for _ in range(300))
        bins, placed = collections.defaultdict(list), collections.Counter()
        for n, a, b, first, per, offset in plan(counts, 100):
            placed[n] += b - a
            for r in range(b - a):
                bins[first + r // per].append((offset + r % per * n, n))
        assert placed == counts
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 100 and sum(3 * n > 100 for _, n in own) <= 2
        # first-fit decreasing, item by item, needs about as many
        loads = []
        for n in sorted(counts.elements(), reverse=True):
            k = next((i for i, x in enumerate(loads) if x + n <= 100), None)
            if k is None:
                loads.append(n)
            else:
                loads[k] += n
        assert len(bins) <= len(loads) + 1


def test_feistel_is_a_permutation():
    from roadpulse.llm.training_order import feistel
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        got = feistel(np.arange(n), n)
        assert sorted(got.tolist()) == list(range(n))
    assert feistel(np.arange(1000), 1000, key=1).tolist() != feistel(np.arange(1000), 1000, key=2).tolist()
    assert np.corrcoef(np.arange(4097), feistel(np.arange(4097), 4097))[0, 1] < 0.1


def test_training_order(spark, awkward, nothing, tmp_path):
    from roadpulse.llm.training_order import read_record, write_order
    rows = rows_of(awkward)
    got = write_order(awkward, f"file://{tmp_path}/o", stride=128, slots=16).collect()
    slots = sorted({r["slot"] for r in got})
    assert slots == list(range(len(slots))) and all(r["shard"] == r["slot"] // 16 for r in got)
    assert len(slots) > 32 and len({r["path"] for r in got}) == len({r["shard"] for r in got})  # one file a shard
    texts, pieces = collections.Counter(), {}
    for r in got:
        assert r["record_offset"] == r["slot"] % 16 * 128 * 2
        ids = read_record(r["path"], r["record_offset"], r["n_tokens"])
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) <= 128
        pieces.setdefault((r["slot"], r["offset"]), (r["doc_id"], r["start"], ids[r["offset"]:r["offset"] + r["length"]].tolist()))
    assert sum(len(p) for _, _, p in pieces.values()) == sum(map(len, encoded([t for _, t in rows])))
    by = collections.defaultdict(list)
    for i, start, ids in pieces.values():
        by[i].append((start, ids))
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        if sum(i == j for j, _ in rows) == 1:
            assert [x for _, p in sorted(by[i]) for x in p] == ids
    assert write_order(nothing, f"file://{tmp_path}/e").count() == 0
    del texts


# ---- the pipeline ---------------------------------------------------------------

def test_pipeline(spark, awkward, nothing, tmp_path):
    """Every stage against what its operator's own report says, chained."""
    import corpus_pipeline as p
    from roadpulse.llm.golay import near_duplicates
    from roadpulse.llm.winnowing import decontamination_report
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].schema.names == docs.schema.names
    ids = [{r["doc_id"] for r in d.collect()} for d in seen]
    assert ids[2] == {r["component_id"] for r in near_duplicates(seen[1]).collect()}
    assert ids[3] == ids[2]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ids[4] == {r["doc_id"] for r in decontamination_report(seen[3], benchmark).where("not contaminated").collect()}
    assert ids[5] == ids[4] < ids[3]
    whole = p.run(spark, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert counted(map(tuple, whole.select(columns).collect())) == counted(map(tuple, seen[5].select(columns).collect()))
    lengths = {r["doc_id"]: r["n_chars"] for r in seen[3].select("doc_id", "n_chars").collect()}
    assert lengths == {r["doc_id"]: r["n"] for r in seen[3].select("doc_id", F.length("text").alias("n")).collect()}
    for _, stage in p.STAGES:  # awkward rows and an empty table pass every stage
        for d in (awkward, nothing):
            stage(spark, d, sf).count()
