"""Alignment, embedding near-dedup and vector codes, against brute force."""

import hashlib
import math

import numpy as np
import pytest

from .conftest import _texts
from .test_text_operators import counted


# ---- operator 11 --------------------------------------------------------------

def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from roadpulse.llm.tokens import _byte_symbols, public_path
    a_side = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    byte = {s: i for i, s in enumerate(_byte_symbols())}
    held, docs = {}, []
    for i, t in rows:
        links, figures, groups = {}, (0, 0, 0, 0), []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            ab = [bytes(byte[c] for c in a_side.id_to_token(x)) for x in a]
            bb = [bytes([int(b_side.id_to_piece(x)[3:5], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode()
                  for x in b]
            raw = (" " + t).encode()
            if b"".join(ab) == raw == b"".join(bb):
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ab, bb)]
                before = 0
                for c in sorted(set(ends[0]) & set(ends[1])):
                    groups.append([[x for x, e in zip(ids, end, strict=True) if before < e <= c] for ids, end in zip((a, b), ends, strict=True)])
                    before = c
                for ga, gb in groups:
                    for x in ga:
                        for y in gb:
                            links[x, y] = links.get((x, y), 0) + 1
                figures = (len(a), len(b), len(groups), sum(links.values()))
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((i, figures, links, hashlib.sha256(told.encode()).hexdigest() if groups else ""))
        for pair in links:
            held[pair] = held.get(pair, 0) + 1
    most = {}
    for (x, _), c in held.items():
        most[x] = max(most.get(x, 0), c)
    return counted((i, *f, sum(m for p, m in links.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in links.items()), sha)
                   for i, f, links, sha in docs)


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    from roadpulse.llm import pairs
    if small:  # many blocks, frames, rows of frames and merge rounds
        for name, value in (("BLOCK_BYTES", 300), ("FRAME", 4), ("FRAMES", 2), ("FAN_IN", 2), ("LINKS", 7)):
            monkeypatch.setattr(pairs, name, value)
    texts = [t if t is None or len(t) < 3000 else t[:3000] for t in _texts()]
    texts += ["x\x00y z\x00 w", "a▁b", "trail  ", " lead", "nb  sp", "　 a", "don't 'll", " ", "\n \n x", "1 2  3   4    5", "q" * 3000]
    rows = [*enumerate(texts), (3, texts[3]), (None, None), (None, texts[5])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, part string, block long").repartition(3)
    got = pairs.align(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert counted(map(tuple, got.collect())) == aligned(rows)
    assert pairs.align(df.limit(0)).count() == 0


def test_runs_merge_in_order():
    from roadpulse.llm import pairs
    rng = np.random.default_rng(3)
    runs, want = [], {}
    for _ in range(9):
        keys = np.unique(rng.integers(0, 500, rng.integers(0, 200)))
        counts = rng.integers(1, 9, len(keys))
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] = want.get(k, 0) + c
        runs.append([pairs._pack(np.diff(keys[i:i + 7], prepend=0), counts[i:i + 7]) for i in range(0, len(keys), 7)])
    got = [(k, c) for ks, cs in pairs.merged(runs) for k, c in zip(ks.tolist(), cs.tolist(), strict=True)]
    assert got == sorted(want.items())


# ---- operator 12 --------------------------------------------------------------

AWKWARD = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] + [1.0] * 15, 1), (1003, [math.inf] + [1.0] * 15, 1),
           (1004, [None] + [1.0] * 15, 1), (1005, [1.0] * 16, None), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1),
           (None, None, None), (None, [3.0] * 16, 2), (1009, [6.0] * 16, 2), (1010, [1e38] * 16, 2)]


def vector_rows(rng, spread=0.08, size=40):
    """Random vectors, groups of near copies around the threshold, equal vectors."""
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 2)) for i in range(150)]
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((len(rows), (centre + spread * (c + 1) * rng.standard_normal(16)).tolist(), c % 2))
    rows += [(2000 + k, rows[200][1], rows[200][2]) for k in range(5)] + [(r, rows[7][1], 1 - rows[7][2]) for r in (3000, 3000)]
    return [*rows, *AWKWARD, rows[3], rows[3]]


def linked_vectors(rows, threshold=0.93):
    good = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n, label = np.zeros(len(rows), int), np.arange(len(rows))
    for lab, size in {(lab, len(v)) for (_, v, lab), g in zip(rows, good, strict=True) if g}:
        own = np.array([a for a, (_, v, x) in enumerate(rows) if good[a] and x == lab and len(v) == size])
        x = np.array([rows[a][1] for a in own])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for k, a in enumerate(own):
            to = own[(x @ x[k] >= threshold) & (own != a)]
            n[a] = len(to)
            for old in np.unique(label[to]):
                label[label == old] = label[a]
    n, label = n.tolist(), label.tolist()
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[label[a]] = min(least.get(label[a], i), i)
    return [(rows[a][0], n[a], least.get(label[a]), rows[a][0] == least.get(label[a])) for a in range(len(rows))]


VECTORS = "vec_id long, embedding array<double>, label int, node string, g string"


@pytest.mark.parametrize("block", [4096, 32])
def test_near_vectors_whole_labels(spark, block):
    from roadpulse.llm.projectionforest import near_vectors
    rows = vector_rows(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    assert counted(map(tuple, near_vectors(df, block=block).collect())) == counted(linked_vectors(rows))
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_a_forest(spark):
    """Leaves of 32 vectors: nothing below the threshold is linked, few links are lost, next to none well above it."""
    from roadpulse.llm.projectionforest import near_vectors
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist(), 0) for i in range(800)]
    near = {0.932: [], 0.97: []}
    for cos, ids in near.items():
        for k in range(150):
            x = np.array(rows[k][1])
            x /= np.linalg.norm(x)
            y = rng.standard_normal(64)
            y -= y @ x * x
            ids.append((k, len(rows)))
            rows.append((len(rows), (cos * x + math.sqrt(1 - cos * cos) * y / np.linalg.norm(y)).tolist(), 0))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    got = {r["vec_id"]: r for r in near_vectors(df, leaf=32).collect()}
    want = {r[0]: r for r in linked_vectors(rows)}
    assert all(got[i]["n_links"] <= w[1] for i, w in want.items())
    found = {cos: sum(got[b]["n_links"] > 0 for _, b in ids) / len(ids) for cos, ids in near.items()}
    assert found[0.932] >= 0.9 and found[0.97] >= 0.99, found


@pytest.mark.parametrize("spread", [0.02, 0.06])
def test_dense_leaves_are_counted_whole(spark, spread):
    """A group of near copies that no split parts: cores and blocks give every link, once."""
    from roadpulse.llm.projectionforest import forest, near_vectors
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    centre /= np.linalg.norm(centre)
    rows = [(i, (centre + spread * rng.standard_normal(16)).tolist(), 0) for i in range(300)]
    rows += [(i + 300, r[1], 0) for i, r in enumerate(rows[:20])] + [(i, rng.standard_normal(16).tolist(), 0) for i in range(400, 440)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    distinct = df.dropDuplicates(["embedding"]).selectExpr("vec_id as node", "'0' as g", "embedding as x")
    _, dense = forest(distinct, 0.93, 4, 64, 0.5)
    assert dense.agg({"n": "max"}).first()[0] > 150
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, leaf=64, block=50).collect()}
    want = {i: (n, c) for i, n, c, _ in linked_vectors(rows)}
    lost = sum(w[0] - got[i][0] for i, w in want.items())
    assert all(got[i][0] <= w[0] for i, w in want.items())
    assert lost <= (0 if spread < 0.05 else 0.02 * sum(w[0] for w in want.values()))
    assert sum(got[i][1] == w[1] for i, w in want.items()) >= 0.99 * len(want)


# ---- operator 13 --------------------------------------------------------------

def codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[tuple(q[p * width:(p + 1) * width]) for p in range(parts)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, now, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    now = assigned()
    error = [sum(d for d, _ in a) for a in now]
    by_label = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return counted((i, "".join(f"{k:02x}" for _, k in a), e, by_label[lab], sha) for (i, _, lab), a, e in zip(kept, now, error, strict=True))


@pytest.mark.parametrize("rounds", [2, 6])
def test_vector_codes(spark, rounds):
    from roadpulse.llm.vectorcodes import code_report
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-3, 4, 32) / 200).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(300)]  # many ties
    rows += [(None, rows[5][1], 1), rows[5], (7, rows[9][1], 4), (999, None, 1), (998, [math.nan] * 32, 1), (997, [math.inf] * 32, 1),
             (996, [None] * 32, 1), (995, [0.5] * 3, 1), (994, [], 1), (993, [-1000.25] * 32, 5)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = code_report(df, rounds=rounds)
    assert counted(map(tuple, got.collect())) == codes(rows, rounds=rounds)
    few = df.where("vec_id < 10")
    assert counted(map(tuple, code_report(few).collect())) == codes([r for r in rows if r[0] is not None and r[0] < 10])
    assert code_report(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="exact distances"):
        code_report(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_active_entries_equal_whole_scans():
    from roadpulse.llm.vectorcodes import assign, nearest
    rng = np.random.default_rng(8)
    x, book = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (20, 3))
    code, dist = nearest(x, book, np.arange(20))
    for _ in range(10):
        moved = rng.random(20) < 0.3
        book = np.where(moved[:, None], rng.integers(-4, 5, (20, 3)), book)
        code, dist = assign(x, book, moved, code, dist)
        k, d = nearest(x, book, np.arange(20))
        assert (k == code).all() and (d == dist).all()
