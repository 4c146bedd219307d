"""Operators on texts against brute force, on a table of awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return collections.Counter(rows)


# ---- operator 8 ---------------------------------------------------------------

def measures(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    win = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_measures(awkward, nothing):
    from roadpulse.llm.quality import quality_verdicts
    got = quality_verdicts(awkward)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = []
    for i, t in rows_of(awkward):
        m = measures(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert counted(map(tuple, got.select(columns).collect())) == counted(want)
    assert quality_verdicts(nothing).count() == 0


def test_host_rates_are_shrunk(spark):
    from roadpulse.llm.quality import host_verdicts, kept_documents, quality_verdicts
    good = "word%d another thing that is a sentence of more than twenty words in all so that it passes the base rule of the method here"
    rows = [(i, good % i, "clean") for i in range(40)] + [(100 + i, "short", "bad") for i in range(60)]
    rows += [(200 + i, good % i, "bad") for i in range(3)] + [(300, "short", "tiny"), (301, None, None), (302, good % 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = quality_verdicts(docs)
    hosts = {r["host"]: r for r in host_verdicts(judged.drop("host_bad", "kept")).collect()}
    assert hosts["bad"]["host_bad"] and not hosts["clean"]["host_bad"]
    assert hosts["tiny"]["rate_base"] < 1.0 and hosts["bad"]["rate_base"] < 60 / 63
    kept = {r["doc_id"] for r in kept_documents(docs).collect()}
    assert kept == {r["doc_id"] for r in judged.where("kept").collect()} == set(range(40)) | {302}


def test_host_that_only_the_line_rule_rejects(spark):
    from roadpulse.llm.quality import quality_verdicts
    own = "word%d another thing that is a sentence of more than twenty words in all so that it passes the base rule of the method here"
    rows = [(i, own % i, f"clean{i % 4}") for i in range(80)]
    # two repeats among five lines of a document, none of them long enough to be a repeated window of words
    rows += [(100 + i, "menu\n" + own % i + "\nhome page\nmenu\nhome page", "menus") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_verdicts(docs)
    assert {r["host"] for r in got.where("host_bad").collect()} == {"menus"}
    assert got.where("base_failed or symbols_failed").count() == 0
    assert {r["doc_id"] for r in got.where("kept").collect()} == set(range(80))


def test_sampling_noise_is_no_spread(spark):
    """Hosts of three documents whose failures differ by chance alone stay near the corpus rate."""
    from roadpulse.llm.quality import host_verdicts
    failures = [2] + [1] * 8 + [0] * 21
    rows = [(f"h{h}", i < f, False, False) for h, f in enumerate(failures) for i in range(3)]
    judged = spark.createDataFrame(rows, "host string, base_failed boolean, symbols_failed boolean, lines_failed boolean")
    rates = {r["host"]: r["rate_base"] for r in host_verdicts(judged).collect()}
    assert abs(rates["h0"] - 10 / 90) < 0.01 and not host_verdicts(judged).where("host_bad").count()


def test_quality_keeps_columns(awkward, nothing):
    from roadpulse.llm.quality import kept_documents, quality_verdicts
    kept = kept_documents(awkward)
    assert kept.schema.names == awkward.schema.names
    want = quality_verdicts(awkward).where("kept").select("doc_id")
    assert counted(r["doc_id"] for r in kept.collect()) == counted(r["doc_id"] for r in want.collect())
    assert kept_documents(nothing).count() == 0


# ---- operator 6 ---------------------------------------------------------------

def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) if w]


def contamination(t, items):
    w, hit, found = words(t), set(), set()
    for item, text in items:
        v = words(text)
        n = min(10, len(v))
        spans = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in spans:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), ",".join(sorted(found))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(awkward, nothing, items, monkeypatch, limit):
    """By broadcast and, beyond the bound, by shuffle."""
    from roadpulse.llm import winnowing
    monkeypatch.setattr(winnowing, "_small", lambda df, n=0: F.broadcast(df) if limit else df)
    told = [(r["item_id"], r["text"]) for r in items.collect()]
    got = winnowing.decontamination_report(awkward, items)
    want = []
    for i, t in rows_of(awkward):
        m = contamination(t, told)
        want.append((i, *m, m[1] > 0))
    have = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in got.collect()]
    assert counted(have) == counted(want)
    assert sum(x[5] for x in have) >= 8
    if limit:
        clean = winnowing.clean_documents(awkward, items)
        assert clean.schema.names == awkward.schema.names
        assert counted(r["doc_id"] for r in clean.collect()) == counted(x[0] for x in have if not x[5])
        assert winnowing.decontamination_report(nothing, items).count() == 0
        assert winnowing.clean_documents(awkward, items.limit(0)).count() == awkward.count()


def test_items_without_id_contaminate(spark, tmp_path):
    import corpus_pipeline
    import duckdb

    from roadpulse.llm.queries import OP6_SQL, op6
    text = " ".join(f"word{i}" for i in range(40))
    docs = [(1, text), (2, "not a word of it"), (3, "x " + text + " and tail end")]
    spans = [(None, " ".join(text.split()[3:17])), (None, " ".join(text.split()[5:20])), (4, "and tail end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(spans, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = db.sql(OP6_SQL).fetchall()
    assert counted(map(tuple, op6(spark, str(tmp_path)).collect())) == counted(want)
    assert {r[0]: r[2:4] for r in want} == {1: (17, 1), 2: (0, 0), 3: (20, 2)}
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, read, str(tmp_path))
    assert [r["doc_id"] for r in clean.collect()] == [2]


# ---- operator 10 --------------------------------------------------------------

def line_dedup(rows, min_words=5, min_run=20):
    """(doc_id, lines, text left, spans) per row, unit by unit."""
    docs = {(i is None, i or 0, hashlib.md5((t or "").encode()).digest()): (i, t or "") for i, t in rows}
    units = []  # (digest, place, words)
    for d, (_, t) in docs.items():
        for k, line in enumerate(t.split("\n")):
            w = line.encode().lower().split()
            if len(w) >= min_words:
                units.append((("L", *w), (d, k, -1)))
            for j, s in enumerate(re.findall("[^.!?]+[.!?]*|[.!?]+", line)):
                w = s.encode().lower().split()
                if w:
                    units.append((("S", *w), (d, k, j)))
    first = {}
    for u, p in sorted(units, key=lambda x: x[1]):
        first.setdefault(u, p)
    again = {p: len(u) - 1 for u, p in units if first[u] != p}
    out = {}
    for d, (i, t) in docs.items():
        lines, order, at = t.split("\n"), [], 0
        pieces = {}
        for k, line in enumerate(lines):
            begin = at
            pieces[k] = []
            for j, s in enumerate(re.findall("[^.!?]+[.!?]*|[.!?]+", line)):
                pieces[k].append((s, begin))
                if s.encode().split():
                    order.append((k, j))
                begin += len(s)
            at += len(line) + 1
        cut, run = set(), []
        for place in [*order, None]:
            if place is not None and (d, *place) in again:
                run.append(place)
            else:
                if sum(again[(d, *p)] for p in run) >= min_run:
                    cut |= set(run)
                run = []
        left, spans, at = [], [], 0
        for k, line in enumerate(lines):
            own = {j for kk, j in cut if kk == k}
            if (d, k, -1) in again:
                spans.append((at, at + len(line)))
            elif own:
                spans += [(b, b + len(s)) for j, (s, b) in enumerate(pieces[k]) if j in own]
                rest = "".join(s for j, (s, _) in enumerate(pieces[k]) if j not in own).strip(" \t\r\x0b\x0c")
                left += [rest] if rest else []
            else:
                left.append(line)
            at += len(line) + 1
        joined = []
        for a, b in spans:
            joined = [*joined[:-1], (joined[-1][0], b)] if joined and joined[-1][1] == a else [*joined, (a, b)]
        out[d] = (i, len(lines) if t else 0, "\n".join(left), tuple(joined))
    return [out[i is None, i or 0, hashlib.md5((t or "").encode()).digest()] for i, t in rows]


@pytest.mark.parametrize("batch", [1000, 3])
def test_line_dedup(awkward, nothing, monkeypatch, batch):
    from roadpulse.llm import lines
    monkeypatch.setattr(lines, "TEXTS", batch)
    want = line_dedup(rows_of(awkward))
    got = lines.dedup_report(awkward).collect()
    have = [(r["doc_id"], r["n_units"], r["text"], tuple((s["start"], s["end"]) for s in r["removed_spans"])) for r in got]
    assert counted(have) == counted(want)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed_spans"]) for r in got)
    # a passage inside a line that differs elsewhere goes, its surroundings stay
    inside = next(r for r in got if r["doc_id"] == 30)
    assert 0 < len(inside["text"].split()) <= 30 and inside["removed_spans"]
    if batch == 3:
        kept = lines.deduplicated_documents(awkward, length_column="n_chars")
        assert kept.schema.names == awkward.schema.names and kept.count() == awkward.count()
        assert counted((r["doc_id"], r["text"] or "") for r in kept.collect()) == counted((i, x) for i, _, x, _ in want)
        assert lines.dedup_report(nothing).count() == 0 and lines.deduplicated_documents(nothing).count() == 0


# ---- operator 1 ---------------------------------------------------------------

def byte_dedup(texts, n):
    seen = collections.Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                mark[i:i + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if mark[i] and (not i or not mark[i - 1]))
        yield len(b), sum(mark), runs, bytes(x for x, m in zip(b, mark, strict=True) if not m)


@pytest.mark.parametrize(("length", "gram", "chunk"), [(400, 32, 1 << 18), (60, 8, 500)])
def test_suffix_dedup(awkward, nothing, monkeypatch, length, gram, chunk):
    from roadpulse.llm import suffixes
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    if chunk == 500:  # split every k-gram's contexts and compare few at a time
        monkeypatch.setattr(suffixes, "GROUP", 2)
        monkeypatch.setattr(suffixes, "WINDOWS", 50)
    rows = rows_of(awkward)
    want = [(i, *x) for (i, _), x in zip(rows, byte_dedup([(t or "").encode() for _, t in rows], length), strict=True)]
    got = suffixes.deduplicate_bytes(awkward, length=length, gram=gram).collect()
    have = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"] or []), len(r["spans"] or []), bytes(r["kept"]))
            for r in got]
    assert counted(have) == counted(want)
    if chunk > 500:
        assert suffixes.deduplicate_bytes(nothing).count() == 0


def test_loser_tree_knows_prefixes():
    import random

    from roadpulse.llm import suffixes
    rnd = random.Random(3)
    for _ in range(60):
        runs, whole = [], []
        for _ in range(rnd.randint(1, 7)):
            own = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))), b"%d" % rnd.randint(0, 9)) for _ in range(rnd.randint(0, 30))]
            whole += own
            runs.append(suffixes.front_coded(sorted(own)))
        got = list(suffixes.merged(runs))
        assert sorted((s, more) for s, _, more in got) == sorted(whole)
        assert [s for s, _, _ in got] == sorted(s for s, _ in whole)
        for (a, _, _), (b, h, _) in zip(got, got[1:], strict=False):
            assert h == suffixes.common_prefix(a, b)


def test_repeats_follow_from_common_prefixes():
    """Ranges read off merged suffixes against a comparison of all windows."""
    import random
    import struct

    from roadpulse.llm import suffixes
    rnd = random.Random(5)
    length, gram = 12, 3
    for _ in range(200):
        # contexts around the anchor "abc", each with all its windows of 12 bytes
        classes = {}
        for x in range(rnd.randint(1, 40)):
            left = bytes(rnd.choice(b"xy") for _ in range(rnd.randint(0, 9)))
            right = bytes(rnd.choice(b"xy") for _ in range(rnd.randint(max(0, 9 - len(left)), 9)))
            classes.setdefault((left, right), x)
        runs = [[] for _ in range(3)]
        for (left, right), x in classes.items():
            rnd.choice(runs).append((b"abc" + right, struct.pack(suffixes.HEAD, 7, x, x % 10 == 0) + left[::-1]))
        got = collections.defaultdict(set)
        for g, x, first, last in suffixes.repeated_windows(suffixes.merged([suffixes.front_coded(sorted(r)) for r in runs]), length, gram):
            assert g == 7
            got[x] |= {"all"} if last is None else set(range(first, last + 1))
        counts = collections.Counter()
        for left, right in classes:
            whole = left + b"abc" + right
            counts.update((whole[i:i + length], len(left) - i) for i in range(len(whole) - length + 1))
        for (left, right), x in classes.items():
            whole = left + b"abc" + right
            want = {i for i in range(len(whole) - length + 1) if counts[whole[i:i + length], len(left) - i] > 1}
            assert got[x] == ({"all"} if x % 10 == 0 else want)


# ---- operator 2 ---------------------------------------------------------------

def test_elias_fano():
    from roadpulse.llm.eliasfano import EliasFano
    rng = np.random.default_rng(0)
    for n, u in ((0, 5), (1, 1), (5, 6), (1000, 1200), (1000, 10**6), (2000, 2**45)):
        v = np.sort(rng.integers(0, u, n).astype(np.uint64))
        e = EliasFano(np.frombuffer(EliasFano.packed(v, u), np.uint8))
        assert not n or (e.access(np.arange(n)) == v).all()
        x = np.r_[rng.integers(0, u, 500).astype(np.uint64), v]
        at, hit = e.successor(x)
        assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


@pytest.mark.parametrize(("small", "order", "min_context"), [(True, 3, 2), (False, 2, 1), (True, 4, 1)])
def test_language_model(awkward, nothing, monkeypatch, small, order, min_context):
    from roadpulse.llm import ngram
    if small:
        monkeypatch.setattr(ngram, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(ngram, "SHARD_BYTES", 2000)
    rows = [(i, [*(t or "").encode().lower().split(), b"\n"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
            for i, t in rows_of(awkward)]
    # a context is the words before a token, the start mark among them, as far as there are any
    def contexts(t, j):
        return [tuple([None, *t][j + 1 - k:j + 1]) for k in range(1, min(order - 1, j + 1) + 1)]

    c, gram, after = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, held in rows:
        if not held:
            c.update(t)
            gram.update((a, w) for j, w in enumerate(t) for a in contexts(t, j))
            after.update(a for j in range(len(t)) for a in contexts(t, j))
    follow = collections.Counter(a for a, _ in gram)
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t, held in rows:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for j, b in enumerate(t):
            p = (c[b] + 0.5) / (n + 0.5 * (v + 1))
            for a in contexts(t, j):
                if after[a] >= (1 if len(a) == 1 else min_context):
                    p = (max(gram[a, b] - 0.75, 0) + 0.75 * follow[a] * p) / after[a]
            score += math.log10(p)
        want.setdefault((i, held, len(t), sum(c[w] > 0 for w in t), n, round(base, 6)), []).append(score)
    got = {}
    for r in ngram.score_documents(awkward, order=order, min_context=min_context).collect():
        got.setdefault((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)), []).append(r["score"])
    assert got.keys() == want.keys()
    for k, scores in want.items():
        for a, b in zip(sorted(scores), sorted(got[k]), strict=True):
            assert a - 0.05 * k[2] <= b <= a + 1e-6  # codes are rounded down, by a tenth at most
    if not small:
        assert ngram.score_documents(nothing).count() == 0
