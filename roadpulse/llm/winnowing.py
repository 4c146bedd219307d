"""Benchmark decontamination by winnowing (operator 6).

Fingerprints of a word sequence are the smallest k-gram hash of every window
of ``w`` consecutive k-grams. Two sequences that share ``w + k - 1`` words
share a fingerprint, so with ``k + w - 1 = 10`` every shared span of ten words
is found from fingerprints alone. Documents whose fingerprints meet one of the
benchmark's are candidates; there, each k-gram hit is extended to the spans of
ten words that contain it, and these are compared with the benchmark's own
spans by a 128-bit digest. Items with fewer than ten words are one span of
their own length, fingerprinted by the hash of that whole span.

Only DataFrame functions are used. Texts are compared by content: documents
with equal texts are worked on once each, results are joined back by digest.

Defined results: null or empty texts have no words, so no hit; an item without
words matches nothing; repeated items count as items of their own (each id is
listed once); items with a null id count like any other, all of them together
as one item that isn't listed; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_key, text_of

SPAN = 10
K = 6
# Not words: ASCII other than digits and letters (after lower-casing).
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# The benchmark's fingerprints are broadcast up to this many rows of two longs
# (16 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, empty if there are fewer words."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, w: int) -> Column:
    """Distinct minima of all windows of w hashes, empty if there are fewer."""
    return F.when(F.size(grams) >= w, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(grams) - w),
        lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])))
    ).otherwise(F.array().cast("array<bigint>"))


def _span_digest(words: Column, start: Column, n: Column | int) -> Column:
    """Digest of n words from a 0-based start; words hold no blanks, so joining is exact."""
    return F.unhex(F.md5(F.array_join(F.slice(words, start + 1, n), " ")))


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def benchmark_spans(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """item_id, n (words in the span), digest: every span that counts, once per item."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(text_of(text)).alias("w"))
    b = b.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(span)))
    b = b.select("item_id", "n", F.transform(
        F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: _span_digest(F.col("w"), i, F.col("n"))).alias("d"))
    return b.select("item_id", "n", F.explode(F.array_distinct("d")).alias("digest"))


def benchmark_fingerprints(benchmark: DataFrame, text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """n (words hashed: k, or all of a shorter item), f: distinct fingerprints."""
    w = span - k + 1
    b = benchmark.select(words_of(text_of(text)).alias("w")).where(F.size("w") > 0)
    b = b.select(F.size("w").alias("m"), "w", _grams(F.col("w"), k).alias("g"))
    f = F.when(F.col("m") >= span, _minima(F.col("g"), w)).otherwise(F.array(F.xxhash64("w")))
    n = F.when(F.col("m") >= span, k).otherwise(-F.col("m"))
    return b.select(n.alias("n"), F.explode(f).alias("f")).distinct()


def _tagged(n: int, hashes: Column) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("f")))


def _short_spans(m: int) -> Column:
    """Starts of the spans of m words whose hash was found, as structs (n, start)."""
    wanted = F.transform(F.filter("found", lambda x: x["n"] == -m), lambda x: x["f"])
    at = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.col("m") - m, F.lit(0))), lambda i: F.when(
        F.array_contains(wanted, F.xxhash64(F.slice("w", i + 1, m))), i)), lambda i: i.isNotNull())
    spans = F.transform(at, lambda i: F.struct(F.lit(m).alias("n"), i.alias("start")))
    return F.when(F.exists("found", lambda x: x["n"] == -m), spans).otherwise(
        F.array().cast("array<struct<n:int,start:int>>"))


def _fingerprinted(docs: DataFrame, text: Column, short: list[int], span: int, k: int, *also: Column) -> DataFrame:
    """Per row of ``docs``: key, n_words, x (its fingerprints) and what else is asked for."""
    w = span - k + 1
    d = docs.select(*also, text_key(text).alias("key"), words_of(text).alias("w"))
    rest = [c for c in d.columns if c != "w"]
    d = d.select(*rest, F.size("w").cast("long").alias("n_words"), "w", _grams(F.col("w"), k).alias("g"))
    # For an item shorter than the span its own length is the window: each
    # length that occurs (below the span, so at most nine) is hashed as well.
    tagged = [_tagged(k, _minima(F.col("g"), w))]
    tagged += [_tagged(-m, F.array_distinct(_grams(F.col("w"), m))) for m in short]
    return d.select(*rest, "n_words", F.concat(*tagged).alias("x"))


def _candidates(fingerprinted: DataFrame, prints: DataFrame) -> DataFrame:
    """key, found: the texts that share fingerprints, with the shared ones."""
    d = fingerprinted.select("key", F.explode("x").alias("x")).select("key", "x.n", "x.f")
    hit = d.join(_small(prints), ["n", "f"], "left_semi")
    return hit.groupBy("key").agg(F.collect_set(F.struct("n", "f")).alias("found"))


def _extended(docs: DataFrame, found: DataFrame, short: list[int], span: int, k: int) -> DataFrame:
    """key, n, start, digest: the spans around every hit in the candidate texts."""
    d = docs.select(text_key(F.col("t")).alias("key"), F.col("t"))
    d = d.join(found, "key").dropDuplicates(["key"])
    d = d.select("key", "found", words_of(F.col("t")).alias("w"))
    d = d.select("key", "found", "w", _grams(F.col("w"), k).alias("g"))
    long = F.transform(F.filter("found", lambda x: x["n"] == k), lambda x: x["f"])
    d = d.select("key", "found", "w", "g", long.alias("long"))
    at = F.filter(F.transform("g", lambda h, i: F.when(F.array_contains("long", h), i)), lambda i: i.isNotNull())
    d = d.select("key", "found", "w", at.alias("at"), F.size("w").alias("m"))
    around = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i - (span - k), i))))
    spans = F.transform(F.filter(around, lambda s: (s >= 0) & (s + span <= F.col("m"))),
                        lambda s: F.struct(F.lit(span).alias("n"), s.alias("start")))
    for m in short:
        spans = F.concat(spans, _short_spans(m))
    d = d.select("key", F.transform(spans, lambda s: F.struct(
        s["n"].alias("n"), s["start"].alias("start"),
        _span_digest(F.col("w"), s["start"], s["n"]).alias("digest"))).alias("spans"))
    return d.select("key", F.explode("spans").alias("s")).select("key", "s.n", "s.start", "s.digest")


def _prints(benchmark: DataFrame, item_text: str, span: int, k: int) -> tuple[DataFrame, list[int]]:
    """The benchmark's fingerprints, and the lengths below the span that occur (at most nine)."""
    prints = materialize(benchmark_fingerprints(benchmark, item_text, span, k), "fingerprints")
    return prints, sorted(-r["n"] for r in prints.where("n < 0").select("n").distinct().collect())


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """One row per distinct text with a hit: key, n_hit (words inside a shared
    span), n_items, item_ids (sorted as strings, each once, without the null one)."""
    prints, short = _prints(benchmark, item_text, span, k)
    # written first: Spark infers a filter on what is exploded and would push it,
    # words and hashes written out in it, below the step that computes them once
    d = materialize(_fingerprinted(docs, text_of(text), short, span, k), "document-fingerprints")
    return _hit_texts(docs, text, d, prints, short, benchmark, item_id, item_text, span, k)


def _hit_texts(docs: DataFrame, text: str, fingerprinted: DataFrame, prints: DataFrame, short: list[int], benchmark: DataFrame,
               item_id: str, item_text: str, span: int, k: int) -> DataFrame:
    t = docs.select(text_of(text).alias("t"))
    found = materialize(_candidates(fingerprinted, prints), "candidates")
    spans = benchmark_spans(benchmark, item_id, item_text, span)
    marks = materialize(spans.groupBy("n", "digest").agg(
        F.collect_set(F.struct("item_id")).alias("items")), "spans")  # in structs, as sets drop nulls
    # only rows are counted here: a span's list of items has no bound of its own
    hits = materialize(_extended(t, found, short, span, k).join(_small(marks, BROADCAST_ROWS // 4), ["n", "digest"]), "hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
                                F.greatest(s["end"], acc["end"]).alias("end")))
    words = hits.select("key", "start", "n").distinct().groupBy("key").agg(covered["n"].cast("long").alias("n_hit"))
    items = hits.select("key", F.explode("items").alias("item")).select("key", "item.item_id").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return words.join(items, "key").select("key", "n_hit", "n_items", "item_ids")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    prints, short = _prints(benchmark, item_text, SPAN, K)
    # texts are cut into words once; fingerprints and numbers of words are written
    d = materialize(_fingerprinted(docs, text_of(text), short, SPAN, K, F.col(doc_id).alias("doc_id")), "document-fingerprints")
    hits = _hit_texts(docs, text, d, prints, short, benchmark, item_id, item_text, SPAN, K)
    zero = F.lit(0).cast("long")
    return d.join(hits, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no span with the benchmark, unchanged."""
    hits = materialize(contaminated_texts(docs, benchmark, text, item_id, item_text).select(
        F.col("key").alias("_hit_key")), "contaminated")
    return docs.join(hits, text_key(text_of(text)) == hits["_hit_key"], "left_anti")
