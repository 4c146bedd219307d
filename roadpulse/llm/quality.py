"""Quality rules with host-level verdicts (operator 8).

Every document gets its own measures and rule failures. Failures are then
aggregated by host; each host's failure rate is shrunk towards the corpus
rate (all failures over all documents) with a beta prior whose strength is
fitted to the hosts themselves: the spread of their rates around the corpus
rate, less the spread that sampling alone gives hosts of their sizes (method of
moments). So a host with few documents stays near the corpus rate and a large
one near its own. A host whose shrunk rate is beyond a rule's
limit is judged bad, and the verdict is joined back to its documents.

Only column expressions are used; a document's words never leave its row.

Defined results: a null or empty text has no words (and fails the base rule);
a null host has no verdict of its own, its documents are judged by the base
rule alone; repeated rows count as often as they occur; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DUP_LINE_PERCENT = 30
WINDOW = 8
# A host is bad when, after shrinking, more than this share of its documents
# fail the rule. The limits are shares of documents, not of words.
HOST_LIMITS = {"base": 0.5, "symbols": 0.8, "lines": 0.8}
# Bounds for the prior's strength (in documents) where the hosts' spread says
# nothing, e.g. for a single host or equal rates.
PRIOR_DOCS = (1.0, 1000.0)


def _windows(words: Column, n: int) -> Column:
    """Hashes of all windows of ``n`` words, in order; empty if there are fewer."""
    return F.when(F.size(words) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)),
                              lambda i: F.xxhash64(F.slice(words, i, n)))
                  ).otherwise(F.array().cast("array<bigint>"))


def document_measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                      window: int = WINDOW) -> DataFrame:
    """doc_id, host and the measures of each document's whole text."""
    c = F.col
    d = docs.select(c(doc_id).alias("doc_id"), c(host).alias("host"), text_of(text).alias("t"))
    d = d.select("doc_id", "host", "t",
                 F.array_remove(F.split("t", WHITE), "").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    d = d.select("doc_id", "host",
                 F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("lines").cast("long").alias("n_lines"),
                 _windows(c("w"), window).alias("g"))
    # Positions are sorted by hash only in texts that have a repeated window.
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"),
                                 F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, y: F.coalesce(F.get("s", x)["h"] == F.get("s", y)["h"], F.lit(False))
    d = d.withColumn("at", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(
        F.filter("s", lambda x, i: equal(i, i - 1) | equal(i, i + 1)), lambda x: x["i"]))))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"),
                                (p + window).alias("end")))
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                    F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def rule_failures(measures: DataFrame, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  max_dup_line_percent: int = MAX_DUP_LINE_PERCENT) -> DataFrame:
    """Adds base_failed and the two rules that only count towards hosts: more
    symbols than words, and too large a share of the lines being repeats."""
    c = F.col
    return measures.withColumns({
        "base_failed": (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words")),
        "symbols_failed": c("n_symbols") > c("n_words"),
        "lines_failed": 100 * c("n_dup_lines") > max_dup_line_percent * c("n_lines"),
    })


def host_verdicts(judged: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per host: documents, shrunk failure rate per rule, bad or not."""
    limits = limits or HOST_LIMITS
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"{r}_failed").cast("int")).alias(f"f_{r}") for r in limits])
    rate = {r: F.col(f"f_{r}") / F.col("n") for r in limits}
    sums = hosts.agg(F.avg(1 / F.col("n")).alias("inv"), *[x for r in limits for x in (
        F.try_divide(F.sum(f"f_{r}"), F.sum("n")).alias(f"m_{r}"), F.avg(rate[r]).alias(f"a_{r}"),
        F.avg(rate[r] * rate[r]).alias(f"q_{r}"))])
    low, high = PRIOR_DOCS
    strength = {}
    for r in limits:
        m = F.col(f"m_{r}")
        sampling = m * (1 - m)  # variance of one document
        spread = F.col(f"q_{r}") - 2 * m * F.col(f"a_{r}") + m * m - sampling * F.col("inv")
        strength[r] = F.when(spread > 0, F.least(F.greatest(sampling / spread - 1, F.lit(low)), F.lit(high))).otherwise(high)
    prior = sums.select(F.lit(1).alias("_one"), *[F.col(f"m_{r}") for r in limits],
                        *[strength[r].alias(f"k_{r}") for r in limits])
    # one row of priors: the join adds columns, it makes no pairs
    both = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one").drop("_one")
    shrunk = {r: (F.col(f"f_{r}") + F.col(f"m_{r}") * F.col(f"k_{r}")) / (F.col("n") + F.col(f"k_{r}")) for r in limits}
    bad = F.lit(False)
    for r, limit in limits.items():
        bad = bad | (shrunk[r] > limit)
    return both.select("host", F.col("n").alias("host_docs"),
                       *[shrunk[r].alias(f"rate_{r}") for r in limits], bad.alias("host_bad"))


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                     limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, host, measures, rule failures, the host's verdict and ``kept``.

    A document is kept if it passes the base rule and its host isn't bad. The
    measures are written once: hosts are aggregated from them (partial sums
    before the shuffle, so a hot host costs a row per task). The bad hosts are
    written as well, so that their size is known: a short list is broadcast and
    a hot host's rows stay where they are. Texts take no part in the join.
    """
    judged = materialize(rule_failures(document_measures(docs, doc_id, text, host)), "quality")
    bad = materialize(host_verdicts(judged, limits).where("host_bad").select(F.col("host").alias("_host"), "host_bad"),
                      "bad-hosts")
    return (judged.join(bad, judged["host"] == bad["_host"], "left").drop("_host")
            .withColumn("host_bad", F.coalesce("host_bad", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source",
                   limits: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are.

    The rows are carried through the measuring pass as one struct (so that no
    column of theirs can clash) and written once with their failures; texts
    are never shuffled, only host verdicts are joined to them.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inner = carried.select("row", F.col(f"row.`{text}`").alias("t"), F.col(f"row.`{host}`").alias("h"))
    judged = rule_failures(document_measures(inner, "row", "t", "h")).select(
        F.col("doc_id").alias("row"), "host", *[f"{r}_failed" for r in (limits or HOST_LIMITS)])
    judged = materialize(judged, "quality-rows")
    # written first, so that its size is known: a short list of bad hosts is
    # broadcast and the rows with their texts stay where they are
    bad = materialize(host_verdicts(judged, limits).where("host_bad").select(F.col("host").alias("_host")), "bad-hosts")
    passed = judged.where(~F.col("base_failed"))
    return passed.join(bad, passed["host"] == bad["_host"], "left_anti").select("row.*")
