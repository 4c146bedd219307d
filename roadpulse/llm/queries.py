"""The thin queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bs),
ds AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, ds.n, i, item_id FROM ds JOIN bs ON ds.n = bs.n AND ds.s = bs.s),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import decontamination_report
    found = decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c >= 2) GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_symbols > n_words AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS lines_failed FROM m),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS fb, sum(symbols_failed::INT) AS fs,
    sum(lines_failed::INT) AS fl FROM j WHERE source IS NOT NULL GROUP BY 1),
prior AS (SELECT avg(1 / n) AS inv, sum(fb) / sum(n) AS mb, avg(fb / n) AS ab, avg(fb / n * (fb / n)) AS qb,
    sum(fs) / sum(n) AS ms, avg(fs / n) AS as_, avg(fs / n * (fs / n)) AS qs,
    sum(fl) / sum(n) AS ml, avg(fl / n) AS al, avg(fl / n * (fl / n)) AS ql FROM hosts),
v AS (SELECT *, qb - 2 * mb * ab + mb * mb - mb * (1 - mb) * inv AS vb, qs - 2 * ms * as_ + ms * ms - ms * (1 - ms) * inv AS vs,
    ql - 2 * ml * al + ml * ml - ml * (1 - ml) * inv AS vl FROM prior),
k AS (SELECT mb, ms, ml, CASE WHEN vb > 0 THEN least(greatest(mb * (1 - mb) / vb - 1, 1), 1000) ELSE 1000 END AS kb,
    CASE WHEN vs > 0 THEN least(greatest(ms * (1 - ms) / vs - 1, 1), 1000) ELSE 1000 END AS ks,
    CASE WHEN vl > 0 THEN least(greatest(ml * (1 - ml) / vl - 1, 1), 1000) ELSE 1000 END AS kl FROM v),
bad AS (SELECT source, (fb + mb * kb) / (n + kb) > 0.5 OR (fs + ms * ks) / (n + ks) > 0.8
    OR (fl + ml * kl) / (n + kl) > 0.8 AS host_bad FROM hosts, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_bad, false) AS kept
FROM j LEFT JOIN bad ON j.source = bad.source
"""


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts
    return quality_verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(read_table(spark, sf_dir, "documents"))


@query("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import training_order
    return training_order(spark, read_table(spark, sf_dir, "documents")).drop("path")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start,
    list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
lg AS (SELECT *, len(w) >= 5 AND row_number() OVER (PARTITION BY array_to_string(w, ' '), len(w) >= 5 ORDER BY doc_id, i) > 1 AS gone
  FROM l),
s AS (
  SELECT doc_id, i, j, s, start + sum(length(s)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(s) AS start,
    list_filter(regexp_split_to_array(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, i, start, generate_subscripts(t, 1) AS j, unnest(t) AS s
    FROM (SELECT doc_id, i, start, regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+') AS t FROM l))),
r AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, i, j) > 1 AS again,
    row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM s WHERE len(w) > 0),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r WHERE again),
c AS (SELECT doc_id, i, j FROM (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id, run) AS words FROM g) WHERE words >= 20),
sc AS (SELECT s.*, c.j IS NOT NULL AND NOT lg.gone AS cut FROM s JOIN lg ON s.doc_id = lg.doc_id AND s.i = lg.i
  LEFT JOIN c ON s.doc_id = c.doc_id AND s.i = c.i AND s.j = c.j),
lc AS (SELECT doc_id, i, trim(coalesce(string_agg(s, '' ORDER BY j) FILTER (NOT cut), ''), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS rest
  FROM sc GROUP BY doc_id, i HAVING bool_or(cut)),
kept AS (SELECT lg.doc_id, lg.i, gone, rest IS NOT NULL AND rest = '' AS empty, coalesce(rest, line) AS line
  FROM lg LEFT JOIN lc ON lg.doc_id = lc.doc_id AND lg.i = lc.i),
sp AS (SELECT doc_id, start AS a, start + length(line) AS b FROM lg WHERE gone
  UNION ALL SELECT doc_id, start, start + length(s) FROM sc WHERE cut),
si AS (SELECT *, sum(CASE WHEN a = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS grp
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM sp)),
sm AS (SELECT doc_id, grp, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM si GROUP BY doc_id, grp),
sd AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS n FROM sm GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN count(*) = 1 AND max(length(line)) = 0 AND NOT bool_or(gone) AND NOT bool_or(empty) THEN 0 ELSE count(*) END AS n_units,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone AND NOT empty), '') AS text FROM kept GROUP BY doc_id)
SELECT t.doc_id, n_units, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS removed_spans, text FROM t LEFT JOIN sd ON t.doc_id = sd.doc_id
"""


@query("op10_substring_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_report
    found = dedup_report(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    return found.withColumn("removed_spans", F.coalesce(spans, F.lit("")))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .golay import near_duplicates
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_zip_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ziparchive import round_trip
    read = round_trip(spark, read_table(spark, sf_dir, "pages"))
    return read.select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"))


@query("op7_label_propagation_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .propagation import shard_documents
    return shard_documents(read_table(spark, sf_dir, "documents"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduplicate_bytes
    found = deduplicate_bytes(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "n_bytes", F.coalesce(removed, zero).alias("n_removed"),
                        F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"))


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pairs import align
    return align(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS s FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.93 * a.s * b.s),
reach AS (SELECT vec_id, vec_id AS w FROM v UNION SELECT reach.vec_id, links.w FROM reach JOIN links ON reach.w = links.u),
c AS (SELECT vec_id, min(w) AS component_id FROM reach GROUP BY 1),
n AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.u
"""


@query("op12_embedding_near_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projectionforest import near_vectors
    return near_vectors(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def _op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds written out; every round compares every entry."""
    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT vec_id, label, part, list_min(list_transform(list_zip(range(len(b)), b),
    lambda e: (list_sum(list_transform(list_zip(x, e[2]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e[1]))) AS best, x
  FROM p JOIN book{k} USING (part)),
h{k} AS (SELECT vec_id, label, part, x, CAST(best[1] AS BIGINT) AS dist, CAST(best[2] AS BIGINT) AS e FROM a{k})"""
    steps = []
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""s{k} AS (SELECT part, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
  FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM h{k}) GROUP BY ALL),
n{k} AS (SELECT part, e, list(m ORDER BY i) AS m FROM s{k} GROUP BY ALL),
f{k} AS (SELECT part, unnest(range(len(b))) AS e, unnest(b) AS old FROM book{k}),
book{k + 1} AS (SELECT part, list(coalesce(m, old) ORDER BY e) AS b FROM f{k} LEFT JOIN n{k} USING (part, e) GROUP BY part)""")
    steps.append(assigned(rounds))
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, label, k AS part, q[k * (len(q) // {parts}) + 1 : (k + 1) * (len(q) // {parts})] AS x
  FROM (SELECT *, unnest(range({parts})) AS k FROM v)),
book0 AS (SELECT part, list(x ORDER BY vec_id) AS b FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}) GROUP BY part),
{", ".join(steps)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM h{rounds} GROUP BY vec_id, label),
d AS (SELECT sha256(string_agg(t, ',' ORDER BY part)) AS sha FROM (
  SELECT part, array_to_string(list_transform(flatten(b), lambda c: CAST(c AS VARCHAR)), ',') AS t FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r, d
"""


@query("op13_vector_codes", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import code_report
    return code_report(read_table(spark, sf_dir, "embeddings"))
