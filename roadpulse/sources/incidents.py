"""Incident intake, graph and metadata sources and sinks.

Readers declare their schemas (no inference pass over the data); writers go
to parquet/CSV/JSON/XML folders that Spark writes in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import stored
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Raw incident export columns read as text (converted later).
RAW_COLUMNS = [
    "id", "start_datetime", "created_date", "resolved_datetime", "closed_datetime", "end_datetime",
    "modified_datetime", "event_type", "event_cause", "requires_road_closure", "latitude", "longitude",
    "veh_type", "corridor", "zone", "junction", "description", "address", "priority", "status",
]
REQUIRED = ("latitude", "longitude")


def raw_schema(columns=RAW_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def load_raw_csv(spark: SparkSession, path: str, columns=RAW_COLUMNS, multi_line: bool = True) -> DataFrame:
    """All columns as text (no coercion at read time). Quoted fields may hold
    line breaks, for which a file must be read by one task; without such fields,
    ``multi_line=False`` splits large files over many tasks."""
    return (spark.read.schema(raw_schema(columns)).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').csv(path))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """S4 for CSV: column names from the header line only."""
    try:
        return spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    except AnalysisException as e:
        raise FileNotFoundError(f"expected an incident file at {path}") from e


def load_incidents_csv(spark: SparkSession, path: str, columns=None, required=REQUIRED, multi_line: bool = True) -> DataFrame:
    """CSV scan + existence and required-column checks."""
    header = csv_header(spark, path)
    missing = [c for c in required if c not in header]
    if missing:
        raise KeyError(f"required column(s) {missing} missing from {path}")
    return load_raw_csv(spark, path, columns or header, multi_line)


def with_row_numbers(scan: DataFrame, out: str = "row_number") -> DataFrame:
    """``scan`` (a DataFrame read from files) with its rows' gapless numbers from
    0 in file order: files by path, rows as they lie in the file.

    A file may be read in several splits and by any tasks. Every row notes its
    split's file and offset; rows of a split keep their order within a task.
    One row per split (its count) says where each split's numbers begin.
    """
    from pyspark.sql import Window
    names = scan.columns
    told = stored(scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
                              F.monotonically_increasing_id().alias("__id")))
    splits = told.groupBy("__file", "__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("__file", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    starts = stored(starts)  # its written size decides how it is joined
    numbered = told.join(starts, ["__file", "__at"])
    return numbered.select(*names, (F.col("__start") + F.col("__id") - F.col("__first")).cast("long").alias(out))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Overwrite sink; CSV gets a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# ------------------------------------------------------------- S5/S6 graph
GRAPHML_DATA = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))
GRAPHML_NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("data", GRAPHML_DATA)])
GRAPHML_EDGE = T.StructType([T.StructField("_source", T.LongType()), T.StructField("_target", T.LongType()),
                             T.StructField("_id", T.IntegerType()), T.StructField("data", GRAPHML_DATA)])
GRAPHML_KEY = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_for", T.StringType()),
                            T.StructField("_attr.name", T.StringType()), T.StructField("_attr.type", T.StringType())])


def graphml_keys(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """(node or edge, attribute name) -> key id, from the file's <key> elements
    (a handful; they are the file's schema)."""
    rows = spark.read.format("xml").option("rowTag", "key").schema(GRAPHML_KEY).load(path).collect()
    return {(r["_for"], r["_attr.name"]): r["_id"] for r in rows if r["_id"] and r["_attr.name"]}


def _data_value(key: str | None):
    if key is None:
        return F.lit(None).cast("string")
    # get() tolerates an element without that key (ANSI indexing would fail)
    return F.get(F.filter("data", lambda x: x["_key"] == key), 0)["_VALUE"]


def _key_of(keys: dict[tuple[str, str], str], kind: str, name: str, needed: bool) -> str | None:
    """The id under which an attribute is stored. A file without any <key>
    element names its attributes directly."""
    if not keys:
        return name
    got = keys.get((kind, name)) or keys.get(("all", name))
    if got is None and needed:
        raise ValueError(f"the file declares no {name!r} for a {kind}; it has {sorted(n for k, n in keys if k in (kind, 'all'))}")
    return got


def read_graphml(spark: SparkSession, path: str, x: str = "x", y: str = "y", length: str = "length",
                 geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """GraphML through the built-in XML source -> (nodes, edges).

    Attributes are looked up by name in the file's key table (``<key id="d9"
    attr.name="length">``). A file that declares keys but no length, x or y is
    an error; an element without a length has NULL (the collapse then uses
    1.0). ``geometry`` is the edge's shape as WKT text, NULL for a straight edge.
    """
    keys = graphml_keys(spark, path)
    node = lambda name: _data_value(_key_of(keys, "node", name, True)).try_cast("double")
    nodes = (spark.read.format("xml").option("rowTag", "node").schema(GRAPHML_NODE).load(path)
             .select(F.col("_id").alias("node_id"), node(x).alias("x"), node(y).alias("y")))
    edges = (spark.read.format("xml").option("rowTag", "edge").schema(GRAPHML_EDGE).load(path)
             .select(F.col("_source").alias("u"), F.col("_target").alias("v"),
                     F.coalesce(F.col("_id"), F.lit(0)).alias("key"),
                     _data_value(_key_of(keys, "edge", length, True)).try_cast("double").alias("length"),
                     _data_value(_key_of(keys, "edge", geometry, False)).alias("geometry")))
    return nodes, edges


def edge_segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge as straight segments (u, v, key, ux, uy, vx, vy): along its
    LINESTRING where it has one, else between its nodes."""
    numbers = F.transform(F.split(F.regexp_extract("geometry", r"LINESTRING\s*\(([^)]*)\)", 1), r"\s*,\s*"),
                          lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double")))
    drawn = edges.where(F.col("geometry").rlike(r"LINESTRING\s*\(")).select("u", "v", "key", numbers.alias("p"))
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(
        F.get(F.get("p", i), F.lit(0)).alias("ux"), F.get(F.get("p", i), F.lit(1)).alias("uy"),
        F.get(F.get("p", i + 1), F.lit(0)).alias("vx"), F.get(F.get("p", i + 1), F.lit(1)).alias("vy")))
    bent = drawn.where(F.size("p") > 1).select("u", "v", "key", F.explode(steps).alias("s")).select("u", "v", "key", "s.*")
    plain = edges.where(F.col("geometry").isNull() | ~F.col("geometry").rlike(r"LINESTRING\s*\(")).select("u", "v", "key")
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return bent.unionByName(plain.join(a, "u").join(b, "v").select("u", "v", "key", "ux", "uy", "vx", "vy"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of GraphML files: keys, nodes (node_id, x, y), edges (u, v, key,
    length and, if there, geometry). Attributes are stored under numbered keys."""
    spark = edges.sparkSession
    names = [("node", "x"), ("node", "y"), ("edge", "length"), ("edge", "geometry")]
    keys = spark.createDataFrame([(f"d{i}", kind, name, "string" if name == "geometry" else "double")
                                  for i, (kind, name) in enumerate(names)], GRAPHML_KEY).coalesce(1)
    datum = lambda i, c: F.struct(c.cast("string").alias("_VALUE"), F.lit(f"d{i}").alias("_key"))
    rows = nodes.select(F.col("node_id").alias("_id"), F.array(datum(0, F.col("x")), datum(1, F.col("y"))).alias("data"))
    shape = F.col("geometry") if "geometry" in edges.columns else F.lit(None).cast("string")
    arcs = edges.select(F.col("u").alias("_source"), F.col("v").alias("_target"), F.col("key").alias("_id"),
                        F.filter(F.array(datum(2, F.col("length")), datum(3, shape)), lambda d: d["_VALUE"].isNotNull()).alias("data"))
    for part, df, tag in (("keys", keys, "key"), ("nodes", rows, "node"), ("edges", arcs, "edge")):
        df.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{path.rstrip('/')}/{part}")


def cached_graph(spark: SparkSession, cache: str, build) -> DataFrame:
    """Cache-first load; build and save once when the cache is absent."""
    try:
        return spark.read.parquet(cache)
    except AnalysisException:
        build().write.mode("ignore").parquet(cache)
        return spark.read.parquet(cache)


# --------------------------------------------------------- S7/S8 metadata
def write_metadata(df: DataFrame, path: str) -> None:
    """One JSON document per row (section, payload) — written in parallel."""
    df.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON metadata with a declared schema."""
    return spark.read.schema(schema).json(path)
