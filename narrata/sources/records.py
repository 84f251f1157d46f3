"""JSON records on a shared store: line-delimited snapshots, the file lake, seed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions.text import safe_name

_TEXT = "exchange_id exchange_type source_system entity_type natural_key".split()
EXCHANGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("observed_at_utc", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("content_sha256", "request", "response")]
    + [T.StructField("schema_version", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType()))]
)


def write_snapshot(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Line-delimited files of up to per_file records, in folders by year and day of observation."""
    day = F.to_date("observed_at_utc")
    rows = records.withColumns({"yyyy": F.date_format(day, "yyyy"), "dt": F.date_format(day, "yyyy-MM-dd")})
    rows.write.partitionBy("yyyy", "dt").option("maxRecordsPerFile", per_file).mode("append").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = EXCHANGE) -> tuple[DataFrame, DataFrame]:
    """The records, and the lines that are not records."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where("length(trim(value)) > 0")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def write_lake(records: DataFrame, path: str) -> None:
    """Ingest records as JSON, in folders by system, source and resource type."""
    parts = ("source_system", "source_name", "resource_type")
    rows = records.withColumns({f"{c}_dir": safe_name(F.coalesce(F.col(c), F.lit("none"))) for c in parts})
    rows.write.partitionBy(*(f"{c}_dir" for c in parts)).mode("append").json(path)


def read_seeds(spark: SparkSession, path: str, row_schema: T.StructType) -> DataFrame:
    """The rows of seed files with their target table: one JSON object a file, rows in an array."""
    text = T.StringType()
    target = T.StructType([T.StructField("schema", text), T.StructField("table", text), T.StructField("naturalKey", T.ArrayType(text)), T.StructField("loadBehavior", text)])
    schema = T.StructType([T.StructField("seedVersion", T.StringType()), T.StructField("target", target), T.StructField("rows", T.ArrayType(row_schema))])
    files = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return files.select("seedVersion", "target", F.explode("rows").alias("row")).select("seedVersion", F.concat_ws(".", "target.schema", "target.table").alias("target_table"), "row.*")


def append_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """Appends records to a Parquet table, in folders by a column if one is named."""
    writer = records.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Appends manifests (run_id, created_utc and whatever else) as JSON, in folders by day."""
    manifests.withColumn("day", F.to_date("created_utc")).write.mode("append").partitionBy("day").json(path)


def read_manifests(spark: SparkSession, path: str, schema, since: str | None = None) -> DataFrame:
    """The manifests, of the days from since on; newest first."""
    rows = spark.read.schema(schema).json(path)
    return (rows if since is None else rows.where(F.col("day") >= F.lit(since).cast("date"))).orderBy(F.desc("created_utc"), "run_id")


def write_artifacts(outputs: DataFrame, path: str) -> None:
    """Appends a run's outputs (run_id, created_utc and whatever else) as JSON, in folders by year, month, day and run."""
    at = F.col("created_utc")
    dated = outputs.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd"), "run": safe_name(F.col("run_id"))})
    dated.write.mode("append").partitionBy("year", "month", "day", "run").json(path)


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(lake_uri, text): the whole files below a folder, named by their path in it; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    below = F.substring("path", F.instr("path", whole) + len(whole), F.length("path"))
    return files.select(below.alias("lake_uri"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
