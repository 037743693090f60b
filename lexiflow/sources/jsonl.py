"""JSON Lines, strictly: blank lines are skipped, unknown fields are an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULTS, schema_of


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and _line (from 1 in each file) of non-blank lines; file order by Spark's row index."""
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    return lines.where(F.trim("value") != "")


def unknown_fields(lines: DataFrame, table: str) -> DataFrame:
    """Lines that are no object or have fields the table doesn't."""
    known = F.array(*[F.lit(f.name) for f in schema_of(table)])
    keys = F.json_object_keys("value")
    return lines.where(keys.isNull() | (F.size(F.array_except(keys, known)) > 0))


def read_jsonl(spark: SparkSession, path: str, table: str, check: bool = True) -> DataFrame:
    """The table's columns and _pos (line order).  A path without files reads as empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(hadoop):
        return spark.createDataFrame([], schema_of(table)).withColumn("_pos", F.lit(None).cast("long"))
    lines = read_lines(spark, path)
    if check:
        bad = unknown_fields(lines, table).select("_file", "value").take(1)
        if bad:
            raise ValueError(f"{bad[0]['_file']}: not a {table} record: {bad[0]['value'][:200]}")
    parsed = lines.select(F.from_json("value", schema_of(table), {"mode": "FAILFAST"}).alias("r"), F.col("_at").alias("_pos"))
    rows = parsed.select("r.*", "_pos")
    for name, default in DEFAULTS.get(table, {}).items():
        usual = (F.array() if default == [] else F.lit(default)).cast(rows.schema[name].dataType)
        rows = rows.withColumn(name, F.coalesce(F.col(name), usual))
    return rows


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One object a file, open-ended, as a variant column."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)
