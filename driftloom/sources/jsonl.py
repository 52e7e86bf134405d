"""JSON lines, strict and lenient, with explicit schemas.

``bad_lines`` names each bad line by its file and its number there. Files are read in splits, line by line, and the numbers put together from the lines of
the splits before, so that no file is ever one row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, text) of lines that are neither blank nor an object of the schema; line counts from 1."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = blocks.withColumn("before", before).drop("n")
    checked = schema if "_corrupt" in schema.names else StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json("text", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("text") != "").withColumn("_p", parsed)
    bad = rows.where(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull() | ~F.ltrim("text").startswith("{"))
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def read_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All objects, after a pass that raises an error with the file and number of the first bad line, if there is one."""
    bad = bad_lines(spark, path, schema).orderBy("file", "line").select("file", "line").first()
    if bad:
        raise ValueError(f"invalid JSON on line {bad.line} in {bad.file}")
    return read_strict(spark, path, schema)


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All objects of a file; any bad line fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``read_strict``, but a missing path is an empty table."""
    try:
        return read_strict(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Objects with their keys in ascending order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
