"""CSV with given types, Parquet shards by plan, inventories of files, sinks that write all or nothing."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header and explicit types; blanks are null, values that do not parse are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", emptyValue=None, nullValue="")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], json_columns: Sequence[str] = ()) -> None:
    """Fixed order of columns; nested ones as JSON text named <column>_json."""
    out = [F.to_json(c).alias(f"{c}_json") if c in json_columns else F.col(c) for c in columns]
    df.select(*out).write.mode("overwrite").csv(path, header=True)


def read_shards(spark: SparkSession, files: Sequence[str], columns: Sequence[str], start: int, end: int, key: str = "batch_idx") -> DataFrame:
    """Planned shard files, the wanted columns and the half-open range only, with the name of the file each row is from."""
    rows = spark.read.parquet(*files).where((F.col(key) >= start) & (F.col(key) < end))
    return rows.select(*columns, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def portable(spark: SparkSession, declared: str, base: str, fallback: str) -> str:
    """Where a declared artifact lies: there itself, relative to ``base``, or by its name in the folder ``fallback`` of ``base``. An error if nowhere."""
    name = declared.rstrip("/").rsplit("/", 1)[-1]
    for candidate in (declared, f"{base}/{declared}", f"{base}/{fallback}/{name}"):
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(f"artifact not found: {declared}")


def resolve_shards(spark: SparkSession, root: str, names: Sequence[str], missing: str = "error") -> dict[str, str]:
    """The path of each planned shard: a file or folder of its name in ``root`` or its folder ``data``, or its part of a table written by ``source_file``.

    Shards that are in none raise an error, or are left out with missing='skip'."""
    found = {}
    for name in names:
        path = next((p for p in (f"{root}/{name}", f"{root}/data/{name}", f"{root}/source_file={name}") if exists(spark, p)), None)
        if path:
            found[name] = path
    lacking = sorted(set(names) - set(found))
    if lacking and missing != "skip":
        raise FileNotFoundError(f"planned shards not found: {lacking[:20]}")
    return found


def read_planned(spark: SparkSession, plans: DataFrame, root: str, columns: Sequence[str], missing: str = "error", schema: StructType | None = None) -> DataFrame:
    """The rows of each plan's files and half-open range: (plan_id, source_file, columns). Only planned files are read, each once for all plans.

    ``plans``: plan_id, files, start, end. One name per planned file reaches the driver, as the reader needs them. Where no planned file is there and missing
    ones may be skipped, the result is empty, of the columns of ``schema``."""
    pairs = plans.select("plan_id", "start", "end", F.explode("files").alias("source_file"))
    names = sorted(r.source_file for r in pairs.select("source_file").distinct().collect())
    paths = resolve_shards(spark, root, names, missing)
    if not paths:
        if schema is None:
            raise FileNotFoundError("none of the planned shards was found")
        none = spark.createDataFrame([], StructType([schema[c] for c in columns]))
        return none.join(pairs.select("plan_id", "source_file"), F.lit(False)).select("plan_id", "source_file", *columns)
    bounds = plans.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).first()
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+\.parquet)(?:/part-[^/]*)?$", 1)
    rows = spark.read.parquet(*paths.values()).where((F.col("batch_idx") >= bounds.lo) & (F.col("batch_idx") < bounds.hi)).select(*columns, F.col("batch_idx").alias("_at"), shard.alias("source_file"))
    met = rows.join(pairs, "source_file").where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end")))
    return met.select("plan_id", "source_file", *columns)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of the files of a folder, hashed as streams on the executors; paths are relative to the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/"
    named = F.element_at(F.split("path", re.escape(root), 2), -1).alias("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(sha256=[_digest(p) for p in pdf["full"]]).drop(columns="full")

    found = files.select(named, F.col("length").alias("size_bytes"), F.col("path").alias("full")).mapInPandas(run, "path string, size_bytes long, sha256 string")
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, folder, pattern)], "path string")
    return found.unionByName(empty.select(named, F.lit(0).cast("long").alias("size_bytes"), F.sha2(F.lit(b""), 256).alias("sha256")))


def _digest(uri: str) -> str:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    total = hashlib.sha256()
    with where.open_input_stream(path) as stream:
        while part := stream.read(1 << 20):
            total.update(part)
    return total.hexdigest()


# What an upload leaves out.
SKIPPED = (r"(^|/)__pycache__/", r"(^|/)\.DS_Store$", r"\.pyc$")


def artifact_records(files: DataFrame, prefix: str) -> DataFrame:
    """An inventory with the path in the repository, whether it is skipped, and whether it may go: not empty and with a digest."""
    skipped = F.lit(False)
    for pattern in SKIPPED:
        skipped = skipped | F.col("path").rlike(pattern)
    repo = F.concat_ws("/", F.lit(prefix.strip("/")), F.ltrim(F.col("path"), F.lit("/"))) if prefix.strip("/") else F.ltrim(F.col("path"), F.lit("/"))
    return files.select("path", repo.alias("path_in_repo"), "size_bytes", "sha256", skipped.alias("skipped"), ((F.col("size_bytes") > 0) & (F.length("sha256") == 64)).alias("ready"))


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The files without content, which Spark's reader leaves out; hidden ones aside, as there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and name[:1] not in ("_", ".") and fnmatch.fnmatchcase(name, pattern):
            out.append(f.getPath().toString())
    return out


def write_if_valid(df: DataFrame, violations: DataFrame, path: str) -> bool:
    """Writes only if no rule is violated; else leaves an empty table of the same schema. Says whether the rows were written."""
    bad = violations.where("violations > 0").count()
    (df.limit(0) if bad else df).write.mode("overwrite").parquet(path)
    return not bad
