"""Incremental, resumable processing: pending work by anti-join, and file streams that end when all there is has been read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(selected: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected rows whose key is not completed; null keys are always pending."""
    return selected.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def ingest_available(spark: SparkSession, folder: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Appends what is new in a folder of Parquet files to ``out``; each file is taken once, however often this is called."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _listed(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _parts(spark: SparkSession, out: str, before: int | None = None) -> dict[int, list[int]]:
    """The epochs, ascending, that wrote each bucket of the state."""
    held: dict[int, list[int]] = {}
    epochs = sorted(int(n.split("=")[1]) for n in _listed(spark, out) if n.startswith("epoch="))
    for epoch in (e for e in epochs if before is None or e < before):
        names = _listed(spark, f"{out}/epoch={epoch}")
        if "_SUCCESS" in names:
            for n in names:
                if n.startswith("_bucket="):
                    held.setdefault(int(n.split("=")[1]), []).append(epoch)
    return held


def state(spark: SparkSession, out: str, schema, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows that ``upsert_available`` keeps: of each bucket, what the last epoch to write it has."""
    parts = {b: epochs[-1] for b, epochs in _parts(spark, out, before).items() if buckets is None or b in buckets}
    paths = [f"{out}/epoch={e}/_bucket={b}" for b, e in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_available(spark: SparkSession, folder: str, schema, key: str, order: str, out: str, checkpoint: str, buckets: int = 64, files: int = 1000) -> None:
    """Keeps the last row per key in ``out``, read by ``state``: the row of greatest ``order``, of equal ones that of greatest content.

    The state lies in buckets by the hash of the key. A batch (up to ``files`` new files) reads and writes only the buckets of its own keys, as a new epoch; an
    epoch that is run again reads what came before it, so it writes the same. What two later epochs have superseded is removed."""

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # one row per bucket
        if not touched:
            return
        rest = [c for c in batch.columns if c != key]
        both = state(session, out, batch.schema, touched, epoch).select(batch.columns).unionByName(batch)
        rank = F.struct(F.col(order), F.to_json(F.struct(*rest)))
        last = both.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("x")).select(key, "x.*")
        last.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{out}/epoch={epoch}")
        for b, epochs in _parts(session, out, epoch).items():
            for old in epochs[:-1]:
                at = session._jvm.org.apache.hadoop.fs.Path(f"{out}/epoch={old}/_bucket={b}")
                at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, at: str, width: str, key: str, late: str = "1 hour") -> DataFrame:
    """Counts per time window and key; on a stream, rows later than ``late`` are left out. An extension for event tables."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("_w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("_w.start").cast("timestamp_ntz").alias("start"), key, "events")
