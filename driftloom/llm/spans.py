"""Long exact spans shared between records, by winnowed anchors and extension.

Every window of ``length`` ids (the threshold) contains an anchor: the least of the hashes of its K-grams. Two equal windows have the same anchor,
so records that share a span of the threshold length share at least one anchor. The steps:

1. seed: the anchors of each record (about 2 / (length - K + 2) per id); an anchor is shared if it occurs under two record ids, which the least and
   the greatest id per anchor tell (partial aggregation: a hot anchor costs one row per task);
2. extend: around each shared anchor, all windows of threshold length that contain it are hashed (128 bits) with their offset and the ids on both
   sides. A window found under two record ids is shared. The extension of a match is read off these windows rather than made again for each pair
   of records: to the left it ends where two equal windows have different ids before them (or one starts its record), to the right where the ids
   after them differ (or one ends its record);
3. maximal repeats: per pair of records and diagonal (difference of offsets), left and right ends alternate, so each left end and the right end that
   follows it are one maximal repeat with its starts and its length. Inner windows of a repeat, however many records hold it, form no pairs.

``classes`` tells the same linearly, for spans that very many records hold: maximal runs of windows along which the set of places that share them
stays the same, each with the name of that set, its records and its places. All places of a class hold the same ids.

Scale: classes and coverage never form pairs and are linear in the input, hot spans included. ``repeats`` and ``pairs`` are as large as their own result;
the places of a hot window are cut into groups of GROUP, and each pair of groups meets in a task of its own.

Defined cases: rows of one record id are one record and never pair, equal rows of one are one row; null ids and null or short arrays (under ``length``) share nothing; a null
element is an id of its own; an empty table gives empty results; equality is by 128-bit hashes of the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.session import cut

K = 16
#: Places of one window that meet in one task.
GROUP = 1000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _grams(v: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of the n ids from each position on, by doubling; the last n - 1 positions hold no meaning."""
    power, size, whole, done = v, 1, None, 0
    while True:
        if n & size:
            whole = power if whole is None else whole * np.uint64(pow(base, size, 1 << 64)) + _shift(power, done)
            done += size
        if size * 2 > n:
            return whole
        power = power * np.uint64(pow(base, size, 1 << 64)) + _shift(power, size)
        size *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each position on."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x, _pad(x, size))
        size *= 2
    return np.minimum(x, _pad(x, w - size)) if w > size else x


def _pad(x: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(x, _MASK)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the record of each id, the end of each record."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        column = column.fill_null([]) if hasattr(column, "fill_null") else column
        ids = column.flatten()
    else:
        lengths, ids = np.diff(offsets), column.flatten()
    flat = ids.cast(pa.int64()).fill_null(-(1 << 40)).to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)


def _anchored(flat: np.ndarray, record: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window from each position on, and whether that window lies within its record."""
    seeds = _mix(_grams(_mix(flat, 1), K, _BASES[0]), 2)
    return _least(seeds, length - K + 1), np.arange(len(flat)) + length <= ends[record]


def anchors(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(anchor, rid): rid is a 64-bit hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, record, ends = _flat(batch.column("ids"))
            anchor, inside = _anchored(flat, record, ends, length)
            new = inside.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | (record[1:] != record[:-1])
            rid = batch.column("rid").to_numpy()[record[new]]
            yield pa.record_batch([pa.array(anchor[new].view(np.int64)), pa.array(rid)], names=["anchor", "rid"])

    return _keyed(df, key, ids).select("rid", "ids").mapInArrow(run, "anchor long, rid long")


def _keyed(df: DataFrame, key: str, ids: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(ids).isNotNull()).select(F.col(key).cast("string").alias("key"), F.xxhash64(F.col(key).cast("string")).alias("rid"), F.xxhash64(ids).alias("version"), F.col(ids).cast("array<long>").alias("ids"))


def windows(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """Windows around shared anchors: (h1, h2, key, version, before, after, at); before and after are null at a record's ends.

    Rows of one key with other ids are other versions of it."""
    if length <= K:
        raise ValueError(f"the least length must exceed {K}")
    seeds = anchors(df, key, ids, length)
    shared = seeds.groupBy("anchor").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("anchor")
    hits = seeds.join(shared, "anchor", "left_semi").groupBy("rid").agg(F.collect_set("anchor").alias("wanted"))  # at most a record's own anchors
    texts = _keyed(df, key, ids).where(F.size("ids") >= length).join(hits, "rid").select("key", "version", "ids", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, record, ends = _flat(batch.column("ids"))
            if not len(flat):
                continue
            anchor, keep = _anchored(flat, record, ends, length)
            wanted = batch.column("wanted")
            for i, end in enumerate(ends):
                start = ends[i - 1] if i else 0
                own = np.sort(wanted[i].values.to_numpy().view(np.uint64))
                spot = np.minimum(np.searchsorted(own, anchor[start:end]), len(own) - 1)
                keep[start:end] &= own[spot] == anchor[start:end]
            at = np.flatnonzero(keep)
            starts = (np.concatenate([[0], ends[:-1]]))[record]
            h = [_mix(_grams(_mix(flat, 3 + j), length, b), 7 + j)[at].view(np.int64) for j, b in enumerate(_BASES)]
            before = pa.array(flat[np.maximum(at - 1, 0)], mask=at == starts[at])
            after = pa.array(flat[np.minimum(at + length, len(flat) - 1)], mask=at + length == ends[record[at]])
            yield pa.record_batch([pa.array(h[0]), pa.array(h[1]), *(batch.column(c).take(pa.array(record[at])) for c in ("key", "version")), before, after, pa.array((at - starts[at]).astype(np.int32))], names=["h1", "h2", "key", "version", "before", "after", "at"])

    return texts.mapInArrow(run, "h1 long, h2 long, key string, version long, before long, after long, at int")


def _shared(rows: DataFrame) -> DataFrame:
    """The distinct places of windows that occur under two keys."""
    groups = rows.groupBy("h1", "h2").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h1", "h2")
    return rows.join(groups, ["h1", "h2"], "left_semi")


def shared_windows(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(key, at), one row per window that occurs under another key too."""
    return _shared(cut(windows(df, key, ids, length).select("h1", "h2", "key", "at").distinct())).select("key", "at").distinct()


def covered(shared: DataFrame, length: int) -> DataFrame:
    """What the shared windows cover of each key, whoever shares them: (key, start, n_ids). Overlapping and touching windows join up."""
    by = Window.partitionBy("key").orderBy("at")
    rows = shared.withColumn("new", (F.col("at") > F.lag("at").over(by) + length) | F.lag("at").over(by).isNull())
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "run").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + length).alias("n_ids")).drop("run")


def classes(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(key, start, n_ids, class, records, places): maximal stretches along which the same places share the same ids.

    The set of places of a window is told by the sum of their hashes; a window goes on with the one before it where the sum of its places, each moved
    back by one, is the sum of that one's places. Only one row per window and place is ever grouped."""
    rows = _shared(cut(windows(df, key, ids, length).select("h1", "h2", "key", "version", "at").distinct()))
    place = [F.xxhash64(F.col("key"), F.col("version"), F.col("at") - k).cast("decimal(38,0)") for k in (0, 1)]
    sets = rows.groupBy("h1", "h2").agg(F.sum(place[0]).alias("own"), F.sum(place[1]).alias("prior"), F.count(F.lit(1)).alias("places"), F.count_distinct("key").alias("records"))
    by = Window.partitionBy("key", "version").orderBy("at")
    told = rows.join(sets, ["h1", "h2"])
    goes_on = (F.lag("at").over(by) == F.col("at") - 1) & (F.lag("own").over(by) == F.col("prior")) & (F.lag("places").over(by) == F.col("places"))
    told = told.withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    told = told.withColumn("run", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct("own", "records", "places"), "at")
    runs = told.groupBy("key", "version", "run").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + length).alias("n_ids"), first.alias("x"))
    return runs.select("key", "start", "n_ids", F.xxhash64("x.own", "n_ids").alias("class"), "x.records", "x.places").distinct()


def coverage(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(key, n_ids, shared_ids, shared_share) for every key; n_ids is that of its longest row."""
    held = covered(shared_windows(df, key, ids, length), length).groupBy("key").agg(F.sum("n_ids").alias("shared_ids"))
    sizes = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max(F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids))).alias("n_ids"))
    shared = F.coalesce("shared_ids", F.lit(0))
    return sizes.join(held, "key", "left").select("key", "n_ids", shared.alias("shared_ids"), F.when(F.col("n_ids") > 0, shared / F.col("n_ids")).otherwise(0.0).alias("shared_share"))


def _met(rows: DataFrame, side: str) -> DataFrame:
    """(key_a, key_b, version_a, version_b, at_a, at_b) of places of equal windows under different keys, key_a < key_b, where the ids on one side of them end the match."""
    extremes = [F.min(side).alias("lo"), F.max(side).alias("hi"), F.count_if(F.col(side).isNull()).alias("bare"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), F.count(F.lit(1)).alias("n")]
    ends = rows.groupBy("h1", "h2").agg(*extremes).where("key_lo < key_hi AND (bare > 0 OR lo < hi)")
    groups = F.ceil(F.col("n") / GROUP).cast("int")
    held = rows.join(ends.select("h1", "h2", groups.alias("groups")), ["h1", "h2"]).withColumn("own", F.pmod(F.xxhash64("key", "version", "at"), F.col("groups")).cast("int"))
    held = held.select("h1", "h2", "key", "version", "at", F.col(side).alias("side"), "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
    a = held.select("h1", "h2", F.col("own").alias("g"), F.col("other").alias("h"), F.col("key").alias("key_a"), F.col("version").alias("version_a"), F.col("at").alias("at_a"), F.col("side").alias("side_a"))
    b = held.select("h1", "h2", F.col("other").alias("g"), F.col("own").alias("h"), F.col("key").alias("key_b"), F.col("version").alias("version_b"), F.col("at").alias("at_b"), F.col("side").alias("side_b"))
    differ = F.col("side_a").isNull() | F.col("side_b").isNull() | (F.col("side_a") != F.col("side_b"))
    return a.join(b, ["h1", "h2", "g", "h"]).where((F.col("key_a") < F.col("key_b")) & differ).select("key_a", "key_b", "version_a", "version_b", "at_a", "at_b")


def repeats(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(key_a, start_a, key_b, start_b, n_ids), key_a < key_b: every maximal repeat of at least ``length`` ids of two keys."""
    rows = cut(windows(df, key, ids, length).distinct())
    ends = _met(rows, "before").withColumn("right", F.lit(False)).unionByName(_met(rows, "after").withColumn("right", F.lit(True))).distinct()
    by = Window.partitionBy("key_a", "key_b", "version_a", "version_b", F.col("at_a") - F.col("at_b")).orderBy("at_a", "right")
    found = ends.withColumn("_last", F.lead("at_a").over(by)).where("NOT right")
    return found.select("key_a", F.col("at_a").alias("start_a"), "key_b", F.col("at_b").alias("start_b"), (F.col("_last") - F.col("at_a") + length).alias("n_ids")).distinct()


def pairs(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """(key_a, key_b), key_a < key_b, once per pair of keys that have a maximal repeat of at least ``length`` ids: where one begins, one is."""
    rows = cut(windows(df, key, ids, length).select("h1", "h2", "key", "version", "at", "before").distinct())
    return _met(rows, "before").select("key_a", "key_b").distinct()
