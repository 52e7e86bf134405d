"""Filling containers of fixed capacity by minimum bin slack.

Bins are filled one after the other: the largest remaining item opens a bin, then a subset-sum dynamic programme over the lengths still available,
with the reachable sums as the bits of one integer, finds the fullest feasible combination, which is removed. The programme takes lengths in
descending order and stops as soon as a perfect fill is reachable. Items above the capacity are cut into full containers and a rest;
nothing else is ever split.

Scale: what fits together depends on the lengths alone, so the whole corpus is planned from the counts of its lengths, at most ``capacity`` numbers. A
combination that is the fullest stays so for as long as its lengths last, since fewer items reach no more sums; so it is taken as often as they last, and
the plan grows with the lengths, not with the items. Items of one length are numbered in cells by a hash of their identifier, and the plan
says which bin each number is for. All items are placed, in one pass, and the result is the same in every layout.

Defined cases: an item of size 0 (null or empty text) is placed in the first bin; equal items are told apart by identifier;
a repeated identifier is an error of the caller's keys, and its rows are placed each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.session import cut

#: Most cells that the items of one length are numbered in.
CELLS = 4096


def fullest(counts: dict[int, int], lengths: list[int], space: int) -> list[int]:
    """A sub-multiset of the available lengths with the greatest sum not above ``space``; ``lengths`` is descending."""
    full = (1 << (space + 1)) - 1
    reach, steps = 1, []
    goal = 1 << space
    for length in lengths:
        if length > space:
            continue
        left, chunk = min(counts[length], space // length), 1
        while left:  # copies by doubling
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            chunk *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """What goes into bins together: (items of each length, number of such bins); every length must lie between 1 and the capacity."""
    counts = dict(counts)
    lengths, steps = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        own = Counter([first, *fullest(counts, lengths, capacity - first)])
        counts[first] += 1
        times = min(counts[s] // m for s, m in own.items())
        for s, m in own.items():
            counts[s] -= m * times
        lengths = [s for s in lengths if counts[s]]
        steps.append((dict(own), times))
    return steps


def _places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The plan for items in order of their lengths, as columns: from which item on, step of the plan, first bin, items of a bin."""
    taken: dict[int, int] = {}
    at = 0
    for length in sorted(counts):
        taken[length] = at
        at += counts[length]
    rows, bins = [], 0
    for step, (own, times) in enumerate(plan({s: n for s, n in counts.items() if s}, capacity)):
        for s, m in own.items():
            rows.append((taken[s], step, bins, m))
            taken[s] += m * times
        bins += times
    if counts.get(0):
        rows.append((0, 0, 0, counts[0]))
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


def place(sizes: DataFrame, ident: str, size: str, capacity: int, block_items: int = 2_000) -> DataFrame:
    """(ident, piece, n_tokens, round, block, bin): one row per item, or per piece of an item above the capacity. ``bin`` is the bin's number, ``round`` the
    step of the plan it belongs to, ``block`` tells bins in blocks of ``block_items``."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.col(size).cast("long")
    pieces = F.when(n > capacity, F.sequence(F.lit(0), (F.ceil(n / capacity) - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    items = sizes.select(ident, n.alias("_n"), F.explode(pieces).alias("piece"))
    items = cut(items.select(ident, "piece", F.least(F.greatest(F.coalesce("_n", F.lit(0)) - F.col("piece") * capacity, F.lit(0)), F.lit(capacity)).cast("int").alias("n_tokens")))
    counts = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()}  # capacity + 1 rows at most
    lengths, shorter = np.array([*counts], np.int64), np.cumsum([0, *counts.values()])
    shared = sizes.sparkSession.sparkContext.broadcast((lengths, shorter, _places(counts, capacity)))

    @F.pandas_udf("round int, block int, bin long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, shorter, (start, step, first, m) = shared.value
        at = shorter[np.searchsorted(lengths, length.to_numpy())] + number.to_numpy()
        i = np.searchsorted(start, at, "right") - 1
        bins = first[i] + (at - start[i]) // m[i]
        return pd.DataFrame({"round": step[i].astype(np.int32), "block": (bins // block_items).astype(np.int32), "bin": bins})

    cells = min(CELLS, max(1, -(-max(counts.values(), default=0) // block_items)))
    items = items.withColumn("_cell", F.pmod(F.xxhash64(ident, "piece"), F.lit(cells)).cast("int"))
    whole = items.groupBy("n_tokens", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = whole.select("n_tokens", "_cell", (F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_cell")) - F.col("_n")).alias("_before"))  # CELLS rows a length at most
    own = F.row_number().over(Window.partitionBy("n_tokens", "_cell").orderBy(ident, "piece")) - 1
    numbered = items.withColumn("_own", own).join(before, ["n_tokens", "_cell"])
    return numbered.select(ident, "piece", "n_tokens", placed("n_tokens", F.col("_before") + F.col("_own")).alias("_p")).select(ident, "piece", "n_tokens", "_p.round", "_p.block", "_p.bin")


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: bins, tokens, full bins, mean fill, and the least number of bins possible at all."""
    bins = placed.groupBy("round", "block", "bin").agg(F.sum("n_tokens").alias("used"))
    report = bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count_if(F.col("used") == capacity).alias("full_bins"), F.coalesce(F.max("used"), F.lit(0)).alias("largest"))
    return report.withColumn("fill", F.when(F.col("bins") > 0, F.col("tokens") / (F.col("bins") * capacity))).withColumn("least_bins", F.ceil(F.col("tokens") / capacity))
