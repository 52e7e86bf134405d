"""Top N items within every group by secondary sort.

Rows are hash-partitioned by group and sorted within partitions by group, scores and identifier; Arrow batches are then streamed and the first
N rows of each group are emitted. No group is ever buffered: the state between batches is the current group and the at most N identifiers
already emitted for it. Because a group may hold a large part of all rows, the same pass first runs on the input partitions as
they lie, so that at most N rows per group and input partition are shuffled.

Defined cases: rows with a null group or without a finite first score are left out; other scores sort with nulls last, NaN above all
numbers; equal scores are ordered by identifier, nulls last; an identifier counts once per group (its best row), null identifiers count each;
groups smaller than N give all they have; an empty table gives an empty result; n < 1 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_rows(n: int, group: str, ident: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, emitted = None, set(), 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            groups, ids = batch.column(group), batch.column(ident)
            starts = [0]
            if size > 1:
                starts += [i + 1 for i in pc.indices_nonzero(pc.not_equal(groups.slice(1), groups.slice(0, size - 1))).to_pylist()]
            starts.append(size)
            take: list[int] = []
            for lo, hi in zip(starts, starts[1:]):
                key = groups[lo].as_py()
                if key != current:
                    current, seen, emitted = key, set(), 0
                at = lo
                while at < hi and emitted < n:  # ends after N rows and the repeats between them
                    i = ids[at].as_py()
                    if i is None or i not in seen:
                        seen.add(i)
                        take.append(at)
                        emitted += 1
                    at += 1
            if take:
                yield batch.take(pa.array(take, pa.int64()))

    return run


def finite(column: str) -> Column:
    c = F.col(column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def top_n_per_group(df: DataFrame, group: str, scores: Sequence[str], ident: str, n: int) -> DataFrame:
    """The first n rows of each group in the order scores descending (nulls last), ident ascending: (group, *scores, ident)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.where(F.col(group).isNotNull() & finite(scores[0])).select(group, *scores, ident)
    order = [F.col(group), *(F.col(s).desc_nulls_last() for s in scores), F.col(ident).asc_nulls_last()]
    pass_ = _first_rows(n, group, ident)
    local = rows.sortWithinPartitions(*order).mapInArrow(pass_, rows.schema)
    return local.repartition(F.col(group)).sortWithinPartitions(*order).mapInArrow(pass_, rows.schema)
