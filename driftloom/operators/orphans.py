"""References to records that do not exist: direct orphans by edge, inherited orphans by fixpoint.

A foreign-key graph is given as ``Edge``s between named tables. ``direct_orphans`` finds, for one edge, the child rows whose
reference is missing, made before its parent existed (late) or after it was deleted. ``cascade`` then iterates semi-joins down the
graph: the children of an orphaned row are inherited orphans, until a round finds nothing new.

Scale: the child is first reduced to its distinct reference values with the extremes of its times (partial aggregation, so a hot
reference costs one row per task); only reference values that can be at fault go back to the rows. No side is broadcast by hint:
the planner decides by measured size.

Defined cases: a null reference is never an orphan; keys and references are compared as exact strings; a null child time
is never late nor after deletion; repeated child rows count once per key (the first fault in the order missing, late, deleted), rows without
a key once per time and fault;
an empty parent table makes every non-null reference missing; a parent time that is null never makes a reference late.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut

#: A reference that so many rows make is met in several tasks.
HOT = 1_000_000
REASONS = ("missing", "late", "deleted")


@dataclass(frozen=True)
class Edge:
    """child.ref -> parent.key; times may be None where the edge has no such rule."""

    child: str
    child_key: str
    ref: str
    parent: str
    parent_key: str
    child_time: str | None = None
    parent_created: str | None = None
    parent_deleted: str | None = None


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _time(column: str | None) -> Column:
    return (F.col(column) if column else F.lit(None)).cast("timestamp_ntz")


def parents_by_key(parent: DataFrame, edge: Edge) -> DataFrame:
    """One row per parent key: the least creation time, and the latest deletion if every copy is deleted."""
    return (
        parent.select(_text(edge.parent_key).alias("ref"), _time(edge.parent_created).alias("created"), _time(edge.parent_deleted).alias("deleted"))
        .where(F.col("ref").isNotNull())
        .groupBy("ref")
        .agg(F.min("created").alias("created"), F.when(F.count("deleted") == F.count(F.lit(1)), F.max("deleted")).alias("deleted"))
    )


def direct_orphans(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """(row_key, ref, at, reason), one row per child key."""
    rows = child.select(_text(edge.child_key).alias("row_key"), _text(edge.ref).alias("ref"), _time(edge.child_time).alias("at")).where(F.col("ref").isNotNull())
    refs = rows.groupBy("ref").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    at_fault = F.col("present").isNull() | (F.col("created") > F.col("first_at")) | (F.col("deleted") <= F.col("last_at"))
    last_salt = F.floor(F.col("n") / HOT).cast("int").alias("last_salt")
    suspect = cut(refs.join(parents_by_key(parent, edge).withColumn("present", F.lit(True)), "ref", "left").where(at_fault).select("ref", "present", "created", "deleted", last_salt))
    hot = suspect.where("last_salt > 0").select("ref", "last_salt")  # at most one per HOT rows of the child
    salted = rows.withColumn("salt", F.lit(0))
    if not hot.isEmpty():
        salt = F.coalesce(F.pmod(F.xxhash64("row_key", "at"), F.col("last_salt") + 1).cast("int"), F.lit(0))
        salted = rows.join(hot, "ref", "left").withColumn("salt", salt).drop("last_salt")
    suspect = suspect.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("last_salt")))).drop("last_salt")
    reason = F.when(F.col("present").isNull(), 0).when(F.col("created") > F.col("at"), 1).when(F.col("deleted") <= F.col("at"), 2)
    return (
        salted.join(suspect, ["ref", "salt"])
        .withColumn("rank", reason)
        .where(F.col("rank").isNotNull())
        .groupBy("row_key", F.when(F.col("row_key").isNull(), F.struct("ref", "at")).alias("_unnamed"))
        .agg(F.min(F.struct("rank", "at", "ref")).alias("first"))
        .select("row_key", F.col("first.ref").alias("ref"), F.col("first.at").alias("at"), F.element_at(F.array(*map(F.lit, REASONS)), F.col("first.rank") + 1).alias("reason"))
    )


def cascade(tables: Mapping[str, DataFrame], edges: Sequence[Edge], max_rounds: int = 64) -> DataFrame:
    """Direct and inherited orphans: (table_name, row_key, at, reason, kind, depth).

    A row that is a direct orphan by one edge is not reported as inherited by another. Rounds go on until nothing new is found
    (a self-reference ends as well, for known rows are removed each time); more than ``max_rounds`` levels raise an error
    rather than dropping rows.
    """
    found: DataFrame | None = None
    for edge in edges:
        rows = direct_orphans(tables[edge.child], tables[edge.parent], edge).select(F.lit(edge.child).alias("table_name"), "row_key", "at", "reason", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("at least one edge is needed")
    order = F.struct(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), "at", "reason")
    known = cut(found.groupBy("table_name", "row_key", F.when(F.col("row_key").isNull(), F.struct("at", "reason")).alias("_unnamed")).agg(F.min_by(F.struct("at", "reason", "kind", "depth"), order).alias("x")).select("table_name", "row_key", "x.*"))
    parents = {e.parent for e in edges}
    fresh = known
    for depth in range(1, max_rounds + 1):
        step: DataFrame | None = None
        tainted = {r.table_name for r in fresh.where(F.col("table_name").isin(sorted(parents))).select("table_name").distinct().collect()}
        for edge in (e for e in edges if e.parent in tainted):
            bad = fresh.where(F.col("table_name") == edge.parent).select(F.col("row_key").alias("bad_key"))
            if edge.parent_key != next((e.child_key for e in edges if e.child == edge.parent), edge.parent_key):
                own_key = next(e.child_key for e in edges if e.child == edge.parent)
                bad = tables[edge.parent].select(_text(own_key).alias("bad_key"), _text(edge.parent_key).alias("ref")).join(bad, "bad_key", "left_semi").select("ref").distinct()
            else:
                bad = bad.select(F.col("bad_key").alias("ref")).distinct()
            rows = tables[edge.child].select(_text(edge.child_key).alias("row_key"), _text(edge.ref).alias("ref"), _time(edge.child_time).alias("at")).where(F.col("ref").isNotNull())
            hit = rows.join(bad, "ref", "left_semi").groupBy("row_key").agg(F.min("at").alias("at"))
            hit = hit.select(F.lit(edge.child).alias("table_name"), "row_key", "at", F.lit("parent_orphaned").alias("reason"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"))
            step = hit if step is None else step.unionByName(hit)
        if step is None:
            return known
        step = step.groupBy("table_name", "row_key").agg(F.min("at").alias("at"), F.first("reason").alias("reason"), F.first("kind").alias("kind"), F.first("depth").alias("depth"))
        fresh = cut(step.join(known.select("table_name", "row_key"), ["table_name", "row_key"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"the reference graph is deeper than {max_rounds} levels")


def count_mismatches(manifests: DataFrame, orphans: DataFrame, key: str, claimed: Column) -> DataFrame:
    """Manifest keys whose claimed number of orphans is not null and differs from the number found: (row_key, claimed, found).

    ``orphans`` has a column of the same name as ``key`` per orphaned row. Repeated manifests count once per claim."""
    claims = manifests.select(F.col(key).cast("string").alias("row_key"), claimed.cast("long").alias("claimed")).where(F.col("row_key").isNotNull() & F.col("claimed").isNotNull()).distinct()
    found = orphans.groupBy(F.col(key).cast("string").alias("row_key")).agg(F.count(F.lit(1)).alias("found"))
    return claims.join(found, "row_key", "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") != F.col("claimed"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Rows per table, month, kind and reason; the month is null where the row has no time."""
    return orphans.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month"), "kind", "reason").agg(F.count(F.lit(1)).alias("orphans"))
