"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded selection.

The total is the largest at which every source can give its share without using a text more than ``max_repeats`` times. It is divided into
equal-token blocks, which go to sources by highest quotients share / (2 k + 1), and each source's blocks go to its shards by the same
rule, weighted with what a shard has to give. Within a shard, whole passes over all texts come first; the rest of the quota is taken in the
order of a seeded hash until the tokens come closest to the quota.

Scale: texts are counted once however many identifiers carry them (an identifier for a text of 128 bits is what is shuffled, not the text). Only one
row per source and shard reaches the driver, one for each ``shard_tokens`` tokens (125,000 for 25 million million tokens). A source is spread over
shards of about ``shard_tokens`` tokens, so that no source, however large, is ordered in one task; a shard holds identifiers and sizes.

Defined cases: source names are compared in lower case, trimmed, with blanks and hyphens as underscores; sources without a target, null
sources and texts of 0 tokens are not used; a target source without any text cannot give its share, so the others share the whole in proportion
and the report shows it with 0; a null max_repeats is 1; a text found in several sources belongs to the one of its least identifier; an empty
table gives an empty mix.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.tokens import RANKS, token_count
from driftloom.session import cut, spread


def source_key(source: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(source) if isinstance(source, str) else source)), r"[\s\-]+", "_")


def sainte_lague(weights: Mapping, seats: int, caps: Mapping | None = None) -> dict:
    """Seats by highest quotients weight / (2 k + 1); ties go to the lesser key. No key gets more than its cap.

    All seats but a few per key are given at once: with seats * weight / total rounded down less one, no key is above its final
    number unless caps bind, in which case the surplus goes round again by quotients."""
    weights = {k: Fraction(w) for k, w in weights.items() if w > 0}
    total = sum(weights.values())
    won = dict.fromkeys(weights, 0)
    cap = {k: caps[k] if caps else seats for k in weights}
    if total:
        won = {k: max(0, min(cap[k], int(seats * w / total) - 1)) for k, w in weights.items()}
    heap = [(-w / (2 * won[k] + 1), k) for k, w in weights.items() if won[k] < cap[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < cap[k]:
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


def texts_of(df: DataFrame, ident: str, text: str, source: str, ranks: str = RANKS) -> DataFrame:
    """One row per distinct text of at least one token: (text_id, ident, source, n_tokens)."""
    a, b = F.xxhash64(text), F.xxhash64(F.lit(11), F.col(text), F.length(text))
    some = spread(df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(ident, text, source), ident)
    rows = some.select(F.format_string("%016x%016x", a, b).alias("text_id"), F.struct(F.col(ident).alias("id"), source_key(source).alias("source"), token_count(text, ranks).alias("n")).alias("x"))
    return rows.groupBy("text_id").agg(F.min("x").alias("x")).select("text_id", F.col("x.id").alias(ident), F.col("x.source").alias("source"), F.col("x.n").alias("n_tokens"))


def mix(spark: SparkSession, texts: DataFrame, targets: DataFrame, seed: int = 1729, blocks: int = 10_000, shard_tokens: int = 200_000_000, total: int | None = None) -> DataFrame:
    """(columns of ``texts``, uses), uses >= 1 the number of times a text is taken.

    ``targets``: source, target_share, max_repeats; a small table that is read on the driver (one row per source)."""
    wanted = {r.source: r for r in targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("target_share > 0 AND source IS NOT NULL").collect()}
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "text_id"), 256)
    held = cut(texts.where(F.col("source").isin(sorted(wanted)) & (F.col("n_tokens") > 0)).withColumn("priority", order))
    have = {r.source: r.n for r in held.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = {s: Fraction(r.target_share) for s, r in wanted.items() if have.get(s)}
    whole = sum(shares.values())
    most = min((int(have[s] * (wanted[s].max_repeats or 1) * whole / w) for s, w in shares.items()), default=0)
    total = most if total is None else min(total, most)
    size = max(1, total // blocks)
    quota = sainte_lague(shares, total // size)
    shards = F.create_map(*(F.lit(x) for s in sorted(have) for x in (s, max(1, -(-have[s] // shard_tokens))))) if have else F.create_map(F.lit(""), F.lit(1))
    sharded = held.withColumn("shard", F.pmod(F.xxhash64("text_id"), shards[F.col("source")]).cast("int"))
    plan = []
    by_shard: dict[str, dict[int, int]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
        by_shard.setdefault(r.source, {})[r.shard] = r.n
    for s, own in by_shard.items():
        caps = {k: n * (wanted[s].max_repeats or 1) // size + 1 for k, n in own.items()}
        for k, seats in sainte_lague(own, quota.get(s, 0), caps).items():
            tokens = min(seats * size, own[k] * (wanted[s].max_repeats or 1))
            plan.append((s, k, tokens // own[k], tokens % own[k]))
    quotas = spark.createDataFrame(plan, "source string, shard int, passes long, part long")  # one row per source and shard
    upto = Window.partitionBy("source", "shard").orderBy("priority", "text_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = sharded.join(F.broadcast(quotas), ["source", "shard"]).withColumn("_upto", F.sum("n_tokens").over(upto))
    part = (F.col("_upto") - F.col("n_tokens") / 2 <= F.col("part")).cast("int")  # the half that lies within decides
    uses = (F.col("passes") + part).cast("int").alias("uses")
    return rows.select(*texts.columns, uses).where("uses > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and actual share, tokens, texts and the most uses of a text."""
    own = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    names = targets.select(source_key("source").alias("source"), "target_share", "max_repeats")
    all_ = own.agg(F.sum("tokens").alias("all_tokens"))  # one row
    rows = names.join(own, "source", "left").crossJoin(all_)
    tokens = F.coalesce("tokens", F.lit(0))
    share = F.when(F.col("all_tokens") > 0, tokens / F.col("all_tokens")).otherwise(0.0)
    return rows.select("source", "target_share", share.alias("actual_share"), tokens.alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
