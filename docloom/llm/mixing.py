"""Mixing sources to target weights.

Words are summed per source (partial sums before the shuffle), each source gets a
target and so a repetition rate, and each document is emitted ``floor(rate)`` times
plus once more with the fraction as probability, drawn from a hash of its id.  All of
it is column expressions; the texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and its documents are taken 0 times; equal ids
share one draw, so repeated rows are taken equally often; an empty table gives an empty
result; texts of any length are counted whole.  ``plan_mix`` replaces columns named like an added one;
``mix_sources`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, fresh, n_words

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row per source.

    Sources by code point weigh ``weights`` in turn and share the sum of all sizes.  No
    target exceeds ``most`` times its source's size; what is cut off goes to the others by
    weight.  The level at which this ends is found without iterating: ordered by the level
    at which they are full, the sources before the first that stays below are full.

    The windows without a partition see one row per source, not documents.
    """
    n, lcm = len(weights), math.lcm(*weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")).cast("long")
    fills = Window.orderBy("_fills_at", F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    onward = fills.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("source_size") * most
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_fills_at", F.col("source_size") * F.expr(f"{lcm} div _weight"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(onward))
        .withColumn("_open", F.col("_left") * F.col("_weight") <= full * F.col("_weights"))
        .withColumn("_level", F.min(F.when(F.col("_open"), F.struct("_fills_at", F.col("source").isNull(), "source", "_left", "_weights"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("_open"), (F.col("_level._left") * F.col("_weight")).cast("double") / F.col("_level._weights")).otherwise(full.cast("double")).alias("target"),
        )
    )


def draw(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id: the same in every run and on every cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` with size, source_size, target (its source's) and copies."""
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(docs[text]))
    (of,) = fresh(sized.columns, "_source")
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, most).withColumnRenamed("source", of))
    joined = attach(sized, targets, sized[source].eqNullSafe(targets[of])).drop(of)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return joined.withColumn("copies", (F.floor(rate) + (draw(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    packed = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    planned = plan_mix(packed, **options)
    return planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_whole.*")
