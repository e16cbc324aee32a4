"""Requests per key and window: a bucket that is refilled whole when its window is over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LimiterConfig


def limit_requests(events: DataFrame, key: str, ts: str, order: str, cfg: LimiterConfig = LimiterConfig()) -> DataFrame:
    """Each event with allowed, remaining and retry_after (seconds).

    A window begins with the first event at or after the end of the one before, so its begin
    depends on the chain of windows of the key: a fold over the key's event times, which are
    numbers only.  ``order`` breaks ties."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)
    rows = events.withColumn("_t", seconds)
    span = float(cfg.seconds)
    starts = F.expr(f"aggregate(_ts, named_struct('at', cast(null as double), 'out', cast(array() as array<double>)), (s, t) -> if(s.at is null or t - s.at >= {span}D, named_struct('at', t, 'out', concat(s.out, array(t))), s)).out")
    begins = rows.where("_t is not null").groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias("_ts")).select(F.col(key).alias("_key"), F.posexplode(starts).alias("_w", "_begin"))
    # the events that begin a window are marked by an equi-join, the others take the last mark before them
    marked = rows.where("_t is not null").join(begins, rows[key].eqNullSafe(begins["_key"]) & (F.col("_t") == F.col("_begin")), "left")
    so_far = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = marked.withColumn("_begin", F.last("_begin", ignorenulls=True).over(so_far))
    number = F.row_number().over(Window.partitionBy(key, "_begin").orderBy("_t", order))
    used = joined.withColumn("_n", number)
    allowed = F.col("_n") <= cfg.most
    retry = F.when(allowed, 0).otherwise(F.floor(F.lit(span) - (F.col("_t") - F.col("_begin"))) + 1)
    return used.select(*events.columns, allowed.alias("allowed"), F.greatest(F.lit(0), cfg.most - F.col("_n")).cast("int").alias("remaining"), retry.cast("int").alias("retry_after"))
