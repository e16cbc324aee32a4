"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Most rows and bytes a side may have to be broadcast; both are measured.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Rows of one key that ``spread_join`` leaves to one task.
HOT_ROWS = 1000

#: Seconds between two requests to collect garbage.
COLLECT_EVERY = 10.0
_collected = time.monotonic()

#: Most bytes of a batch that goes to a Python worker (one row at least).
BATCH_BYTES = 4 << 20

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; on one machine fall back to a new folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost nothing.

    What came before is not needed then; the files of its shuffles go when the driver's JVM collects
    garbage, which it is asked to from time to time, as jobs of many small shuffles fill disks before heaps."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    global _collected
    if time.monotonic() - _collected > COLLECT_EVERY:
        df.sparkSession._jvm.System.gc()
        _collected = time.monotonic()
    return kept


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` gave, once nothing reads it any more."""
    rdd = table._jdf.queryExecution().analyzed().rdd()
    kept = rdd.getCheckpointFile()
    if kept.isDefined():
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column in ``taken`` has it (case aside)."""
    used, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        found.append(name)
    return found


def attach(left: DataFrame, right: DataFrame, on: Column, how: str = "left", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``right``, broadcast only if its counted rows and measured bytes are few; otherwise both
    sides are shuffled and adaptive execution splits the keys that are skewed.

    ``right`` should be cheap to recompute or already cut.
    """
    width = F.octet_length(F.to_json(F.struct("*")))
    size = right.select(width.alias("width")).limit(max_rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes")).first()
    small = size["rows"] <= max_rows and size["bytes"] <= max_bytes
    return left.join(F.broadcast(right) if small else right, on, how)


def spread_join(left: DataFrame, right: DataFrame, key: str, other: str, rows: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, one row a key, on key = other; ``rows`` of ``right`` counts those of
    a key in ``left``.

    Keys with over ``HOT_ROWS`` rows, which are few, are joined apart, by broadcast as far as their measured
    size allows, so no task gathers their rows.  ``left`` is read twice and should be cut already."""
    hot = cut(right.where(F.col(rows) > HOT_ROWS).drop(rows))
    if hot.isEmpty():
        return left.join(right.drop(rows), F.col(key) == F.col(other))
    keys = hot.select(F.col(other).alias("_hot"))
    rest = attach(left, keys, F.col(key) == F.col("_hot"), "left_anti").join(right.where(F.col(rows) <= HOT_ROWS).drop(rows), F.col(key) == F.col(other))
    return attach(left, hot, F.col(key) == F.col(other), "inner").unionByName(rest)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, in batches of few bytes: executor and worker hold several copies of each.

    The bound is a setting of the session, since Spark reads it when the plan starts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
