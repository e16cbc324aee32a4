"""What the plans need of the session: a shared folder to cut lineage in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


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
    """``df`` computed once and kept in the shared folder, so that lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes for a core, up to which a table in fewer files than there are cores is dealt over all of them.
SPREAD_BYTES = 128 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table read from files; small ones in a few files, which one task each would read, over all cores.

    The sizes are those that Spark's own listing of the files has; large tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size <= cores * SPREAD_BYTES and len(table.inputFiles()) < cores else table
