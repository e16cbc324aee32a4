"""A stream of blocks or texts through the batch plan, each document once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.structure import Structure, structure
from ..sources.text import text_blocks


def without_repeats(texts: DataFrame, text: str = "text", arrived: str = "ts", within: str = "1 day") -> DataFrame:
    """Texts of a stream, each once in ``within`` of event time; the state is bounded by that."""
    return texts.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withWatermark(arrived, within).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def structure_stream(texts: DataFrame, sink: Callable[[Structure, int], None], checkpoint: str, text: str = "text", doc_id: str = "doc_id", once: bool = False):
    """Start a query that structures each micro-batch and hands it to ``sink``.

    ``sink`` gets the batch's number too, so that a repeated batch can replace itself.  ``once``: end
    when what is there now is done."""

    def one_batch(batch: DataFrame, number: int) -> None:
        sink(structure(text_blocks(batch, text, doc_id)), number)

    writer = texts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
