"""From raw documents to token ids in five stages, each one of the corpus operators.

1. quality classifier: documents that it rejects go;
2. line dedup: runs of lines, of 50 words or more, that occur earlier in the corpus go;
3. SimHash near-dedup: of each group of near copies (a similarity of 0.8 or more on five-word
   shingles) the document with the smallest id stays;
4. mixing: documents are repeated or left out until the sources have their target weights;
5. SentencePiece: every remaining row is encoded, and decoded again to see that nothing is lost.

Every stage but the last returns the columns it got, whatever their names.  Null texts count as empty and
stay null, repeated rows are one document to stages 2 and 3, texts of any length are read whole, and empty
tables give empty results; each operator states the rest.

``run`` writes each stage's rows to a table in the session's checkpoint folder and reads them
back, so a lost executor costs no earlier stage, and drops a table once the next one is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing, pieces, quality, simhash
from docloom.llm.common import ensure_checkpoint_dir, fresh, read
from docloom.llm.queries import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels, accepts."""
    model = quality.train_model(docs, read(spark, sf_dir, "labels"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    return quality.score_documents(docs, model, score_name=score, predicted=predicted).where(F.col(predicted) == 1).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles; no such pair is lost."""
    return simhash.keep_one(docs, simhash.similar_documents(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, token_ids, n_tokens and whether decoding gives the text."""
    coded = pieces.encode_texts(docs, piece_model(), decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: The classifier and the search for near copies are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
