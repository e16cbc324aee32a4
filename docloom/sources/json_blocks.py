"""Blocks, given headings and answers of routers from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BLOCK_FIELDS, BLOCK_TYPES

_BLOCK = T.StructType([T.StructField("id", T.IntegerType()), *[f for f in BLOCK_FIELDS if f.name not in ("pos", "block_id")]])
REQUEST = T.StructType([T.StructField("title", T.StringType()), T.StructField("authors", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK))])
TRUTH = "doc_title string, doc_authors string, headings array<struct<block_id int, title string, level int>>"


def read_requests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """doc_id, title, authors, blocks (array): a request in each line, or in each file."""
    rows = spark.read.schema(REQUEST).option("multiLine", multiline).json(path)
    return rows.withColumn("doc_id", F.xxhash64(F.col("_metadata.file_path"), F.to_json(F.struct(*rows.columns))))


def _known() -> Column:
    return F.coalesce(F.col("b.type").isin(*BLOCK_TYPES) & F.col("b.id").isNotNull(), F.lit(False))


def refused_blocks(requests: DataFrame) -> DataFrame:
    """doc_id, pos, error: the blocks of unknown type or without an id, which no document gets."""
    placed = requests.select("doc_id", F.posexplode("blocks").alias("pos", "b")).where(~_known())
    error = F.when(F.col("b.id").isNull(), F.lit("no id")).otherwise(F.concat(F.lit("unknown type: "), F.coalesce("b.type", F.lit("null"))))
    return placed.select("doc_id", "pos", error.alias("error"))


def request_blocks(requests: DataFrame) -> DataFrame:
    """The blocks of requests with any ids, in list order; those that ``refused_blocks`` has are left out."""
    placed = requests.select("doc_id", F.posexplode("blocks").alias("pos", "b")).where(_known())
    fields = {"pos": F.col("pos"), "block_id": F.col("b.id"), "is_bold": F.coalesce("b.is_bold", F.lit(False)), "is_heading_style": F.coalesce("b.is_heading_style", F.lit(False))}
    return placed.select("doc_id", *[fields.get(f.name, F.col(f"b.{f.name}") if f.name not in fields else None).cast(f.dataType).alias(f.name) for f in BLOCK_FIELDS])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """stem, ord, block_id, level, title of the headings given for each document, by file name."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    return rows.select("stem", F.posexplode("headings").alias("ord", "h")).select("stem", "ord", "h.block_id", "h.level", "h.title")
