"""Plain text files as blocks: decoded by trying charsets, cut into paragraphs or lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import structured_line
from ..functions.text import SPACE, strip
from ..schema import BLOCK_FIELDS

# The charsets in the order in which they are tried; the last always fits.
CHARSETS = ("utf-8-sig", "utf-8", "utf-16", "gb18030", "gbk", "big5", "latin-1")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """The text of the first charset that fits."""

    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for charset in CHARSETS:
            try:
                return bytes(raw).decode(charset)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(decode)


def paragraphs(text: Column) -> Column:
    """Blocks of a text: parts between blank lines; their lines apart if many are list items,
    joined by spaces otherwise."""
    plain = F.regexp_replace(text, r"\r\n|\r", "\n")
    # a blank line may hold any white space
    chunks = F.filter(F.transform(F.split(plain, rf"\n{SPACE}*\n+"), strip), lambda c: c != "")

    def pieces(chunk: Column) -> Column:
        lines = F.filter(F.transform(F.split(chunk, "\n"), strip), lambda x: x != "")
        listed = F.size(F.filter(lines, structured_line))
        keep = (F.size(lines) <= 1) | (listed >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2)))
        return F.when(keep, lines).otherwise(F.array(F.array_join(lines, " ")))

    return F.flatten(F.transform(chunks, pieces))


def blocks_of_strings(rows: DataFrame, strings: str, source: str, doc_id: str = "doc_id") -> DataFrame:
    """A text block for each string of an array column, numbered from 0."""
    placed = rows.select(F.col(doc_id).alias("doc_id"), F.posexplode(strings).alias("pos", "text"))
    known = {"pos": F.col("pos"), "block_id": F.col("pos"), "type": F.lit("text"), "text": F.col("text"), "metadata": F.create_map(F.lit("source"), F.lit(source)), "is_bold": F.lit(False), "is_heading_style": F.lit(False)}
    return placed.select("doc_id", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK_FIELDS])


def text_blocks(texts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return blocks_of_strings(texts.withColumn("_strings", paragraphs(F.col(text))), "_strings", "txt", doc_id)


def with_document_ids(files: DataFrame) -> DataFrame:
    """doc_id from the path: the same in every run."""
    return files.withColumn("doc_id", F.xxhash64("path"))


def read_text(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The blocks of all ``.txt`` files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where(F.lower("path").endswith(".txt"))
    return text_blocks(with_document_ids(files).withColumn("text", decode_text("content")))


def check_positions(blocks: DataFrame) -> DataFrame:
    """Blocks renumbered from 0 in their order, where a source left gaps."""
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int")
    return blocks.withColumn("pos", number).withColumn("block_id", F.col("pos"))
