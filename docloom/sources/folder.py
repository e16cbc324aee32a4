"""A folder of documents of every kind that can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCK_FIELDS
from .docx import docx_blocks
from .text import decode_text, text_blocks, with_document_ids

#: What reads the files of each suffix.
SUFFIXES = (".docx", ".txt")


def list_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, stem, suffix (lower case), doc_id and content of all files; the content is read where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    parts = files.withColumn("stem", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).withColumn("suffix", F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)))
    return with_document_ids(parts).select("doc_id", "path", "stem", "suffix", "content")


def read_documents(files: DataFrame) -> DataFrame:
    """The blocks of the files of ``list_documents``, with ``error`` for files that cannot be read or whose
    suffix has no reader: those have one row without a block."""
    word = docx_blocks(files.where("suffix = '.docx'"))
    text = text_blocks(files.where("suffix = '.txt'").withColumn("text", decode_text("content"))).withColumn("error", F.lit(None).cast("string"))
    other = files.where(~F.col("suffix").isin(*SUFFIXES))
    refused = other.select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK_FIELDS], F.concat(F.lit("no reader for: "), "suffix").alias("error"))
    return word.unionByName(text.select(word.columns)).unionByName(refused)


def file_titles(files: DataFrame, title: Column | None = None, authors: Column | None = None) -> DataFrame:
    """doc_id, doc_title, doc_authors: the title is the file's name unless ``title`` gives another."""
    named = F.col("stem") if title is None else F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.col("stem"))
    return files.select("doc_id", named.alias("doc_title"), (F.lit("") if authors is None else F.coalesce(authors, F.lit(""))).alias("doc_authors"))


def truth_of(files: DataFrame, truth: DataFrame) -> DataFrame:
    """The given headings (``read_truth``) of the documents with the same file name: doc_id, ord, block_id, level, title."""
    return files.select("doc_id", "stem").join(truth, "stem").select("doc_id", "ord", "block_id", "level", "title")
