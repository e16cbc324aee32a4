"""Counts and dumps over blocks and results that reports are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import potential_title
from ..functions.text import strip, text_or_empty
from .tree import section_content

DOC = "doc_id"


def mean_of_positive(value: str) -> Column:
    """The mean of the values above 0; null without any."""
    return F.avg(F.when(F.col(value) > 0, F.col(value)))


def repeated_texts(blocks: DataFrame) -> DataFrame:
    """Per document: blocks with text, different texts among them, and how many are repeats."""
    text = strip(text_or_empty(F.col("text")))
    return blocks.where(text != "").groupBy(DOC).agg(F.count("*").alias("texts"), F.count_distinct(text).alias("different")).withColumn("repeats", F.col("texts") - F.col("different"))


def heading_counts(blocks: DataFrame) -> DataFrame:
    """Per document: blocks in a heading style, those that may be titles, and bold titles without style."""
    styled = F.coalesce(F.col("is_heading_style"), F.lit(False))
    bold = F.coalesce(F.col("is_bold"), F.lit(False))
    return blocks.groupBy(DOC).agg(F.count_if(styled).alias("styled"), F.count_if(styled | potential_title()).alias("headings"), F.count_if(potential_title() & bold & ~styled).alias("bold_titles"))


def root_coverage(blocks: DataFrame) -> DataFrame:
    """Per document: characters of one section over everything, against those of the texts."""
    whole = blocks.groupBy(DOC).agg(F.max("block_id").alias("end_block_id"), F.sum(F.length(text_or_empty(F.col("text")))).alias("chars"))
    roots = whole.select(DOC, F.lit(0).alias("ord"), F.lit("Document").alias("title"), F.lit(0).alias("start_block_id"), "end_block_id", "chars")
    made = section_content(roots, blocks)
    return made.select(DOC, "chars", F.length("content").cast("long").alias("content_chars"))


def list_dump(blocks: DataFrame) -> DataFrame:
    """Per document: its texts, list items indented by four spaces a level."""
    level = F.coalesce(F.try_element_at(F.col("metadata"), F.lit("list_level")).try_cast("int"), F.lit(0))
    line = F.concat(F.repeat(F.lit("    "), level), strip(text_or_empty(F.col("text"))))
    rows = blocks.where(strip(text_or_empty(F.col("text"))) != "").groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    return rows.select(DOC, F.array_join("_l.line", "\n").alias("dump"))
