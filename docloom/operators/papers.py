"""Papers from what other tools give: a list of sections, or headings with blocks.

Output rows: doc_id, ord, id, parent_id, title, content, type, level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import section_type
from ..functions.text import text_or_empty
from .anchors import close_intervals, in_order
from .tree import highest_level, section_content, to_paper, with_parents

DOC = "doc_id"


def paper_from_sections(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """Sections that are there already (doc_id, ord, level, title, content): ids, parents and missing
    types are filled in.  ``meta``: doc_id, doc_title, doc_authors."""
    kind = F.col("section_type") if "section_type" in sections.columns else F.lit(None).cast("string")
    filled = sections.withColumn("section_type", F.coalesce(kind, section_type(text_or_empty(F.col("title")), bibliography=False)))
    return to_paper(with_parents(filled, highest_level(sections)), meta)


def paper_from_headings(headings: DataFrame, blocks: DataFrame, meta: DataFrame, file_title: str = "doc_title") -> DataFrame:
    """Headings (doc_id, ord, block_id, level, title) and blocks, without any repair; code is left
    out.  A document without headings is one section with the title of its file."""
    closed = close_intervals(in_order(headings.select(DOC, "ord", "block_id", "level", "title")), blocks)
    extent = blocks.groupBy(DOC).agg(F.min("block_id").alias("start_block_id"), F.max("block_id").alias("end_block_id"))
    without = extent.join(headings.select(DOC).distinct(), DOC, "left_anti").join(meta.select(DOC, F.col(file_title).alias("title")), DOC, "left")
    single = without.select(DOC, F.lit(1).alias("ord"), F.col("start_block_id").alias("block_id"), F.lit(1).alias("level"), F.coalesce("title", F.lit("Document")).alias("title"), "start_block_id", "end_block_id")
    both = closed.select(single.columns).unionByName(single)
    made = section_content(both, blocks.where("type <> 'code'"))
    kinds = made.withColumn("section_type", section_type(F.col("title"), bibliography=False))
    return to_paper(with_parents(kinds, highest_level(both)), meta)
