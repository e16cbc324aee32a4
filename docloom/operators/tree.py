"""Sections: content, parents, and the forms in which a document's tree is given out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import section_type
from ..functions.markdown import block_markdown
from ..functions.text import text_or_empty
from .anchors import unique_blocks

DOC = "doc_id"


def section_content(closed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds section_type and content: the Markdown of the interval's blocks, joined by blank
    lines, without the heading's own text (but with it where the title is ``Document``)."""
    rendered = unique_blocks(blocks, *[c for c in blocks.columns if c not in (DOC, "block_id", "pos")]).withColumn("_md", block_markdown()).where("_md <> ''").select(DOC, "block_id", F.col("type").alias("_type"), "_md")
    ids = closed.select(DOC, "ord", "start_block_id", "title", F.explode(F.sequence("start_block_id", "end_block_id")).alias("block_id"))
    own = (F.col("block_id") == F.col("start_block_id")) & (F.col("_type") == "text") & (F.col("title") != "Document")
    parts = ids.join(rendered, [DOC, "block_id"]).where(~own).groupBy(DOC, "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "_md"))), lambda x: x["_md"]), "\n\n").alias("content"))
    return closed.join(parts, [DOC, "ord"], "left").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("section_type", section_type(F.col("title")))


def highest_level(sections: DataFrame) -> int:
    """The highest level there is (1 at least): a job that reads levels alone."""
    return max(1, sections.agg(F.max("level")).first()[0] or 1)


def with_parents(sections: DataFrame, levels: int | None = None) -> DataFrame:
    """Adds parent_ord (the nearest earlier section of a lower level; null at the top), root_ord and
    depth (1 at the top), by windows alone.

    A section's chain of parents has, among the levels below its own, the sections since which
    no lower level came.  ``levels`` is the highest level, looked up if it is not given."""
    levels = highest_level(sections) if levels is None else levels
    earlier = Window.partitionBy(DOC).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(DOC).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.greatest(F.lit(1), F.col("level"))
    last = {k: F.last(F.when(level == k, F.col("ord")), ignorenulls=True).over(earlier) for k in range(1, levels)}
    out = sections
    for k, c in last.items():
        out = out.withColumn(f"_last{k}", F.when(level > k, c))
    lasts = [F.coalesce(F.col(f"_last{k}"), F.lit(-1)) for k in last]
    # of level k on the chain: nothing of a lower level came after it
    on_chain = [F.when((lasts[k] >= 0) & (lasts[k] > F.greatest(F.lit(-2), F.lit(-3), *lasts[:k])), F.lit(1)).otherwise(0) for k in range(len(lasts))]
    parent = F.greatest(F.lit(-1), F.lit(-1), *lasts)
    depth = F.lit(1)
    for c in on_chain:
        depth = depth + c
    out = out.withColumn("parent_ord", F.when(parent >= 0, parent)).withColumn("depth", depth.cast("int")).drop(*[f"_last{k}" for k in last])
    return out.withColumn("root_ord", F.last(F.when(F.col("parent_ord").isNull(), F.col("ord")), ignorenulls=True).over(upto))


def tree_statistics(sections: DataFrame) -> DataFrame:
    """Per document: top sections, all sections, characters of content, depth."""
    return sections.groupBy(DOC).agg(F.count_if(F.col("parent_ord").isNull()).alias("top_sections"), F.count("*").alias("sections"), F.sum(F.length(text_or_empty(F.col("content")))).alias("chars"), F.max("depth").alias("max_depth"))


def preamble(blocks: DataFrame, first_ids: DataFrame) -> DataFrame:
    """The Markdown before the first block whose id reaches the first anchor's.

    ``first_ids``: doc_id, first_id, as the router gave it."""
    seen = F.max(F.when(F.col("block_id") >= F.col("first_id"), 1).otherwise(0)).over(Window.partitionBy(DOC).orderBy("pos"))
    before = blocks.join(first_ids, DOC).withColumn("_seen", seen).withColumn("_md", block_markdown()).where("_seen = 0 and _md <> ''")
    return before.groupBy(DOC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_md"))), lambda x: x["_md"]), "\n\n").alias("preamble"))


def _piece(marks: Column, title: Column, content: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), marks), F.lit(" "), title, F.lit("\n"), F.when(content != "", F.concat(F.lit("\n"), content, F.lit("\n"))).otherwise(""))


def to_markdown(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, markdown: title, authors and preamble, then all sections one level below the title.

    ``meta``: doc_id, doc_title, doc_authors, preamble."""
    piece = _piece(F.least(F.col("level") + 1, F.lit(6)), F.col("title"), text_or_empty(F.col("content")))
    bodies = sections.groupBy(DOC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", piece.alias("piece")))), lambda x: x["piece"]), "\n").alias("_body"))

    def shown(name: str, before: str, after: str) -> Column:
        return F.when(text_or_empty(F.col(name)) != "", F.concat(F.lit(before), F.col(name), F.lit(after)))

    head = F.concat_ws("\n", shown("doc_title", "# ", "\n"), shown("doc_authors", "*", "*\n"), shown("preamble", "", "\n"))
    return bodies.join(meta, DOC, "left").select(DOC, F.concat_ws("\n", F.when(head != "", head), F.col("_body")).alias("markdown"))


def to_markdown_sections(sections: DataFrame) -> DataFrame:
    """One Markdown document for each top section, with all below it."""
    marks = F.when(F.col("parent_ord").isNull(), 1).otherwise(F.least(F.greatest(F.col("level") + 1, F.lit(2)), F.lit(6)))
    piece = _piece(marks, F.col("title"), text_or_empty(F.col("content")))
    rows = F.struct("ord", piece.alias("piece"), "title", "section_type", "level")
    grouped = sections.groupBy(DOC, "root_ord").agg(F.sort_array(F.collect_list(rows)).alias("_r"))
    first = F.element_at("_r", 1)
    return grouped.select(DOC, "root_ord", first["title"].alias("title"), first["section_type"].alias("section_type"), first["level"].alias("level"), F.array_join("_r.piece", "\n").alias("content"))


def to_json(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, json: the sections nested in their parents.

    In order, a section opens its object and its list of children; behind it, as many are closed as the
    depth of the next section says, so one window and one aggregation write trees of any depth."""
    fields = ["title", "level", "start_block_id", "end_block_id", "content", "section_type"]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    opened = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"children":['))
    following = F.lead("depth").over(Window.partitionBy(DOC).orderBy("ord"))
    close = lambda n: F.repeat(F.lit("]}"), n)
    closed = F.when(following.isNull(), close(F.col("depth"))).when(following > F.col("depth"), "").otherwise(F.concat(close(F.col("depth") - following + 1), F.lit(",")))
    pieces = sections.withColumn("_piece", F.concat(opened, closed)).groupBy(DOC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_piece"))), lambda x: x["_piece"]), "").alias("_sections"))
    title = F.to_json(F.struct(text_or_empty(F.col("doc_title")).alias("doc_title"), text_or_empty(F.col("doc_authors")).alias("doc_authors")))
    return pieces.join(meta, DOC, "left").select(DOC, F.concat(F.substring(title, F.lit(1), F.length(title) - 1), F.lit(',"sections":['), "_sections", F.lit("]}")).alias("json"))


def to_paper(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of a paper: each section with an id made from document and place, and its parent's."""

    def uid(ord_: Column) -> Column:
        h = F.sha2(F.concat_ws(":", F.col(DOC).cast("string"), ord_.cast("string")), 256)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))

    return sections.join(meta.select(DOC, "doc_title", "doc_authors"), DOC, "left").select(DOC, "doc_title", "doc_authors", "ord", uid(F.col("ord")).alias("id"), F.when(F.col("parent_ord").isNotNull(), uid(F.col("parent_ord"))).alias("parent_id"), "title", "content", F.col("section_type").alias("type"), "level")
