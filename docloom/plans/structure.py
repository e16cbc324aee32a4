"""The whole way from blocks to sections, as one lazy plan around the router."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ResolverConfig, SkeletonConfig
from ..operators import anchors as A
from ..operators import tree
from ..operators.skeleton import skeletons
from ..session import cut
from .router import Router, RuleRouter, answer_errors, answer_titles, answers_to_anchors


@dataclass(frozen=True)
class Structure:
    """What a corpus of documents was made into."""

    sections: DataFrame
    meta: DataFrame
    errors: DataFrame | None = None  # doc_id, window_index, error: answers of a model without headings

    def markdown(self) -> DataFrame:
        return tree.to_markdown(self.sections, self.meta)

    def markdown_sections(self) -> DataFrame:
        return tree.to_markdown_sections(self.sections)

    def json(self) -> DataFrame:
        return tree.to_json(self.sections, self.meta)

    def paper(self) -> DataFrame:
        return tree.to_paper(self.sections, self.meta)

    def statistics(self) -> DataFrame:
        return tree.tree_statistics(self.sections)


def resolve(anchors: DataFrame, blocks: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Anchors (doc_id, ord, block_id, level, title, snippet) -> sections with content and parents.

    The order of the steps is part of the result: sort, correct, restore titles, fix levels,
    clamp, drop duplicates, close intervals, promote orphans, render, nest.  Anchors, which are
    few against blocks, are kept where several steps read them; so are the blocks, one of each id, which
    is the only shuffle of all that they hold."""
    found = A.in_order(A.with_fallback(anchors, blocks))
    blocks = cut(A.one_of_each(blocks))
    found = A.restore_titles(A.correct_anchors(found, blocks, cfg), blocks)
    closed = cut(A.close_intervals(A.clamp_and_dedup(A.fix_levels(cut(found), blocks, cfg), blocks), blocks))
    closed = cut(A.promote_orphans(closed, blocks, cfg))
    return tree.with_parents(tree.section_content(closed, blocks), tree.highest_level(closed))


def structure(blocks: DataFrame, router: Router | None = None, skeleton: SkeletonConfig = SkeletonConfig(), cfg: ResolverConfig = ResolverConfig(), titles: DataFrame | None = None) -> Structure:
    """``titles``: doc_id, doc_title, doc_authors, where they are known; without them those of the answer for
    a document's first window, if a model routes."""
    router, errors = router or RuleRouter(skeleton), None
    if hasattr(router, "said"):
        answers = cut(router.said(skeletons(blocks, skeleton)))
        routed, errors = answers_to_anchors(answers), answer_errors(answers)
        titles = answer_titles(answers) if titles is None else titles
    else:
        routed = router.route(blocks, skeletons(blocks, skeleton))
    anchors = cut(A.merge_windows(routed, cfg))  # a model may answer otherwise the next time
    raw_first = anchors.groupBy("doc_id").agg(F.min_by("block_id", "ord").alias("first_id"))
    meta = blocks.select("doc_id").distinct().join(tree.preamble(blocks, raw_first), "doc_id", "left")
    known = titles if titles is not None else meta.select("doc_id", F.lit("").alias("doc_title"), F.lit("").alias("doc_authors"))
    return Structure(resolve(anchors, blocks, cfg), meta.join(known, "doc_id", "left"), errors)


def content_hash(blocks: DataFrame) -> DataFrame:
    """doc_id, hash over the blocks in order: id, type, text, bold, size and heading style."""
    part = F.concat_ws("|", F.col("block_id").cast("string"), "type", F.coalesce("text", F.lit("")), F.coalesce("is_bold", F.lit(False)).cast("string"), F.coalesce("font_size", F.lit(0.0)).cast("decimal(10,2)").cast("string"), F.coalesce("is_heading_style", F.lit(False)).cast("string"))
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("_p"))
    return rows.select("doc_id", F.sha2(F.array_join("_p.part", ""), 256).alias("hash"))


def not_done_before(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Blocks of the documents whose hash no row of ``results`` (hash) has."""
    todo = content_hash(blocks).join(results.select("hash").distinct(), "hash", "left_anti")
    return blocks.join(todo.select("doc_id"), "doc_id", "left_semi")
