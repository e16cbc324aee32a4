"""Anchors: from what a router returned to headings at the right blocks and levels.

``anchors``: doc_id, ord, block_id, level, title, snippet.  The steps are equi-joins on
(document, block), windows per document, and one fold per document over its anchors (never
over its text).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ResolverConfig
from ..functions.features import potential_title
from ..functions.text import head, similarity, strip, text_or_empty

DOC = "doc_id"
KEY = [DOC, "block_id"]
OMITTED = r"(?i)\[(?:省略|omitted)[^\]]*\]"


#: Marks a table of blocks that has one row for each id.
UNIQUE = "_unique"


def one_of_each(blocks: DataFrame) -> DataFrame:
    """The last block of each id, marked, so that the steps that follow need not look for it again."""
    return unique_blocks(blocks, *[c for c in blocks.columns if c not in KEY]).withColumn(UNIQUE, F.lit(True))


def unique_blocks(blocks: DataFrame, *columns: str) -> DataFrame:
    """One block for each id, the last in the list, with the named columns."""
    if UNIQUE in blocks.columns:
        return blocks.select(*KEY, *columns)
    return blocks.groupBy(KEY).agg(F.max_by(F.struct(*columns), "pos").alias("_b")).select(*KEY, "_b.*")


def document_extent(blocks: DataFrame) -> DataFrame:
    """doc_id, max_id, first_text: what empty documents of anchors fall back to."""
    text = strip(text_or_empty(F.col("text")))
    usable = (F.col("type") == "text") & (text_or_empty(F.col("text")) != "")
    return blocks.groupBy(DOC).agg(F.max("block_id").alias("max_id"), F.min_by(text, F.when(usable, F.col("pos"))).alias("first_text"))


def with_fallback(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents without anchors get one: ``Document``, level 1, at block 0."""
    extent = document_extent(blocks)
    without = extent.join(anchors.select(DOC).distinct(), DOC, "left_anti")
    made = without.select(DOC, F.lit(0).alias("ord"), F.lit(0).alias("block_id"), F.lit(1).alias("level"), F.lit("Document").alias("title"), F.coalesce(head(F.col("first_text"), 40), F.lit("Document")).alias("snippet"))
    return anchors.select(made.columns).unionByName(made)


def in_order(anchors: DataFrame) -> DataFrame:
    """``ord`` by block id, the router's order among equals; it is kept from here on."""
    return anchors.withColumn("ord", F.row_number().over(Window.partitionBy(DOC).orderBy("block_id", "ord")).cast("int"))


def alike(a: Column, b: Column) -> Column:
    """Similarity whatever the case."""
    return similarity(F.lower(a), F.lower(b))


def anchor_matches(text: Column, needle: Column, cfg: ResolverConfig = ResolverConfig(), alike: Callable[[Column, Column], Column] = alike) -> Column:
    """Whether a block's stripped text is what the snippet says."""
    near = alike(needle, head(text, F.length(needle) + 10)) >= cfg.match_similarity
    return (text != "") & (F.contains(text, needle) | F.startswith(text, head(needle, 20)) | ((F.length(needle) > cfg.short_snippet) & near))


def candidate_score(text: Column, needle: Column, alike: Callable[[Column, Column], Column] = alike) -> Column:
    """Similarity to the block's beginning."""
    plain = alike(needle, head(text, F.length(needle) + 10))
    return F.when(F.contains(text, needle) | F.startswith(text, head(needle, 15)), F.greatest(plain, F.lit(0.95))).otherwise(plain)


def less_far(score: Column, offset: Column, radius: int) -> Column:
    """The score less a little for blocks further away."""
    far = (offset > radius * 0.3) & (score < 1.0)
    return F.when(far, score - offset / max(radius, 1) * 0.1).otherwise(score)


def best_blocks(anchors: DataFrame, blocks: DataFrame, radii: Sequence[int], cfg: ResolverConfig = ResolverConfig(), as_given: bool = False, alike: Callable[[Column, Column], Column] = alike) -> DataFrame:
    """Anchors with ``_found``: for each radius the block they belong to, as ``correct_anchors`` has it.

    A band join made of equi-joins: each unmatched anchor looks up the ids around it, once for all
    radii.  ``as_given`` takes snippets as they are, with white space at their ends and empty ones."""
    texts = unique_blocks(blocks, "text").select(*KEY, strip(text_or_empty(F.col("text"))).alias("_text"))
    extent = blocks.groupBy(DOC).agg(F.max("block_id").alias("_max"))
    stripped = F.when(text_or_empty(F.col("snippet")) != "", strip(F.col("snippet"))).otherwise(strip(text_or_empty(F.col("title"))))
    asked = anchors.withColumn("_needle", text_or_empty(F.col("snippet")) if as_given else stripped)
    fits = F.coalesce(anchor_matches(F.col("_text"), F.col("_needle"), cfg, alike), F.lit(False))
    own = asked.join(texts, KEY, "left").withColumn("_fits", fits if as_given else (F.col("_needle") == "") | fits).drop("_text")
    unsure = own.where("not _fits").join(extent, DOC).select(DOC, "ord", "_needle", F.col("block_id").alias("_centre"), "_max")
    around = unsure.withColumn("_low", F.greatest(F.lit(0), F.col("_centre") - max(radii))).withColumn("_high", F.least(F.col("_max"), F.col("_centre") + max(radii))).where("_low <= _high")
    tried = around.withColumn("block_id", F.explode(F.sequence("_low", "_high"))).join(texts, KEY).where("_text <> ''")
    scored = tried.select(DOC, "ord", "block_id", F.abs(F.col("block_id") - F.col("_centre")).alias("_far"), candidate_score(F.col("_text"), F.col("_needle"), alike).alias("_plain"))
    best = scored.groupBy(DOC, "ord").agg(*[_best(radius).alias(f"_best{i}") for i, radius in enumerate(radii)])
    found = [F.coalesce(F.when(F.col(f"_best{i}._score") >= cfg.least_similarity, -F.col(f"_best{i}._id")), F.col("block_id")) for i in range(len(radii))]
    return own.join(best, [DOC, "ord"], "left").select(*anchors.columns, F.array(*found).alias("_found"))


def _best(radius: int) -> Column:
    score = less_far(F.col("_plain"), F.col("_far"), radius)
    return F.max(F.when((F.col("_far") <= radius) & (score > 0), F.struct(score.alias("_score"), (-F.col("block_id")).alias("_id"))))


def correct_anchors(anchors: DataFrame, blocks: DataFrame, cfg: ResolverConfig = ResolverConfig(), as_given: bool = False, alike: Callable[[Column, Column], Column] = alike) -> DataFrame:
    """Anchors whose block does not say what their snippet says move to the best block within
    ``radius`` ids (the smallest id among equals); others, and those without one, stay."""
    found = best_blocks(anchors, blocks, [cfg.radius], cfg, as_given, alike)
    return found.withColumn("block_id", F.col("_found")[0]).select(anchors.columns)


def should_restore(title: Column, snippet: Column, full: Column) -> Column:
    """Whether a heading was shortened and the block has the whole of it."""
    marked = text_or_empty(title).rlike(OMITTED) | text_or_empty(snippet).rlike(OMITTED)
    clean = strip(text_or_empty(title))
    prefix = strip(F.regexp_replace(clean, r"\?|\.\.\.", ""))
    cut_off = (F.contains(clean, F.lit("...")) | F.contains(clean, F.lit("?"))) & (F.length(full) > F.length(clean)) & (F.length(prefix) >= 8) & F.startswith(full, prefix)
    return marked | cut_off


def restore_titles(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Shortened titles become the whole text of their block."""
    texts = unique_blocks(blocks, "text", "type").where("type = 'text'").select(*KEY, strip(text_or_empty(F.col("text"))).alias("_full"))
    joined = anchors.join(texts, KEY, "left")
    restore = F.coalesce((F.col("_full") != "") & should_restore(F.col("title"), F.col("snippet"), F.col("_full")), F.lit(False))
    renew = restore & ((text_or_empty(F.col("snippet")) == "") | F.col("snippet").rlike(OMITTED))
    return joined.select(*[F.when(restore, F.col("_full")).otherwise(F.col("title")).alias("title") if c == "title" else F.when(renew, head(F.col("_full"), 40)).otherwise(F.col("snippet")).alias("snippet") if c == "snippet" else F.col(c) for c in anchors.columns])


def _level_fold(tolerance: float) -> str:
    """Levels of the ordered anchors ``_a`` of a document, and the font size of each level.

    The first is 1; a jump goes to the level whose font matches, or else to one more than
    before; any other level goes up to the highest level whose font matches."""
    match = f"if(coalesce(x.size, 0D) <> 0D, array_min(transform(filter(s.fonts, f -> abs(x.size - f.size) <= {tolerance}D), f -> f.level)), null)"
    level = f"case when size(s.levels) = 0 then 1 when x.level > s.prev + 1 then coalesce({match}, s.prev + 1) when x.level > 1 and {match} < x.level then {match} else x.level end"
    new_font = "if(coalesce(x.size, 0D) <> 0D and not exists(s.fonts, f -> f.level = l), concat(s.fonts, array(named_struct('level', l, 'size', x.size))), s.fonts)"
    state = f"transform(array({level}), l -> named_struct('prev', l, 'fonts', {new_font}, 'levels', concat(s.levels, array(l))))[0]"
    start = "named_struct('prev', 0, 'fonts', cast(array() as array<struct<level:int,size:double>>), 'levels', cast(array() as array<int>))"
    return f"aggregate(_a, {start}, (s, x) -> {state})"


def fix_levels(anchors: DataFrame, blocks: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Anchors with repaired levels, and ``fonts``, the document's sizes by level in order of
    appearance.  The fold sees numbers only."""
    sizes = unique_blocks(blocks, "font_size").select(*KEY, F.col("font_size").alias("_size"))
    rows = anchors.join(sizes, KEY, "left").groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("ord", "level", F.col("_size").alias("size")))).alias("_a"))
    folded = rows.withColumn("_s", F.expr(_level_fold(cfg.font_tolerance))).select(DOC, F.col("_s.fonts").alias("fonts"), F.explode(F.arrays_zip(F.col("_a.ord").alias("ord"), F.col("_s.levels").alias("level"))).alias("_x"))
    fixed = folded.select(DOC, F.col("_x.ord").alias("ord"), F.col("_x.level").alias("_level"), "fonts")
    return anchors.join(fixed, [DOC, "ord"]).withColumn("level", F.col("_level")).drop("_level")


def clamp_and_dedup(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids into the document's range; of anchors at one block the first stays."""
    extent = blocks.groupBy(DOC).agg(F.max("block_id").alias("_max"))
    clamped = anchors.join(extent, DOC).withColumn("block_id", F.greatest(F.lit(0), F.least("block_id", "_max"))).drop("_max")
    return clamped.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("ord"))).where("_n = 1").drop("_n")


def close_intervals(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """start_block_id and end_block_id: up to the next anchor's block, or to the last block."""
    extent = blocks.groupBy(DOC).agg(F.max("block_id").alias("_max"))
    following = F.lead("block_id").over(Window.partitionBy(DOC).orderBy("ord")) - 1
    out = anchors.join(extent, DOC).withColumn("start_block_id", F.col("block_id"))
    return out.withColumn("end_block_id", F.greatest("start_block_id", F.coalesce(following, F.col("_max")))).drop("_max")


def orphan_level(size: Column, fonts: Column, parent: Column, tolerance: float) -> Column:
    """The level with the nearest font within the tolerance (the first among equals), or else one
    below the parent, 6 at most."""
    near = F.filter(F.transform(fonts, lambda f, i: F.struct(F.abs(size - f["size"]).alias("gap"), i.alias("at"), f["level"].alias("level"))), lambda x: x["gap"] <= tolerance)
    found = F.when(F.coalesce(size, F.lit(0.0)) != 0, F.array_min(near)["level"])
    return F.coalesce(found, F.least(parent + 1, F.lit(6)))


def find_orphans(closed: DataFrame, blocks: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Headings that the router missed: larger than their anchor, or bold under one that is not.

    Intervals become rows of ids, so the blocks in them are found by an equi-join."""
    known = unique_blocks(blocks, "type", "text", "is_bold", "font_size", "alignment", "is_heading_style")
    own = known.select(*KEY, F.col("font_size").alias("_own"), F.coalesce("is_bold", F.lit(False)).alias("_own_bold"))
    audited = closed.join(own, KEY).where("coalesce(_own, 0) <> 0 and end_block_id > start_block_id")
    inside = audited.select(DOC, "ord", F.col("level").alias("_parent"), "fonts", "_own", "_own_bold", F.explode(F.sequence(F.col("start_block_id") + 1, F.col("end_block_id"))).alias("block_id"))
    titles = known.where(potential_title()).select(*KEY, "text", "font_size", F.coalesce("is_bold", F.lit(False)).alias("_bold"))
    child = F.coalesce("font_size", F.lit(0.0))
    larger = child > F.col("_own") + 0.5
    bolder = (F.abs(child - F.col("_own")) <= 0.5) & F.col("_bold") & ~F.col("_own_bold") & (F.length("text") < cfg.orphan_chars)
    found = inside.join(titles, KEY).where(larger | bolder)
    title = strip(F.col("text"))
    return found.select(DOC, "ord", "block_id", orphan_level(F.col("font_size"), F.col("fonts"), F.col("_parent"), cfg.font_tolerance).alias("level"), title.alias("title"), head(title, 40).alias("snippet"))


def promote_orphans(closed: DataFrame, blocks: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Documents with orphans get them as anchors, in order of blocks, and new intervals; the
    others stay as they are.  ``ord`` counts the result's order."""
    orphans = find_orphans(closed, blocks, cfg)
    columns = [DOC, "ord", "block_id", "level", "title", "snippet"]
    both = closed.select(*columns, F.lit(0).alias("_new")).unionByName(orphans.select(*columns, F.lit(1).alias("_new")))
    both = both.withColumn("_any", F.max("_new").over(Window.partitionBy(DOC)))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("_new", "ord"))
    kept = both.withColumn("_n", first).where("_n = 1")
    order = Window.partitionBy(DOC).orderBy(F.when(F.col("_any") == 1, F.col("block_id")).otherwise(0), "_new", "ord")
    renumbered = kept.withColumn("ord", F.row_number().over(order).cast("int")).select(columns)
    return close_intervals(renumbered, blocks)


def merge_windows(routed: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Anchors of several windows as one list: by block, and without those that a nearby anchor
    (of the last five kept) with nearly the same title has said before.

    ``routed``: doc_id, window_index, total_windows and the anchors.  Documents of one window are
    left as the router gave them."""
    order = F.row_number().over(Window.partitionBy(DOC).orderBy(F.when(F.col("total_windows") > 1, F.col("block_id")).otherwise(0), "window_index", "ord")).cast("int")
    rows = routed.withColumn("ord", order)
    row = F.struct("ord", "block_id", "level", "title", "snippet", F.lower(strip(text_or_empty(F.col("title")))).alias("low"))
    lists = rows.groupBy(DOC).agg(F.max("total_windows").alias("total_windows"), F.sort_array(F.collect_list(row)).alias("_a"))
    alike = "if(greatest(length(x.low), length(k.low)) = 0, 1D, 1D - levenshtein(x.low, k.low) / greatest(length(x.low), length(k.low), 1))"
    repeated = f"exists(slice(s, -least(5, greatest(size(s), 1)), 5), k -> abs(x.block_id - k.block_id) <= {cfg.duplicate_ids} and {alike} >= {cfg.duplicate_similarity}D)"
    kept = f"if(total_windows > 1, aggregate(slice(_a, 2, size(_a)), slice(_a, 1, 1), (s, x) -> if({repeated}, s, concat(s, array(x)))), _a)"
    return lists.select(DOC, F.explode(F.expr(kept)).alias("x")).select(DOC, "x.ord", "x.block_id", "x.level", "x.title", "x.snippet")
