"""Skeletons: windows over the blocks of a document, runs of plain text folded.

Everything is a window over (document, window) in order of position; no document is
collected before its lines are joined to the skeleton, which is one string by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SkeletonConfig
from ..functions.features import is_key_frame, meta_tags, skeleton_line
from ..functions.prefix import prefix_length
from ..functions.text import head, strip, text_or_empty

DOC = "doc_id"
RULE = "=" * 60
# The explanations that stand in each skeleton.
LEGEND = "标记说明: <Bold>=加粗, <Size:N>=字号, <Center>=居中, <Heading N>=标题样式"
NOTE = "注意: 折叠区域内每行 [id] 开头的是段落首句摘要，请仔细检查是否有遗漏的标题"


def window_count(n: Column, cfg: SkeletonConfig) -> Column:
    """Windows of a document of n blocks: one up to the threshold."""
    step = cfg.window_size - cfg.window_overlap
    more = F.when(n > cfg.window_size, 1 + F.ceil((n - cfg.window_size) / step)).otherwise(1)
    return F.when(n > cfg.window_threshold, more).otherwise(1).cast("int")


def assign_windows(blocks: DataFrame, cfg: SkeletonConfig = SkeletonConfig()) -> DataFrame:
    """Each block once for each window it lies in: n_blocks, window_index, total_windows, ws, we
    (positions in the document's list of blocks, ``we`` excluded)."""
    step = cfg.window_size - cfg.window_overlap
    by_pos = Window.partitionBy(DOC).orderBy("pos")
    numbered = blocks.withColumn("_at", F.row_number().over(by_pos) - 1).withColumn("n_blocks", F.count("*").over(Window.partitionBy(DOC)).cast("int"))
    numbered = numbered.withColumn("total_windows", window_count(F.col("n_blocks"), cfg))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - cfg.window_size + 1) / step)).cast("int")
    last = F.least(F.col("total_windows") - 1, F.floor(F.col("_at") / step)).cast("int")
    several = F.col("total_windows") > 1
    placed = numbered.withColumn("window_index", F.explode(F.when(several, F.sequence(first, last)).otherwise(F.array(F.lit(0)))))
    ws = F.when(several, F.col("window_index") * step).otherwise(0)
    return placed.withColumn("ws", ws).withColumn("we", F.when(several, F.least(ws + cfg.window_size, F.col("n_blocks"))).otherwise(F.col("n_blocks"))).drop("_at")


def fold_groups(placed: DataFrame, cfg: SkeletonConfig = SkeletonConfig()) -> DataFrame:
    """Adds key (kept whole or not), run (a key frame ends one; at most ``fold_most`` blocks) and
    folded: whether the block's run is long enough to be folded."""
    by_pos = Window.partitionBy(DOC, "window_index").orderBy("pos")
    island = Window.partitionBy(DOC, "window_index", "_island", "key").orderBy("pos")
    run = Window.partitionBy(DOC, "window_index", "_island", "key", "_part")
    out = placed if "key" in placed.columns else placed.withColumn("key", is_key_frame())
    out = out.withColumn("_island", F.sum(F.col("key").cast("int")).over(by_pos))
    out = out.withColumn("_part", F.floor((F.row_number().over(island) - 1) / cfg.fold_most))
    out = out.withColumn("run", F.when(~F.col("key"), F.min("pos").over(run))).withColumn("run_blocks", F.when(~F.col("key"), F.count("*").over(run)).cast("int"))
    return out.withColumn("folded", ~F.col("key") & F.lit(cfg.fold) & (F.coalesce("run_blocks", F.lit(0)) >= cfg.fold_least)).drop("_island", "_part")


def snippet(cfg: SkeletonConfig = SkeletonConfig(), text: Column | None = None, prefix: Column | None = None) -> Column:
    """The beginning of a folded block: past its numbering, to the end of a word if that is near.

    ``text`` and ``prefix`` are the stripped text and the length of its numbering, if there are
    columns for them."""
    text = strip(text_or_empty(F.col("text"))) if text is None else text
    size = F.greatest(F.lit(cfg.snippet_least), (prefix_length(text) if prefix is None else prefix) + cfg.snippet_extra)
    start = head(text, size)
    gap = F.instr(F.substring(text, size + 1, F.lit(10)), " ")
    return F.when((F.length(text) > size) & F.contains(start, F.lit(" ")) & (gap > 0), head(text, size + gap - 1)).otherwise(start)


def _lines(blocks: DataFrame, cfg: SkeletonConfig) -> DataFrame:
    """Blocks with ``_key``, the line ``_line`` that each has on its own, and ``_inner``, that in a fold.

    Lines depend on their block alone, so they are made before the windows repeat blocks, and
    what they share is computed once, in steps."""
    made = blocks.withColumns({"_key": is_key_frame(), "_tags": meta_tags(), "_st": strip(text_or_empty(F.col("text"))), "_size": F.length(text_or_empty(F.col("text")))})
    made = made.withColumn("_prefix", F.when(F.col("_key"), 0).otherwise(prefix_length(F.col("_st"))))
    inner = F.concat(F.lit("  ["), F.col("block_id").cast("string"), F.lit("]"), F.when(F.col("_tags") == "", "").otherwise(F.concat(F.lit(" "), "_tags")), F.lit(" "), snippet(cfg, F.col("_st"), F.col("_prefix")), F.lit("..."))
    return made.withColumns({"_line": skeleton_line(F.col("_key"), cfg.head_chars, cfg.tail_chars, F.col("_st"), F.col("_tags")), "_inner": inner})


def skeleton_items(blocks: DataFrame, cfg: SkeletonConfig = SkeletonConfig()) -> DataFrame:
    """One row per item of each window: doc_id, window_index, item_pos, folded, start_id, end_id,
    n_blocks_in, text."""
    made = _lines(blocks, cfg).select(DOC, "pos", "block_id", F.col("_key").alias("key"), "_line", "_inner", "_size")
    lines = fold_groups(assign_windows(made, cfg), cfg).withColumn("item_pos", F.when(F.col("folded"), F.col("run")).otherwise(F.col("pos")))
    row = F.struct("pos", "block_id", F.when(F.col("folded"), F.col("_inner")).otherwise(F.col("_line")).alias("line"))
    context = ["n_blocks", "total_windows", "ws", "we"]
    grouped = lines.groupBy(DOC, "window_index", "item_pos", "folded", *context).agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.sum("_size").alias("_chars"))
    first, last = F.element_at("_rows", 1)["block_id"], F.element_at("_rows", -1)["block_id"]
    header = F.concat(F.lit("["), first.cast("string"), F.lit(" to "), last.cast("string"), F.lit("] <Text: "), F.size("_rows").cast("string"), F.lit(" Paras, "), F.col("_chars").cast("string"), F.lit(" chars>"))
    text = F.when(F.col("folded"), F.concat_ws("\n", header, F.array_join("_rows.line", "\n"))).otherwise(F.element_at("_rows.line", 1))
    return grouped.select(DOC, "window_index", "item_pos", "folded", first.alias("start_id"), last.alias("end_id"), F.size("_rows").alias("n_blocks_in"), text.alias("text"), *context)


def skeletons(blocks: DataFrame, cfg: SkeletonConfig = SkeletonConfig()) -> DataFrame:
    """doc_id, window_index, total_windows, ws, we, text: what a router reads."""
    items = skeleton_items(blocks, cfg)
    context = ["window_index", "total_windows", "ws", "we", "n_blocks"]
    joined = items.groupBy(DOC, *context).agg(F.sort_array(F.collect_list(F.struct("item_pos", "text"))).alias("_items"))
    s = lambda c: F.col(c).cast("string")
    last = (F.col("we") - 1).cast("string")
    number = (F.col("window_index") + 1).cast("string")
    single = F.array(F.lit(RULE), F.lit("文档虚拟骨架"), F.concat(F.lit("原始 Block 总数: "), s("n_blocks")), F.concat(F.lit("骨架项数量: "), F.size("_items").cast("string")), F.lit(LEGEND), F.lit(NOTE), F.lit(RULE), F.lit(""))
    single_end = F.array(F.lit(""), F.lit(RULE), F.concat(F.lit("骨架结束 (共 "), s("n_blocks"), F.lit(" 个 Block, ID 范围: 0~"), (F.col("n_blocks") - 1).cast("string"), F.lit(")")), F.lit(RULE))
    part = F.array(
        F.lit(RULE),
        F.concat(F.lit("文档虚拟骨架 — 窗口 "), number, F.lit("/"), s("total_windows")),
        F.concat(F.lit("原始 Block 总数: "), s("n_blocks")),
        F.concat(F.lit("本窗口 Block 范围: "), s("ws"), F.lit("~"), last, F.lit(" ("), (F.col("we") - F.col("ws")).cast("string"), F.lit(" Blocks)")),
        F.lit(LEGEND),
        F.lit(NOTE),
        F.lit(RULE),
        F.lit(""),
    )
    part_end = F.array(F.lit(""), F.lit(RULE), F.concat(F.lit("窗口 "), number, F.lit(" 骨架结束 (Block "), s("ws"), F.lit("~"), last, F.lit(")")), F.lit(RULE))
    many = F.col("n_blocks") > cfg.window_threshold
    text = F.array_join(F.concat(F.when(many, part).otherwise(single), F.col("_items.text"), F.when(many, part_end).otherwise(single_end)), "\n")
    return joined.select(DOC, "window_index", "total_windows", "ws", "we", text.alias("text"))
