"""Scores of predicted headings against given ones, and summaries of many results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity, strip, text_or_empty

DOC = "doc_id"


def _low(title: Column) -> Column:
    return F.lower(strip(text_or_empty(title)))


def heading_pairs(truth: DataFrame, predicted: DataFrame, tolerance: int = 3, least: float = 0.6) -> DataFrame:
    """Candidates: given and predicted headings of a document within ``tolerance`` ids whose titles
    are alike; a band join made of equi-joins.  Both sides: doc_id, ord, block_id, level, title."""
    t = truth.select(DOC, F.col("ord").alias("t"), F.col("level").alias("t_level"), _low(F.col("title")).alias("_t"), F.explode(F.sequence(F.col("block_id") - tolerance, F.col("block_id") + tolerance)).alias("block_id"))
    p = predicted.select(DOC, "block_id", F.col("ord").alias("p"), F.col("level").alias("p_level"), _low(F.col("title")).alias("_p"))
    return t.join(p, [DOC, "block_id"]).withColumn("sim", similarity(F.col("_t"), F.col("_p"))).where((F.col("sim") >= least) & (F.col("sim") > 0)).drop("_t", "_p", "block_id")


def match_headings(truth: DataFrame, predicted: DataFrame, tolerance: int = 3, least: float = 0.6) -> DataFrame:
    """doc_id, t, p, same_level: each given heading in turn takes the most similar free prediction
    (the first among equals).  A fold over the candidates of a document, in which only ids are
    carried."""
    pairs = heading_pairs(truth, predicted, tolerance, least)
    row = F.struct("t", (-F.col("sim")).alias("far"), "p", (F.col("t_level") == F.col("p_level")).alias("same"))
    lists = pairs.groupBy(DOC).agg(F.sort_array(F.collect_list(row)).alias("_c"))
    start = "cast(array() as array<struct<t:int,p:int,same:boolean>>)"
    taken = F.expr(f"aggregate(_c, {start}, (s, x) -> if(exists(s, m -> m.t = x.t or m.p = x.p), s, concat(s, array(named_struct('t', x.t, 'p', x.p, 'same', x.same)))))")
    return lists.select(DOC, F.explode(taken).alias("m")).select(DOC, "m.t", "m.p", F.col("m.same").alias("same_level"))


def edit_distance(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, distance between the sequences of (level, title).

    Each distinct pair of a document becomes one character, so the built-in distance of
    strings applies; a document has fewer pairs than there are characters."""
    both = truth.select(DOC, F.lit(0).alias("side"), "ord", "level", _low(F.col("title")).alias("low")).unionByName(predicted.select(DOC, F.lit(1).alias("side"), "ord", "level", _low(F.col("title")).alias("low")))
    lists = both.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("side", "ord", F.struct("level", "low").alias("h")))).alias("_r"), F.array_sort(F.collect_set(F.struct("level", "low"))).alias("_kinds"))
    symbol = lambda r: F.decode(F.unhex(F.lpad(F.hex(F.array_position(F.col("_kinds"), r["h"]) + F.when(F.array_position(F.col("_kinds"), r["h"]) > 50_000, 20_000).otherwise(32)), 8, "0")), "UTF-32")

    def sequence(side: int) -> Column:
        return F.array_join(F.transform(F.filter("_r", lambda r: r["side"] == side), symbol), "")

    return lists.select(DOC, F.levenshtein(sequence(0), sequence(1)).cast("long").alias("distance"))


def evaluate(truth: DataFrame, predicted: DataFrame, documents: DataFrame, tolerance: int = 3, least: float = 0.6) -> DataFrame:
    """One row per document of ``documents`` (doc_id): tp, fp, fn, precision, recall, f1, level_correct,
    level_total, hierarchy_accuracy, ted.  Documents without headings on either side score 0."""
    matched = match_headings(truth, predicted, tolerance, least).groupBy(DOC).agg(F.count("*").alias("tp"), F.count_if("same_level").alias("level_correct"))
    counts = [documents, truth.groupBy(DOC).agg(F.count("*").alias("_t")), predicted.groupBy(DOC).agg(F.count("*").alias("_p")), matched, edit_distance(truth, predicted)]
    joined = counts[0]
    for c in counts[1:]:
        joined = joined.join(c, DOC, "left")
    joined = joined.fillna(0, ["_t", "_p", "tp", "level_correct", "distance"])
    out = joined.select(DOC, "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"), "level_correct", F.col("tp").alias("level_total"), F.col("distance").alias("ted"))
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and hierarchy_accuracy of tp, fp, fn and level counts."""
    one = F.lit(1)
    out = counts.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)).withColumn("hierarchy_accuracy", F.col("level_correct") / F.greatest(F.col("level_total"), one))


def without_headings(evaluated: DataFrame) -> DataFrame:
    """The other convention for documents that have no headings to find: right if none was found,
    recall 1, and the distance is the number of predictions."""
    none = F.col("tp") + F.col("fn") == 0
    good = F.when(F.col("fp") == 0, 1.0).otherwise(0.0)
    return evaluated.withColumns({**{c: F.when(none, good).otherwise(F.col(c)) for c in ("precision", "f1", "hierarchy_accuracy")}, "recall": F.when(none, 1.0).otherwise(F.col("recall")), "ted": F.when(none, F.col("fp")).otherwise(F.col("ted"))})


def match_by_title(truth: DataFrame, predicted: DataFrame, prefix: int = 15) -> DataFrame:
    """doc_id, p, t, same_level: each prediction takes the first free given heading whose title's
    beginning holds its own, or the other way round."""
    def short(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(DOC, F.col("ord").alias(name), F.col("level").alias(f"{name}_level"), strip(F.lower(F.substring(text_or_empty(F.col("title")), 1, prefix))).alias(f"_{name}"))

    pairs = short(truth, "t").join(short(predicted, "p"), DOC).where(F.contains("_t", F.col("_p")) | F.contains("_p", F.col("_t")))
    lists = pairs.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("p", "t", (F.col("t_level") == F.col("p_level")).alias("same")))).alias("_c"))
    start = "cast(array() as array<struct<p:int,t:int,same:boolean>>)"
    taken = F.expr(f"aggregate(_c, {start}, (s, x) -> if(exists(s, m -> m.t = x.t or m.p = x.p), s, concat(s, array(x))))")
    return lists.select(DOC, F.explode(taken).alias("m")).select(DOC, "m.p", "m.t", F.col("m.same").alias("same_level"))


def mean_and_deviation(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means and sample deviations (0 for a single value), per group."""
    return rows.groupBy(*by).agg(*[F.avg(v).alias(f"{v}_mean") for v in values], *[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std") for v in values])


def summary_by_category(rows: DataFrame, category: str, values: list[str]) -> DataFrame:
    """Means for each category and, where the category is null, of everything; nulls are skipped."""
    return rows.rollup(category).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values])


def type_histogram(blocks: DataFrame) -> DataFrame:
    """Blocks of each type, a column each, and characters."""
    kinds = ["text", "image", "table", "formula", "code"]
    return blocks.groupBy(DOC).agg(F.count("*").alias("blocks"), F.sum(F.length(text_or_empty(F.col("text")))).alias("chars"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds])


def missing_blocks(blocks: DataFrame, assembled: DataFrame) -> DataFrame:
    """Blocks whose stripped text the assembled document (doc_id, markdown) does not hold."""
    text = strip(text_or_empty(F.col("text")))
    return blocks.where(text != "").join(assembled, DOC, "left").where(~F.coalesce(F.contains("markdown", text), F.lit(False))).select(DOC, "pos", "block_id", "text")


#: Columns of the report, and the two lines that its table begins with.
REPORTED = ("doc_id", "tp", "fp", "fn", "precision", "recall", "f1", "hierarchy_accuracy", "ted")
REPORT_HEAD = f"| {' | '.join(REPORTED)} |\n|{'---|' * len(REPORTED)}"


def report(evaluated: DataFrame) -> DataFrame:
    """doc_id and line: a line of a Markdown table for every document, to be written behind ``REPORT_HEAD``."""
    kinds = dict(evaluated.dtypes)
    cells = [F.coalesce(F.format_string("%.4f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("")) for c in REPORTED]
    return evaluated.select(DOC, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
