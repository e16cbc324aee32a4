"""Markdown of blocks, and what can be read from Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip, text_or_empty

PLACEHOLDER = rf"\[RAW_XML_NODE:{SPACE}*([^\]]+)\]{SPACE}*([^\n]*)"
MARK = rf"(\[RAW_XML_NODE:{SPACE}*[^\]]+\]{SPACE}*[^\n]*)"


def _placeholder(match: Column) -> Column:
    tag, body = strip(F.regexp_extract(match, PLACEHOLDER, 1)), strip(F.regexp_extract(match, PLACEHOLDER, 2))
    low, empty = F.lower(tag), F.regexp_extract(match, PLACEHOLDER, 2) == ""
    bare = empty | (body == "")
    return (
        F.when(F.contains(low, F.lit("txbx")), F.when(bare, F.lit("> **[文本框]**")).otherwise(F.concat(F.lit("> **[文本框]** "), body)))
        .when(F.contains(low, F.lit("math")), F.when(bare, F.lit("$ … $")).otherwise(F.concat(F.lit("$ "), body, F.lit(" $"))))
        .otherwise(F.when(bare, F.concat(F.lit("<!-- 未识别元素: "), tag, F.lit(" -->"))).otherwise(F.concat(F.lit("<!-- "), tag, F.lit(": "), body, F.lit(" -->"))))
    )


def sanitise_placeholders(text: Column) -> Column:
    """Placeholders of unknown elements as quotes, inline mathematics or comments."""
    between = F.split(text, PLACEHOLDER, -1)
    found = F.regexp_extract_all(text, F.lit(MARK), F.lit(1))
    pieces = F.transform(between, lambda x, i: F.concat(x, F.when(i < F.size(found), _placeholder(F.get(found, i))).otherwise("")))
    return F.when(F.contains(text, F.lit("[RAW_XML_NODE:")), F.array_join(pieces, "")).otherwise(text)


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", "None"), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Rows as a table as wide as the first: short rows are filled up, long ones cut."""
    wide = F.size(F.get(rows, F.lit(0)))
    rule = _row(F.array_repeat(F.lit("---"), wide))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: _row(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(wide - F.size(r), F.lit(0)))), F.lit(1), wide)))
    return F.when(F.size(rows) < 1, "").otherwise(F.array_join(F.concat(F.array(_row(F.get(rows, F.lit(0))), rule), body), "\n"))


def code_language(text: Column) -> Column:
    """A guess from the first line; empty if nothing tells."""
    line = F.lower(F.substring_index(text, "\n", 1))

    def holds(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(line, F.lit(w))
        return out

    return F.when(holds("python", "def "), "python").when(holds("javascript", "const "), "javascript").when(holds("select ", "sql"), "sql").otherwise("")


def block_markdown() -> Column:
    """The Markdown of a block, by the columns of a blocks table; empty if it has none."""
    has_text = text_or_empty(F.col("text")) != ""
    caption = F.when(text_or_empty(F.col("caption")) != "", F.col("caption"))
    image = F.when(text_or_empty(F.col("image_data")) != "", F.col("image_data")).otherwise("image")
    rule = F.coalesce(F.element_at("metadata", F.lit("source")) == "horizontal_rule", F.lit(False))
    return (
        F.when((F.col("type") == "text") & has_text, F.when(rule, "---").otherwise(sanitise_placeholders(F.col("text"))))
        .when(F.col("type") == "image", F.concat(F.lit("!["), F.coalesce(caption, F.lit("Image")), F.lit("]("), image, F.lit(")")))
        .when(F.col("type") == "table", F.when(has_text, F.col("text")).when(F.col("table_data.rows").isNotNull(), markdown_table(F.col("table_data.rows"))).otherwise(F.concat(F.lit("[表格: "), F.coalesce(caption, F.lit("未命名")), F.lit("]"))))
        .when(F.col("type") == "code", F.concat(F.lit("```"), F.when(has_text, code_language(F.col("text"))).otherwise(""), F.lit("\n"), F.coalesce(F.col("text"), F.lit("None")), F.lit("\n```")))
        .when(F.col("type") == "formula", F.when(has_text, F.concat(F.lit("$$ "), F.col("text"), F.lit(" $$"))).otherwise("[公式]"))
        .otherwise("")
    )


def markdown_headings(text: Column) -> Column:
    """array of level and title of the heading lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(rf"^#{{1,6}}{SPACE}+."))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), strip(F.regexp_extract(x, rf"^#+{SPACE}+(.+)$", 1)).alias("title")))


#: What counts as a formula.
FORMULA = r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$|\\frac\{|\\sum|\\int|\\sqrt"


def formula_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FORMULA))
