"""What the formatting of a block says: tags, title-likeness and its line in a skeleton.

The functions take the columns of a blocks table by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, head, strip, text_or_empty

BODY_SIZE = 12.0


def _has(name: str) -> Column:
    """A non-empty string."""
    return text_or_empty(F.col(name)) != ""


def _centred() -> Column:
    return F.coalesce(F.lower("alignment") == "center", F.lit(False))


def _larger(than: float) -> Column:
    return F.coalesce(F.col("font_size") > than, F.lit(False))


def meta_tags() -> Column:
    """``<Heading 1, Bold, Size:16, Center>`` of what applies; empty if nothing does.

    Sizes are rounded half to even."""
    level = F.coalesce(F.col("heading_level"), F.lit(0))
    tags = F.concat_ws(
        ", ",
        F.when(F.col("is_heading_style") & (level != 0), F.concat(F.lit("Heading "), level.cast("string"))),
        F.when(F.col("is_bold"), F.lit("Bold")),
        F.when(_larger(BODY_SIZE), F.concat(F.lit("Size:"), F.bround("font_size", 0).cast("long").cast("string"))),
        F.when(_centred(), F.lit("Center")),
    )
    return F.when(tags == "", "").otherwise(F.concat(F.lit("<"), tags, F.lit(">")))


def potential_title(body_size: float = BODY_SIZE) -> Column:
    """Text in a heading style, or short and either large or centred; bold allows more length."""
    size = F.length(strip(text_or_empty(F.col("text"))))
    stands_out = _larger(body_size) | _centred()
    by_look = stands_out & ((size < 120) | (F.coalesce(F.col("is_bold"), F.lit(False)) & (size < 200)))
    return (F.col("type") == "text") & _has("text") & (F.coalesce(F.col("is_heading_style"), F.lit(False)) | by_look)


def is_key_frame() -> Column:
    """Blocks a skeleton keeps whole: all but text, and text that may be a title."""
    return (F.col("type") != "text") | potential_title()


def table_header(cells: int = 5, most: int = 60) -> Column:
    """The first row of a table, shortened."""
    joined = F.array_join(F.slice(F.get("table_data.rows", F.lit(0)), 1, cells), " | ", "None")
    return F.coalesce(F.when(F.length(joined) > most, F.concat(head(joined, most), F.lit("..."))).otherwise(joined), F.lit(""))


def skeleton_line(keep: Column, head_chars: int = 40, tail_chars: int = 30, text: Column | None = None, tags: Column | None = None) -> Column:
    """The line of a block; ``keep`` says whether long text stays whole.

    ``text`` and ``tags`` are the stripped text and the tags, if there are columns for them."""
    label = F.concat(F.lit("["), F.col("block_id").cast("string"), F.lit("]"))
    tags = meta_tags() if tags is None else tags
    lead = F.concat(label, F.when(tags == "", "").otherwise(F.concat(F.lit(" "), tags)), F.lit(" "))
    text = strip(text_or_empty(F.col("text"))) if text is None else text
    left_out = F.length(text) - head_chars - tail_chars
    short = F.concat(head(text, head_chars), F.lit("...[省略"), left_out.cast("string"), F.lit("字]..."), F.substring(text, F.length(text) - tail_chars + 1, F.lit(tail_chars)))
    caption = F.when(_has("caption"), F.concat(F.lit(" [Caption: "), F.col("caption"), F.lit("]"))).otherwise("")
    header = table_header()

    def shown(what: Column) -> Column:
        return F.when(_has("text"), F.concat(F.lit(" ["), what, F.lit("]"))).otherwise("")

    code = F.regexp_replace(text_or_empty(F.col("text")), "\n", " ")
    return (
        F.when((F.col("type") == "text") & _has("text"), F.concat(lead, F.when(keep | (left_out <= 0), text).otherwise(short)))
        .when(F.col("type") == "image", F.concat(label, F.lit(" <Image>"), caption))
        .when(F.col("type") == "table", F.concat(label, F.lit(" <Table>"), caption, F.when(header == "", "").otherwise(F.concat(F.lit(" [Header: "), header, F.lit("]")))))
        .when(F.col("type") == "code", F.concat(label, F.lit(" <Code>"), shown(strip(F.when(F.length(code) > 40, head(code, 40)).otherwise(code)))))
        .when(F.col("type") == "formula", F.concat(label, F.lit(" <Formula>"), shown(head(F.col("text"), 40))))
        .otherwise(F.concat(label, F.lit(" <Unknown>")))
    )


def section_type(title: Column, bibliography: bool = True) -> Column:
    """What a heading announces, by the first group of words it holds."""
    low = F.lower(title)
    # The words, English and Chinese.
    groups = {"abstract": ["abstract", "摘要"], "reference": ["reference", "参考文献", *(["bibliography"] if bibliography else [])], "appendix": ["appendix", "附录"], "acknowledgment": ["acknowledgment", "致谢"]}
    found: Column = F.lit("section")
    for kind, words in reversed(groups.items()):
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(low, F.lit(w))
        found = F.when(holds, kind).otherwise(found)
    return found


def structured_line(line: Column) -> Column:
    """List items and Markdown headings: the mark, then white space."""
    return line.rlike(rf"^(?:[#*\-]|[0-9]+[.)]|[A-Za-z][.)]){SPACE}")


def token_estimate(chars: Column, rate: float = 0.75) -> Column:
    return F.floor(chars * rate).cast("long")


def compression_ratio(skeleton_chars: Column, chars: Column) -> Column:
    """Per cent of the characters that the skeleton saves."""
    return (1 - skeleton_chars / F.greatest(chars, F.lit(1))) * 100


def char_recall(original: Column, extracted: Column) -> Column:
    return F.when(original == 0, 1.0).otherwise(extracted / F.greatest(original, F.lit(1)))
