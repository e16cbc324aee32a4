"""String expressions with the meaning that Unicode-aware code gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode that count as white space, as a regex class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def head(text: Column, n: int | Column) -> Column:
    """The first n characters."""
    return F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: 1 for two empty strings, 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def starts_with(text: Column, prefix: Column) -> Column:
    return F.startswith(text, prefix)
