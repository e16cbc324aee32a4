"""Numbering and bullets at the beginning of a text: ordered rules, the first that matches wins."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# The rules, in the order in which they are tried.
_D = r"[0-9０-９]"
_CJK = r"[一二三四五六七八九十百千]"
_CJK_D = r"[一二三四五六七八九十百千0-9０-９]"
_S = SPACE
_ROMAN_UPPER = r"(?=[IVXLCDM])M*(?:D?C{0,3}|C[DM])(?:L?X{0,3}|X[LC])(?:V?I{0,3}|I[VX])[.)]"
_ROMAN_LOWER = r"(?=[ivxlcdm])m*(?:d?c{0,3}|c[dm])(?:l?x{0,3}|x[lc])(?:v?i{0,3}|i[vx])[.)]"
_BULLETS = "•‣⁃⁌⁍∙▪▫▶▸►○●◦★☆☐☑☒✓✔✖✗✘❖➕➢➤※■□▢▲▼♦♥♣♠"
RULES: tuple[tuple[str, str], ...] = (
    ("compound_nested", rf"^[A-Za-z0-9Ⅰ-ⅿ]+(?:[.\-—．][A-Za-z0-9Ⅰ-ⅿ]+){{2,}}(?:[.)）、]|{_S})*"),
    ("cjk_ordinal", rf"^(?:[（(]{_CJK_D}+[）)]{_S}*|{_CJK}+[、，：:．.]{_S}*|第{_CJK_D}+[章节条款部分编篇卷]{_S}*|附[件录表图]{_S}*{_CJK_D}*[：:、]?{_S}*)"),
    ("legal_official", rf"^(?:(?i:article|section|clause|part|chapter|schedule|annex|appendix){_S}+{_D}+(?:\.{_D}+)*[.:]?{_S}*|§{_S}*{_D}+(?:\.{_D}+)*[.:]?{_S}*)"),
    ("bracket_citation", rf"^\[(?:[0-9０-９,\-–—]|{_S})+\]{_S}*"),
    ("paren_ordinal", rf"^\((?:(?:[0-9０-９,\-]|{_S})+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)\){_S}*"),
    ("latin_roman", rf"^(?:[A-Z]{{1,3}}[.)]{_S}*|[a-z][.)]{_S}*|{_ROMAN_UPPER}{_S}*|{_ROMAN_LOWER}{_S}*)"),
    ("numeric_index", rf"^{_D}+(?:\.{_D}+)*[.)、．]?{_S}*"),
    ("unicode_bullet", rf"^[{_BULLETS}]{_S}*"),
    ("markdown_leftover", rf"^(?:#{{1,6}}{_S}+|[\-*+]{_S}+|>{_S}+|{_D}+\.{_S}+)"),
    ("dash_bullet", rf"^(?:-{{2,3}}{_S}+|—{{1,2}}{_S}+|─{{2,}}{_S}+|－{{1,2}}{_S}+)"),
)


def custom_rules(patterns: Sequence[str]) -> list[tuple[str, str]]:
    """Rules of the caller, tried first: anchored at the start, white space behind included."""
    out = []
    for i, p in enumerate(patterns):
        re.compile(p)
        p = p if p.startswith("^") else f"^{p}"
        out.append((f"custom_{i}", p if p.endswith(r"\s*") else rf"{p}\s*"))
    return out


def detect_prefix(text: Column, custom: Sequence[str] = ()) -> Column:
    """struct(end_pos, category, matched_text), or null; end_pos counts characters."""
    found: Column = F.lit(None)
    for category, pattern in reversed([*custom_rules(custom), *RULES]):
        matched = F.regexp_extract(text, pattern, 0)
        found = F.when(text.rlike(pattern), F.struct(F.length(matched).alias("end_pos"), F.lit(category).alias("category"), matched.alias("matched_text"))).otherwise(found)
    return found


def prefix_length(text: Column, custom: Sequence[str] = ()) -> Column:
    """Length of the prefix, 0 if there is none."""
    found: Column = F.lit(0)
    for _, pattern in reversed([*custom_rules(custom), *RULES]):
        found = F.when(text.rlike(pattern), F.length(F.regexp_extract(text, pattern, 0))).otherwise(found)
    return found
