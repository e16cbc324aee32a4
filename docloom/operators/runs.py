"""Styled runs of a paragraph: normalised, merged and rendered as Markdown, in arrays.

A run: text, bold, italic, underline, strike, sup, sub, code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,sup:boolean,sub:boolean,code:boolean>"
STYLES = ("bold", "italic", "underline", "strike", "sup", "sub", "code")


def _on(run: Column, style: str) -> Column:
    return F.coalesce(run[style], F.lit(False))


def normalise_runs(runs: Column, all_bold: Column) -> Column:
    """Without empty runs; bold is dropped where the whole paragraph is bold."""
    full = F.filter(runs, lambda r: F.coalesce(F.length(r["text"]), F.lit(0)) > 0)
    return F.transform(full, lambda r: F.struct(r["text"].alias("text"), (_on(r, "bold") & ~all_bold).alias("bold"), *[_on(r, s).alias(s) for s in STYLES[1:]]))


def merge_runs(runs: str) -> Column:
    """Neighbours of equal style become one run; an unstyled blank run joins the one before.

    ``runs`` names the column; normalised runs are expected."""
    same = " and ".join(f"p.{s} = x.{s}" for s in STYLES)
    plain = " and ".join(f"not x.{s}" for s in STYLES)
    joined = ", ".join(["'text', concat(p.text, x.text)", *[f"'{s}', p.{s}" for s in STYLES]])
    blank = f"regexp_like(x.text, r'\\A{SPACE}*\\z')"
    step = f"if(size(s) > 0 and exists(slice(s, -1, 1), p -> ({same}) or ({blank} and {plain})), concat(slice(s, 1, size(s) - 1), transform(slice(s, -1, 1), p -> named_struct({joined}))), concat(s, array(x)))"
    return F.expr(f"aggregate({runs}, cast(array() as array<{RUN}>), (s, x) -> {step.replace('slice(s, -1, 1)', 'slice(s, greatest(size(s), 1), 1)')})")


def wrap(text: Column, before: str, after: str) -> Column:
    """The mark inside the white space around the text; blank text stays."""
    lead = F.regexp_extract(text, rf"^{SPACE}*", 0)
    core = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")
    tail = F.substring(text, F.length(lead) + F.length(core) + 1, F.length(text))
    return F.when(core == "", text).otherwise(F.concat(lead, F.lit(before), core, F.lit(after), tail))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _styled(text: Column, on: Column, before: str, after: str) -> Column:
    return _let(text, lambda t: F.when(on, wrap(t, before, after)).otherwise(t))


def render_runs(runs: Column) -> Column:
    """From the inside: code, strike, italic, bold, underline (without bold and italic), raised, lowered."""

    def render(r: Column) -> Column:
        out = _let(r["text"], lambda t: F.when(_on(r, "code"), wrap(F.regexp_replace(t, "`", r"\\`"), "`", "`")).otherwise(t))
        for style, before, after in (("strike", "~~", "~~"), ("italic", "*", "*"), ("bold", "**", "**")):
            out = _styled(out, _on(r, style), before, after)
        out = _styled(out, _on(r, "underline") & ~_on(r, "bold") & ~_on(r, "italic"), "<u>", "</u>")
        return _styled(_styled(out, _on(r, "sup"), "<sup>", "</sup>"), _on(r, "sub"), "<sub>", "</sub>")

    return F.array_join(F.transform(runs, render), "")


def mostly(runs: Column, style: str, share: float = 0.8) -> Column:
    """Whether at least ``share`` of the runs that are not blank have a style."""
    shown = F.filter(runs, lambda r: ~r["text"].rlike(rf"\A{SPACE}*\z"))
    return (F.size(shown) > 0) & (F.size(F.filter(shown, lambda r: _on(r, style))) >= share * F.size(shown))
