"""Routers: from skeletons to anchors.

A router takes the blocks and their skeletons and returns the anchors of each window:
doc_id, window_index, total_windows, ord, block_id, level, title, snippet.  The rules need no
model; answers of a model can be recorded and replayed; a live model is a function that is
injected and called on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RoutingConfig, SkeletonConfig
from ..functions.features import potential_title, section_type
from ..functions.json_repair import parse_answer
from ..functions.prefix import detect_prefix
from ..functions.text import head, strip, text_or_empty
from ..operators.skeleton import assign_windows

DOC = "doc_id"
ROUTED = [DOC, "window_index", "total_windows", "ord", "block_id", "level", "title", "snippet"]


class Router(Protocol):
    def route(self, blocks: DataFrame, skeletons: DataFrame) -> DataFrame: ...


def with_rule_level(blocks: DataFrame) -> DataFrame:
    """Adds ``level``, which a heading's style, numbering, size or words give; null if it is none.

    Style before size and weight, these before numbering, and that before words.  What several
    rules share is computed once, in steps."""
    made = blocks.withColumns({"_st": strip(text_or_empty(F.col("text"))), "_title": potential_title()})
    made = made.withColumn("_open", (F.col("type") == "text") & (F.col("_st") != "") & ~F.col("_title") & (F.length("_st") < 60))
    made = made.withColumn("_prefix", F.when(F.col("_open"), detect_prefix(F.col("_st"))))
    made = made.withColumn("_number", F.regexp_extract("_st", r"^§?\s*([0-9]+(?:\.[0-9]+)*)", 1))
    numbered = F.col("_prefix.category").isin("compound_nested", "numeric_index", "legal_official", "cjk_ordinal") & (F.length("_st") > F.col("_prefix.end_pos"))
    by_number = F.when(F.col("_number") != "", F.least(F.size(F.split("_number", r"\.")), F.lit(6))).otherwise(1)
    size = F.coalesce("font_size", F.lit(0.0))
    level = (
        F.when((F.col("type") != "text") | (F.col("_st") == ""), F.lit(None))
        .when(F.coalesce("is_heading_style", F.lit(False)), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1))))
        .when(F.col("_title"), F.when(size >= 16, 1).when(size > 12, 2).otherwise(3))
        .when(numbered, by_number)
        .when((F.length("_st") < 30) & (section_type(F.col("_st")) != "section"), F.lit(1))
    )
    return made.withColumn("level", level.cast("int")).drop("_title", "_open", "_prefix", "_number")


class RuleRouter:
    """Anchors by fixed rules over the blocks; the same in every run."""

    def __init__(self, skeleton: SkeletonConfig = SkeletonConfig()):
        self.skeleton = skeleton

    def route(self, blocks: DataFrame, skeletons: DataFrame | None = None) -> DataFrame:
        rows = with_rule_level(blocks).select(DOC, "pos", "block_id", "level", F.when(F.col("level").isNotNull(), F.col("_st")).alias("title"))
        found = assign_windows(rows, self.skeleton).where("level is not null")
        number = F.row_number().over(Window.partitionBy(DOC, "window_index").orderBy("pos")).cast("int")
        return found.withColumn("ord", number).withColumn("snippet", head(F.col("title"), 40)).select(ROUTED)


class RecordedRouter:
    """Answers given before: doc_id, window_index, answer (text of a model, repaired if need be)."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def route(self, blocks: DataFrame, skeletons: DataFrame) -> DataFrame:
        return answers_to_anchors(self.said(skeletons))

    def said(self, skeletons: DataFrame) -> DataFrame:
        """doc_id, window_index, total_windows, answer."""
        return skeletons.select(DOC, "window_index", "total_windows").join(self.answers.select(DOC, "window_index", "answer"), [DOC, "window_index"], "left")


def answers_to_anchors(answers: DataFrame) -> DataFrame:
    parsed = answers.withColumn("_a", parse_answer(F.col("answer"))).where("_a is not null")
    rows = parsed.select(DOC, "window_index", "total_windows", F.posexplode("_a.chapters").alias("ord", "c"))
    return rows.where("c.block_id is not null").select(DOC, "window_index", "total_windows", "ord", "c.block_id", "c.level", "c.title", "c.snippet")


def answer_titles(answers: DataFrame) -> DataFrame:
    """doc_id, doc_title, doc_authors: what the answer for a document's first window says of it."""
    parsed = answers.where("window_index = 0").withColumn("_a", parse_answer(F.col("answer")))
    said = parsed.groupBy(DOC).agg(F.max(F.struct("_a.doc_title", "_a.doc_authors")).alias("_t"))
    return said.select(DOC, F.coalesce("_t.doc_title", F.lit("")).alias("doc_title"), F.coalesce("_t.doc_authors", F.lit("")).alias("doc_authors"))


def answer_errors(answers: DataFrame) -> DataFrame:
    """doc_id, window_index, error: answers from which no headings can be read."""
    wrong = F.when(F.col("answer").isNull(), F.lit("no answer")).when(parse_answer(F.col("answer")).isNull(), F.concat(F.lit("unreadable: "), F.substring("answer", 1, 200)))
    return answers.select(DOC, "window_index", wrong.alias("error")).where("error is not null")


#: skeleton, window index, number of windows, headings before -> answer
Ask = Callable[[str, int, int, str], str]


class ModelRouter:
    """A model behind ``make_ask``, which is called once in each worker and gives the function asked.

    Windows of a document are asked in turn, each told the last two headings of the last window
    that had any; or all at once, and then again in turn only where a window begins deeper than the
    one before allows.  ``said`` gives the answers, from which ``answers_to_anchors``, ``answer_titles``
    and ``answer_errors`` read; write it before using it twice: a model may answer otherwise."""

    def __init__(self, make_ask: Callable[[], Ask], routing: RoutingConfig = RoutingConfig()):
        self.make_ask, self.routing = make_ask, routing

    def route(self, blocks: DataFrame, skeletons: DataFrame) -> DataFrame:
        return answers_to_anchors(self.said(skeletons))

    def said(self, skeletons: DataFrame) -> DataFrame:
        """doc_id, window_index, total_windows, answer."""
        make_ask, routing = self.make_ask, self.routing
        client = _Client(make_ask)

        def one_document(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("window_index")
            answers = ask_windows(client.get(), list(rows["text"]), routing)
            return rows[[DOC, "window_index", "total_windows"]].assign(answer=answers)

        schema = f"{DOC} long, window_index int, total_windows int, answer string"
        single = skeletons.where("total_windows = 1")
        several = skeletons.where("total_windows > 1")

        def single_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = client.get()
            for rows in batches:
                yield rows[[DOC, "window_index", "total_windows"]].assign(answer=[ask(t, 0, 1, "") for t in rows["text"]])

        return single.mapInPandas(single_windows, schema).unionByName(several.groupBy(DOC).applyInPandas(one_document, schema))


class _Client:
    """The function asked, made when it is first needed in a process; only how to make it is shipped."""

    def __init__(self, make_ask: Callable[[], Ask]):
        self.make_ask, self.key = make_ask, uuid.uuid4().hex

    def get(self) -> Ask:
        if self.key not in _CLIENTS:
            _CLIENTS[self.key] = self.make_ask()
        return _CLIENTS[self.key]


_CLIENTS: dict[str, Ask] = {}


def ask_windows(ask: Ask, texts: list[str], routing: RoutingConfig = RoutingConfig()) -> list[str]:
    """The answers of a document's windows."""
    total = len(texts)
    if routing.speculative and total > 2:
        with ThreadPoolExecutor(min(total, routing.at_once)) as pool:
            answers = list(pool.map(lambda i: ask(texts[i], i, total, ""), range(total)))
        for i in range(1, total):
            before, here = _levels(answers[i - 1]), _levels(answers[i])
            if before and here and here[0][0] > before[-1][0] + routing.boundary_tolerance:
                answers[i] = ask(texts[i], i, total, _context(before))
        return answers
    answers, context = [], ""
    for i, t in enumerate(texts):
        answers.append(ask(t, i, total, context))
        context = _context(_levels(answers[-1])) or context
    return answers


def _levels(answer: str) -> list[tuple[int, str]]:
    """Level and title of an answer's headings."""
    import json
    import re

    found = re.search(r"\{.*\}", answer, re.DOTALL)
    try:
        chapters = json.loads(found[0]).get("chapters", []) if found else []
    except json.JSONDecodeError:
        return []
    return [(c.get("level", 1), c.get("title", "")) for c in chapters]


def _context(headings: list[tuple[int, str]]) -> str:
    return "\n".join(f"- Level {level}: {title}" for level, title in headings[-2:])
