"""Answers of a language model: fenced or surrounded JSON, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

ANSWER = "doc_title string, doc_authors string, chapters array<struct<title string, start_block_id int, block_id int, level int, snippet string>>"


def unfenced(answer: Column) -> Column:
    """Without the fence around it."""
    opened = F.when(F.startswith(answer, F.lit("```json")), F.substring(answer, F.lit(8), F.length(answer))).when(F.startswith(answer, F.lit("```")), F.substring(answer, F.lit(4), F.length(answer))).otherwise(answer)
    return strip(F.when(F.endswith(opened, F.lit("```")), F.substring(opened, F.lit(1), F.length(opened) - 3)).otherwise(opened))


def parse_answer(answer: Column) -> Column:
    """struct(doc_title, doc_authors, chapters), or null where no JSON object is found.

    The whole answer is tried first, then what lies between the first and the last brace.  A
    chapter may name its block ``block_id``; a missing snippet is the title; a missing level 1."""
    text = unfenced(answer)
    read = [F.from_json(t, ANSWER, {"mode": "PERMISSIVE"}) for t in (text, F.regexp_extract(text, r"(?s)\{.*\}", 0))]
    whole = F.coalesce(*[F.when(r["chapters"].isNotNull(), r) for r in read])

    def chapter(c: Column) -> Column:
        return F.struct(
            c["title"].alias("title"),
            F.coalesce(c["start_block_id"], c["block_id"]).alias("block_id"),
            F.coalesce(c["level"], F.lit(1)).alias("level"),
            F.when(F.coalesce(c["snippet"], F.lit("")) == "", F.coalesce(c["title"], F.lit(""))).otherwise(c["snippet"]).alias("snippet"),
        )

    return F.when(whole.isNotNull(), F.struct(F.coalesce(whole["doc_title"], F.lit("")).alias("doc_title"), F.coalesce(whole["doc_authors"], F.lit("")).alias("doc_authors"), F.transform(whole["chapters"], chapter).alias("chapters")))
