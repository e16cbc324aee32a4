"""The pipeline: each stage against what it should do to its input, on planted documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_stages_in_order(spark, tables):
    passage = words(70, "passage")
    rows = []
    for i in range(60):
        rows.append((i, f"{words(40, i).capitalize()}.\n{words(30, i + 500)}.", f"s{i % 3}"))
    rows += [(100, words(80, 7) + "\n" + passage, "s0"), (101, words(80, 8) + "\n" + passage, "s1")]
    copy = words(80, 9).split()
    rows += [(110, " ".join(copy), "s0"), (111, " ".join([*copy[:-1], "changed"]), "s1"), (112, " ".join(copy), "s2")]
    junk = [(200 + i, " ".join(f"{w}!!$$$" for w in words(60, i + 900).upper().split()), "s2") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows + junk], DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in junk], "doc_id long, quality int, toxic int")
    folder = tables(documents=docs, labels=labels)

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder)
    assert {r.doc_id for r in good.collect()} == {r[0] for r in rows}
    lines = stages["line_dedup"](spark, good, folder)
    text = {r.doc_id: r.text for r in lines.collect()}
    assert passage in text[100] and text[101] == words(80, 8) and text[112] == "" and text[0] == rows[0][1]
    near = stages["near_dedup"](spark, lines, folder)
    kept = {r.doc_id for r in near.collect()}
    assert {110, 112} <= kept and 111 not in kept and set(range(60)) <= kept
    assert near.columns == lines.columns == good.columns == docs.columns
    mixed = stages["mixing"](spark, near, folder)
    planned = {r.doc_id: r.copies for r in mixing.plan_mix(near).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in planned.items() if n}
    done = stages["tokens"](spark, mixed, folder)
    assert done.count() == mixed.count() and done.where(~F.col("exact")).count() == 0

    ran = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in ran.collect()) == sorted(r.doc_id for r in done.collect())


def test_pipeline_of_an_empty_table(spark, tables):
    folder = tables(documents=spark.createDataFrame([], DOCS), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_copies_of_a_large_table_have_one_group_each(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = simhash.similar_documents(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.component_id for r in groups.collect()}
    split = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 20 and [p for p in pairs if found[p[0]] != found[p[1]]] == []
    for i, c in found.items():
        assert c <= i and (c == i or any(i in p for p in pairs))
