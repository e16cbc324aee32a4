"""Operators of document structuring on small documents with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.config import LimiterConfig, ResolverConfig, RoutingConfig, SkeletonConfig
from docloom.functions import features as X
from docloom.functions import markdown as MD
from docloom.functions.json_repair import parse_answer
from docloom.functions.prefix import detect_prefix
from docloom.functions.text import similarity, strip
from docloom.operators import anchors as A
from docloom.operators import evaluation as E
from docloom.operators import skeleton as S
from docloom.operators import tree as TR
from docloom.operators.limiter import limit_requests
from docloom.plans.router import ModelRouter, RecordedRouter, RuleRouter, ask_windows
from docloom.plans.structure import content_hash, not_done_before, resolve, structure
from docloom.schema import ANCHORS, BLOCKS

TAIL = " and so on" * 12


def block(pos, text="body text", type="text", doc=1, **kw):
    base = {"doc_id": doc, "pos": pos, "block_id": pos, "type": type, "text": text, "image_data": None, "caption": None, "table_data": None, "metadata": {}, "is_bold": False, "font_size": 12.0, "alignment": None, "is_heading_style": False, "heading_level": None}
    return base | kw


def blocks(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in BLOCKS.fields) for r in rows], BLOCKS)


def anchors(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, b, level, title, snippet) for i, (b, level, title, snippet) in enumerate(rows)], ANCHORS)


def titles(sections):
    return [(r.start_block_id, r.level) for r in sections.orderBy("ord").collect()]


def test_swallowed_heading_is_promoted(spark):
    sizes = [16, 12, 12, 18, 12, 16, 12]
    rows = [block(i, f"Heading {i}" if s > 12 else "body " + TAIL, font_size=float(s), is_bold=s > 12) for i, s in enumerate(sizes)]
    found = resolve(anchors(spark, [(0, 1, "Heading 0", "Heading 0"), (5, 1, "Heading 5", "Heading 5")]), blocks(spark, rows))
    assert [b for b, _ in titles(found)] == [0, 3, 5]


def test_normal_document_gets_no_more_headings(spark):
    rows = [block(i, f"Heading {i}" if s > 12 else "body " + TAIL, font_size=float(s), is_bold=s > 12) for i, s in enumerate([16, 12, 12, 16, 12])]
    found = resolve(anchors(spark, [(0, 1, "Heading 0", "Heading 0"), (3, 1, "Heading 3", "Heading 3")]), blocks(spark, rows))
    assert titles(found) == [(0, 1), (3, 1)]


def test_bold_block_of_the_same_size_is_promoted(spark):
    rows = [block(0, "Chapter", font_size=14.0), block(1, "body " + TAIL), block(2, "Bold one", font_size=14.0, is_bold=True), block(3, "body " + TAIL)]
    assert [b for b, _ in titles(resolve(anchors(spark, [(0, 1, "Chapter", "Chapter")]), blocks(spark, rows)))] == [0, 2]


def test_overlap_dedup(spark):
    rows = [(0, "Intro"), (1, "Intro"), (50, "Methods used"), (52, "Methods used"), (100, "End")]
    routed = anchors(spark, [(b, 1, t, t) for b, t in rows]).withColumn("window_index", F.lit(0)).withColumn("total_windows", F.lit(2))
    assert [r.block_id for r in A.merge_windows(routed).orderBy("ord").collect()] == [0, 50, 100]
    single = routed.withColumn("total_windows", F.lit(1))
    assert A.merge_windows(single).count() == 5


def test_windows_of_800_blocks(spark):
    cfg = SkeletonConfig(window_size=150, window_overlap=30)
    placed = S.assign_windows(blocks(spark, [block(i) for i in range(800)]), cfg)
    got = placed.groupBy("window_index").agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.first("ws").alias("ws"), F.first("we").alias("we")).orderBy("window_index").collect()
    want, start = [], 0
    while True:
        end = min(start + 150, 800)
        want.append((start, end))
        if end == 800:
            break
        start += 120
    assert [(r.ws, r.we) for r in got] == want == [(r.a, r.z + 1) for r in got]


def test_overlap_must_be_less_than_size():
    with pytest.raises(ValueError, match="strictly less"):
        SkeletonConfig(window_size=50, window_overlap=50)


def test_long_centred_title_is_kept_whole(spark):
    title = "A long title " * 6
    line = blocks(spark, [block(0, title, is_bold=True, alignment="center")]).select(X.skeleton_line(X.is_key_frame()).alias("x")).first().x
    assert title.strip() in line and "省略" not in line
    cut = blocks(spark, [block(0, "x" * 100)]).select(X.skeleton_line(X.is_key_frame()).alias("x")).first().x
    assert cut == "[0] " + "x" * 40 + "...[省略30字]..." + "x" * 30


def test_plain_blocks_are_folded_and_stay_visible(spark):
    rows = [block(i, f"{i}. item with words " + TAIL) for i in range(7)]
    text = S.skeletons(blocks(spark, rows)).first().text
    assert "[0 to 6] <Text: 7 Paras" in text and all(f"  [{i}] {i}. item" in text for i in range(7))
    unfolded = S.skeletons(blocks(spark, rows), SkeletonConfig(fold=False)).first().text
    assert "Paras" not in unfolded


def test_fold_groups_equal_a_loop(spark):
    rng, rows = random.Random(1), []
    for doc in range(30):
        for i in range(rng.randint(1, 45)):
            rows.append(block(i, "t", doc=doc, font_size=16.0 if rng.random() < 0.2 else 11.0))
    cfg = SkeletonConfig(fold_least=3, fold_most=4)
    got = {(r.doc_id, r.pos): r.folded for r in S.fold_groups(S.assign_windows(blocks(spark, rows), cfg), cfg).collect()}
    for doc in range(30):
        mine, run = [r for r in rows if r["doc_id"] == doc], []

        def flush(run, doc=doc):
            for p in run:
                assert got[doc, p] == (len(run) >= 3)

        for r in mine:
            if r["font_size"] > 12:
                flush(run)
                run = []
                assert not got[doc, r["pos"]]
            else:
                run.append(r["pos"])
                if len(run) == 4:
                    flush(run)
                    run = []
        flush(run)


def test_levels_equal_a_loop(spark):
    rng, rows, heads = random.Random(2), [], []
    for doc in range(40):
        n = rng.randint(1, 12)
        for i in range(n):
            rows.append(block(i, f"h{i}", doc=doc, font_size=rng.choice([None, 0.0, 12.0, 14.0, 14.4, 16.0, 18.0])))
            heads.append((doc, i, i, rng.randint(1, 6), f"h{i}", f"h{i}"))
    found = A.fix_levels(spark.createDataFrame(heads, ANCHORS), blocks(spark, rows))
    got = {(r.doc_id, r.ord): r.level for r in found.collect()}
    size = {(r["doc_id"], r["pos"]): r["font_size"] for r in rows}
    for doc in range(40):
        fonts, before = {}, None
        for _, i, b, level, *_ in [h for h in heads if h[0] == doc]:
            s = size[doc, b]
            fit = min([k for k, v in fonts.items() if abs(v - s) <= 0.5], default=None) if s else None
            if before is None:
                level = 1
            elif level > before + 1:
                level = fit or before + 1
            elif level > 1 and fit is not None and fit < level:
                level = fit
            if s and level not in fonts:
                fonts[level] = s
            before = level
            assert got[doc, i] == level


def test_truncated_title_is_restored(spark):
    full = "A complete heading that the model cut"
    rows = blocks(spark, [block(0, full), block(1, "body")])
    for title in ("A complete[省略9字]", "A complete heading...", "A complete headi?"):
        assert A.restore_titles(anchors(spark, [(0, 1, title, title)]), rows).first().title == full
    assert A.restore_titles(anchors(spark, [(0, 1, "Short...", "x")]), rows).first().title == "Short..."


def test_empty_anchors_fall_back_to_one_section(spark):
    none = spark.createDataFrame([], ANCHORS)
    got = resolve(none, blocks(spark, [block(0, "First  "), block(1, "second")])).collect()
    assert [(r.title, r.level, r.start_block_id, r.end_block_id, r.content) for r in got] == [("Document", 1, 0, 1, "First  \n\nsecond")]


def test_tree_equals_a_stack(spark):
    rng, rows = random.Random(3), []
    for doc in range(30):
        rows += [(doc, i, rng.randint(1, 7)) for i in range(rng.randint(1, 15))]
    got = {(r.doc_id, r.ord): (r.parent_ord, r.depth, r.root_ord) for r in TR.with_parents(spark.createDataFrame(rows, "doc_id long, ord int, level int")).collect()}
    for doc in range(30):
        stack = []
        for _, i, level in [r for r in rows if r[0] == doc]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[doc, i] == (stack[-1][0] if stack else None, len(stack) + 1, stack[0][0] if stack else i)
            stack.append((i, level))


def sections(spark):
    rows = [(1, 0, 1, "A", "section", 0, 1, "x"), (1, 1, 2, "B", "section", 2, 2, "yy"), (1, 2, 3, "C", "section", 3, 4, "z" * 5), (1, 3, 1, "D", "reference", 5, 5, "")]
    return TR.with_parents(spark.createDataFrame(rows, "doc_id long, ord int, level int, title string, section_type string, start_block_id int, end_block_id int, content string"))


def test_statistics_and_outputs(spark):
    s = sections(spark)
    meta = spark.createDataFrame([(1, "T", "Me", "pre")], "doc_id long, doc_title string, doc_authors string, preamble string")
    r = TR.tree_statistics(s).first()
    assert (r.top_sections, r.sections, r.chars, r.max_depth) == (2, 4, 8, 3)
    assert TR.to_markdown(s, meta).first().markdown == "# T\n\n*Me*\n\npre\n\n## A\n\nx\n\n### B\n\nyy\n\n#### C\n\nzzzzz\n\n## D\n"
    assert [r.content for r in TR.to_markdown_sections(s).orderBy("root_ord").collect()] == ["# A\n\nx\n\n### B\n\nyy\n\n#### C\n\nzzzzz\n", "# D\n"]
    tree = json.loads(TR.to_json(s, meta).first().json)
    assert [x["title"] for x in tree["sections"]] == ["A", "D"] and tree["sections"][0]["children"][0]["children"][0]["title"] == "C"
    paper = {r.title: r for r in TR.to_paper(s, meta).collect()}
    assert paper["B"].parent_id == paper["A"].id and paper["A"].parent_id is None and len(paper["A"].id) == 36


def test_similarity_and_prefixes(spark):
    row = spark.createDataFrame([("kitten", "sitting", "", "é")], "a string, b string, c string, d string").select(similarity(F.col("a"), F.col("b")).alias("x"), similarity(F.col("c"), F.col("c")).alias("y"), similarity(F.col("a"), F.col("c")).alias("z"), similarity(F.col("d"), F.lit("e")).alias("w"), strip(F.lit("　\xa0 a b \n")).alias("s")).first()
    assert (round(row.x, 6), row.y, row.z, row.w, row.s) == (round(1 - 3 / 7, 6), 1.0, 0.0, 0.0, "a b")
    cases = {"1.2.3.4 x": "compound_nested", "state-of-the-art": "compound_nested", "第三章 绪论": "cjk_ordinal", "(1) x": "cjk_ordinal", "(a) x": "paren_ordinal", "Section 4. x": "legal_official", "[1,2] x": "bracket_citation", "A. x": "latin_roman", "xiv) x": "latin_roman", "12 x": "numeric_index", "• x": "unicode_bullet", "## x": "markdown_leftover", "-- x": "dash_bullet", "plain": None, ") x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", detect_prefix(F.col("t"))["category"].alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_markdown_of_blocks(spark):
    rows = [block(0, "a [RAW_XML_NODE: txbxContent] box\nb [RAW_XML_NODE: oMath]"), block(1, None, "image", caption="c", image_data="u"), block(2, None, "table", table_data=([["a", "b"], ["1"], ["1", "2", "3"]],)), block(3, "def f():", "code"), block(4, "x", "formula"), block(5, "---", metadata={"source": "horizontal_rule"}), block(6, None), block(7, None, "table")]
    got = [r.m for r in blocks(spark, rows).orderBy("pos").select(MD.block_markdown().alias("m")).collect()]
    assert got == ["a > **[文本框]** box\nb $ … $", "![c](u)", "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |", "```python\ndef f():\n```", "$$ x $$", "---", "", "[表格: 未命名]"]


def heads(spark, rows):
    return spark.createDataFrame([(1, i, b, level, t) for i, (b, level, t) in enumerate(rows)], "doc_id long, ord int, block_id int, level int, title string")


@pytest.mark.parametrize(
    ("truth", "predicted", "want"),
    [
        ([(0, 1, "Intro"), (10, 2, "Methods")], [(0, 1, "Intro"), (10, 2, "Methods")], (2, 0, 0, 1.0, 1.0, 0)),
        ([(0, 1, "Intro")], [(3, 1, "Intro")], (1, 0, 0, 1.0, 1.0, 0)),
        ([(0, 1, "Intro")], [(4, 1, "Intro")], (0, 1, 1, 0.0, 0.0, 0)),
        ([(0, 1, "Intro")], [(0, 2, "Intro")], (1, 0, 0, 1.0, 0.0, 1)),
        ([(0, 1, "Intro")], [(0, 1, "Other thing")], (0, 1, 1, 0.0, 0.0, 1)),
        ([], [(0, 1, "x")], (0, 1, 0, 0.0, 0.0, 1)),
    ],
)
def test_scores(spark, truth, predicted, want):
    r = E.evaluate(heads(spark, truth), heads(spark, predicted), spark.range(1, 2).withColumnRenamed("id", "doc_id")).first()
    assert (r.tp, r.fp, r.fn, r.f1, r.hierarchy_accuracy, r.ted) == want


def test_other_convention_without_headings(spark):
    r = E.without_headings(E.evaluate(heads(spark, []), heads(spark, [(0, 1, "x")]), spark.range(1, 2).withColumnRenamed("id", "doc_id"))).first()
    assert (r.f1, r.recall, r.ted) == (0.0, 1.0, 1)


def test_limiter_refills_whole_windows(spark):
    rows = [(i, "k", t) for i, t in enumerate([0, 1, 2, 3, 9, 10, 11, 25])] + [(99, None, 5)]
    events = spark.createDataFrame(rows, "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.allowed, r.remaining, r.retry_after) for r in limit_requests(events, "key", "ts", "id", LimiterConfig(2, 10)).collect()}
    assert got == {0: (True, 1, 0), 1: (True, 0, 0), 2: (False, 0, 9), 3: (False, 0, 8), 4: (False, 0, 2), 5: (True, 1, 0), 6: (True, 0, 0), 7: (True, 1, 0), 99: (True, 1, 0)}


def test_answers_are_repaired(spark):
    good = '{"doc_title": "T", "chapters": [{"title": "A", "block_id": 3, "level": 2}]}'
    rows = [good, f"```json\n{good}\n```", f"Sure!\n{good} bye", "no json"]
    got = [r.a for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(parse_answer(F.col("x")).alias("a")).collect()]
    assert got[3] is None and all((a.doc_title, a.chapters[0].block_id, a.chapters[0].level, a.chapters[0].snippet) == ("T", 3, 2, "A") for a in got[:3])


def test_serial_and_speculative_asking():
    asked = []

    def ask(text, i, total, context):
        asked.append((i, context))
        level = 3 if i == 1 and not context else 1
        return json.dumps({"chapters": [{"title": f"w{i}", "level": level}]})

    ask_windows(ask, ["a", "b", "c"])
    assert asked == [(0, ""), (1, "- Level 1: w0"), (2, "- Level 1: w1")]
    asked.clear()
    ask_windows(ask, ["a", "b", "c"], RoutingConfig(speculative=True))
    assert sorted(asked[:3]) == [(0, ""), (1, ""), (2, "")] and asked[3:] == [(1, "- Level 1: w0")]


def test_routers_give_the_same_shape(spark):
    answer = json.dumps({"chapters": [{"title": "Chapter 0", "block_id": 0, "level": 1}]})

    def make_ask():
        return lambda text, i, total, context: answer

    rows = blocks(spark, [block(0, "Chapter 0", font_size=16.0), block(1, "body " + TAIL)])
    answers = spark.createDataFrame([(1, 0, answer)], "doc_id long, window_index int, answer string")
    for router in (RuleRouter(), RecordedRouter(answers), ModelRouter(make_ask)):
        found = structure(rows, router)
        assert [(r.title, r.level, r.content) for r in found.sections.collect()] == [("Chapter 0", 1, "body " + TAIL)]
        assert found.markdown().first().markdown.startswith("## Chapter 0")


def test_titles_and_errors_of_answers(spark):
    rows = blocks(spark, [block(0, "Heading", doc=1), block(1, "x" + TAIL, doc=1), block(0, "other text", doc=2), block(0, "third", doc=3)])
    good = '{"doc_title": "The title", "doc_authors": "A. B.", "chapters": [{"title": "Heading", "start_block_id": 0, "level": 1}]}'
    answers = spark.createDataFrame([(1, 0, good), (2, 0, "no idea, sorry")], "doc_id long, window_index int, answer string")
    found = structure(rows, RecordedRouter(answers))
    assert {r.doc_id: r.error for r in found.errors.collect()} == {2: "unreadable: no idea, sorry", 3: "no answer"}
    assert {r.doc_id: (r.doc_title, r.doc_authors) for r in found.meta.collect()}[1] == ("The title", "A. B.")
    shown = {r.doc_id: r.markdown for r in found.markdown().collect()}
    assert shown[1].startswith("# The title\n") and "*A. B.*" in shown[1] and shown[2].startswith("## Document")


def test_a_worker_makes_its_client_once(spark, tmp_path):
    made = str(tmp_path)

    def make_ask():
        import os
        import uuid

        open(os.path.join(made, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda text, i, total, before: '{"chapters": [{"title": "t", "start_block_id": 0, "level": 1}]}'

    from docloom.config import SkeletonConfig

    small = SkeletonConfig(window_threshold=2, window_size=2, window_overlap=1)
    rows = blocks(spark, [block(p, f"line {p}", doc=d) for d in range(12) for p in range(5)])
    assert structure(rows, ModelRouter(make_ask), small).sections.count() >= 12
    names = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert names and len(names) == len(set(names))


def test_windows_are_asked_at_once_and_deep_ones_again():
    import threading

    from docloom.config import RoutingConfig

    gate, asked = threading.Barrier(4, timeout=20), []

    def ask(text, i, total, before):
        if not before:
            gate.wait()  # passes only if all four are asked at the same time
        asked.append((i, before))
        return '{"chapters": [{"title": "t%d", "level": %d}]}' % (i, 4 if i == 2 and not before else 1)

    got = ask_windows(ask, ["a", "b", "c", "d"], RoutingConfig(speculative=True))
    assert sorted(i for i, b in asked if not b) == [0, 1, 2, 3] and [a for a in asked if a[1]] == [(2, "- Level 1: t1")]
    assert '"level": 1' in got[2]


def test_levels_above_nine_nest(spark):
    rows = [(1, 0, 1), (1, 1, 9), (1, 2, 10), (1, 3, 11), (1, 4, 12), (1, 5, 11)]
    got = {r.ord: (r.parent_ord, r.depth) for r in TR.with_parents(spark.createDataFrame(rows, "doc_id long, ord int, level int")).collect()}
    assert got == {0: (None, 1), 1: (0, 2), 2: (1, 3), 3: (2, 4), 4: (3, 5), 5: (2, 4)}


def test_the_report_has_every_document(spark):
    rows = spark.range(1001).selectExpr("id AS doc_id", "1L AS tp", "0L AS fp", "1L AS fn", "0L AS level_correct", "1L AS level_total", "2L AS ted")
    lines = {r.doc_id: r.line for r in E.report(E.with_rates(rows)).collect()}
    assert len(lines) == 1001 and lines[1000] == "| 1000 | 1 | 0 | 1 | 1.0000 | 0.5000 | 0.6667 | 0.0000 | 2 |"
    assert E.REPORT_HEAD.count("|") == 20


def test_content_hash_and_cache(spark):
    one, other = blocks(spark, [block(0, "a")]), blocks(spark, [block(0, "a", is_bold=True)])
    assert content_hash(one).first().hash != content_hash(other).first().hash
    assert not_done_before(one, content_hash(one)).count() == 0 and not_done_before(one, content_hash(other)).count() == 1


def test_blocks_with_nulls_and_ties_do_not_crash(spark):
    rows = [block(0, None), block(0, None, type=None), block(2, "", font_size=None, is_bold=None, is_heading_style=None), block(3, "  ")]
    rows[1]["pos"] = 1
    assert structure(blocks(spark, rows)).sections.count() == 1
    assert structure(blocks(spark, [])).sections.count() == 0
    assert resolve(anchors(spark, [(9, 4, "x", ""), (-3, 2, "", "")]), blocks(spark, rows), ResolverConfig()).count() == 2


def test_papers_summaries_and_prompts(spark, tmp_path):
    from docloom.operators import papers as P
    from docloom.operators import summaries as U
    from docloom.plans.prompts import load_prompt

    rows = [block(0, "Abstract", font_size=16.0, is_bold=True), block(1, "same"), block(2, "x = 1", "code"), block(3, "same"), block(0, "alone", doc=2)]
    b = blocks(spark, rows)
    meta = spark.createDataFrame([(1, "T", "Me"), (2, "file.docx", "")], "doc_id long, doc_title string, doc_authors string")
    given = spark.createDataFrame([(1, 0, 0, 1, "Abstract")], "doc_id long, ord int, block_id int, level int, title string")
    got = {r.doc_id: (r.title, r.type, r.content) for r in P.paper_from_headings(given, b, meta).collect()}
    assert got == {1: ("Abstract", "abstract", "same\n\nsame"), 2: ("file.docx", "section", "")}
    own = spark.createDataFrame([(1, 0, 1, "Bibliography", "c")], "doc_id long, ord int, level int, title string, content string")
    assert P.paper_from_sections(own, meta).first().type == "section"
    assert {r.doc_id: (r.texts, r.different, r.repeats) for r in U.repeated_texts(b).collect()}[1] == (4, 3, 1)
    assert {r.doc_id: (r.styled, r.headings, r.bold_titles) for r in U.heading_counts(b).collect()}[1] == (0, 1, 1)
    assert U.list_dump(blocks(spark, [block(0, "a"), block(1, "b", metadata={"list_level": "2"})])).first().dump == "a\n        b"
    (tmp_path / "router.txt").write_text("find headings")
    assert load_prompt(str(tmp_path), "router") == "find headings"
    with pytest.raises(FileNotFoundError):
        load_prompt(str(tmp_path), "none")
