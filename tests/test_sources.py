"""Files into blocks: text in many charsets, Word files built in memory, JSON; and streams."""

import base64
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import runs as R
from docloom.sources import docx as D
from docloom.sources.json_blocks import read_requests, read_truth, refused_blocks, request_blocks
from docloom.sources.text import read_text, text_blocks

W = f'xmlns:w="{D.W}" xmlns:m="{D.M}" xmlns:a="{D.A}" xmlns:r="{D.R}" xmlns:wp="{D.WP}" xmlns:v="{D.V}"'
STYLES = f"""<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style>
<w:style w:styleId="H1b"><w:name w:val="Mine"/><w:basedOn w:val="H1"/></w:style></w:styles>"""
PNG = base64.b64decode("iVBORw0KGgo=")


def docx(body, strict=False, rels="", styles=STYLES):
    xml = f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>"
    if strict:
        xml = xml.replace(D.W, "http://purl.oclc.org/ooxml/wordprocessingml/main")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/styles.xml", styles)
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{D.PKG}">{rels}</Relationships>')
        z.writestr("word/media/p.png", PNG)
    return out.getvalue()


def p(*runs, style=None, props=""):
    style = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{style}{props}</w:pPr>{''.join(runs)}</w:p>"


def r(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def read(body, **kw):
    return D.Reader(docx(body, **kw)).read()


def test_headings_fonts_and_alignment():
    got = read(p(r("Title"), style="H1") + p(r("Same"), style="H1b") + p(r("x", '<w:sz w:val="21"/>'), props='<w:jc w:val="both"/>'), strict=True)
    assert [(b["text"], b["is_heading_style"], b["heading_level"], b["is_bold"], b["font_size"], b["alignment"]) for b in got] == [("Title", True, 1, True, 16.0, None), ("Same", False, None, True, 16.0, None), ("x", False, None, False, 10.5, "justify")]


def test_runs_are_merged_and_marked():
    body = p(r("a ", "<w:b/>"), r(" "), r("b", "<w:b/>"), r(" c"), r(" d ", "<w:i/>"), r("2", '<w:vertAlign w:val="superscript"/>'), r("plain text"))
    assert read(body)[0]["text"] == "**a  b** c *d* <sup>2</sup>plain text"


def test_code_paragraphs_become_one_block():
    mono = '<w:rFonts w:ascii="Consolas"/>'
    got = read(p(r("x = 1", mono)) + p(r("y = 2", mono)) + p(r("then "), r("inline", mono), r(" words that are no code")))
    assert [(b["type"], b["text"]) for b in got] == [("code", "x = 1\ny = 2"), ("text", "then `inline` words that are no code")]


def test_mathematics():
    frac = "<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>"
    got = read(p(r("see "), frac, r(" here")) + p(f"<m:oMathPara>{frac}</m:oMathPara>"))
    assert [(b["type"], b["text"]) for b in got] == [("text", r"see $\frac{a}{b}$ here"), ("formula", r"\frac{a}{b}")]


def test_tables_with_merged_cells():
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{r(t)}</w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell('A', '<w:gridSpan w:val=\"2\"/>')}{cell('B')}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('x', '<w:vMerge/>')}</w:tr></w:tbl>"
    got = read(body)[0]
    assert got["table_data"] == {"rows": [["A", "", "B"], ["1", "2", ""]]} and got["text"].splitlines()[0] == "| A |  | B |"


def test_pictures_text_boxes_rules_and_unknown_parts():
    drawing = '<w:r><w:drawing><wp:inline><wp:docPr name="n" descr="d"/><a:blip r:embed="i1"/></wp:inline></w:drawing></w:r>'
    box = f"<w:r><w:pict><v:shape><w:txbxContent>{p(r('in'))}{p(r('box'))}</w:txbxContent></v:shape></w:pict></w:r>"
    rule = p(props="<w:pBdr><w:bottom/></w:pBdr>")
    got = read(p(drawing) + p(box) + rule + "<w:odd><w:t>z</w:t></w:odd><w:bookmarkStart/>", rels='<Relationship Id="i1" Target="media/p.png"/>')
    data = f"data:image/png;base64,{base64.b64encode(PNG).decode()}"
    assert any(data in str(b) for b in got)
    assert [b["text"] for b in got if b["metadata"].get("source")] == ["in\nbox", "---", "[RAW_XML_NODE: odd] z"]
    assert [b["block_id"] for b in got] == list(range(len(got)))


def test_word_files_as_a_table(spark):
    files = spark.createDataFrame([(1, bytearray(docx(p(r("one"))))), (2, bytearray(b"junk")), (3, bytearray())], "doc_id long, content binary")
    got = {(x.doc_id, x.text, x.error is None) for x in D.docx_blocks(files).collect()}
    assert {g[0] for g in got if not g[2]} == {2, 3} and (1, "one", True) in got


@pytest.mark.parametrize("charset", ["utf-8", "utf-8-sig", "utf-16", "gb18030"])
def test_text_files(spark, tmp_path, charset):
    (tmp_path / "a.txt").write_bytes("第一段文字内容\r\n接着写下去。\r\n\r\n- 项目\r\n- 另一个".encode(charset))
    (tmp_path / "b.md").write_text("no")
    got = [x.text for x in read_text(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == ["第一段文字内容 接着写下去。", "- 项目", "- 另一个"]


def test_text_edge_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "  \n \n"), (4, "a\n \t\nb")], "doc_id long, text string")
    assert sorted((x.doc_id, x.pos, x.text) for x in text_blocks(rows).collect()) == [(4, 0, "a"), (4, 1, "b")]


def test_requests_and_truth(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"title": "T", "blocks": [{"id": 7, "type": "text", "text": "x", "font_size": 14}, {"id": 9, "type": "odd"}]}))
    got = request_blocks(read_requests(spark, str(tmp_path / "r.json"))).collect()
    assert [(b.pos, b.block_id, b.text, b.font_size, b.is_bold) for b in got] == [(0, 7, "x", 14.0, False)]
    refused = refused_blocks(read_requests(spark, str(tmp_path / "r.json"))).collect()
    assert [(b.pos, b.error) for b in refused] == [(1, "unknown type: odd")]
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "doc.json").write_text(json.dumps({"doc_title": "T", "headings": [{"block_id": 0, "title": "A", "level": 1}]}))
    assert [(x.stem, x.block_id, x.title) for x in read_truth(spark, str(tmp_path / "gt")).collect()] == [("doc", 0, "A")]


def test_run_columns(spark):
    run = lambda t, **on: (t, *[on.get(s, False) for s in R.STYLES])
    rows = spark.createDataFrame([([run("a", bold=True), run(" "), run("b", bold=True), run("", italic=True), run("c`", code=True), run("u", underline=True)],)], f"runs array<{R.RUN}>")
    out = rows.select(R.normalise_runs(F.col("runs"), F.lit(False)).alias("runs")).select(R.merge_runs("runs").alias("runs"))
    assert out.select(R.render_runs(F.col("runs")).alias("m")).first().m == "**a b**`c\\``<u>u</u>"


def test_limiter_and_documents_as_streams(spark, tmp_path):
    from docloom.config import LimiterConfig
    from docloom.streaming.documents import structure_stream
    from docloom.streaming.limiter import limit_stream

    pd.DataFrame({"key": ["k"] * 4, "ts": pd.to_datetime([1000, 1001, 1002, 1030], unit="s")}).to_parquet(tmp_path / "e.parquet", coerce_timestamps="us")
    events = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "e*.parquet"))
    q = limit_stream(events, LimiterConfig(2, 10)).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(((x.allowed, x.remaining, x.retry_after) for x in spark.table("limited").collect())) == [(False, 0, 9), (True, 0, 0), (True, 1, 0), (True, 1, 0)]
    pd.DataFrame({"doc_id": [1], "text": ["1. Start\n\nbody of the text\n\n2. End"]}).to_parquet(tmp_path / "d.parquet")
    seen = []
    texts = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "d*.parquet"))
    q = structure_stream(texts, lambda s, n: seen.extend(r.title for r in s.sections.orderBy("ord").collect()), str(tmp_path / "c2"), once=True)
    assert q.awaitTermination(60)
    assert seen == ["1. Start", "2. End"]


def test_a_folder_of_several_kinds(spark, tmp_path):
    from docloom.sources.folder import file_titles, list_documents, read_documents, truth_of

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a b.docx").write_bytes(docx("<w:p><w:r><w:t>word</w:t></w:r></w:p>"))
    (tmp_path / "in" / "c.TXT").write_text("text")
    (tmp_path / "in" / "d.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "e.pdf").write_bytes(b"%PDF")
    files = list_documents(spark, str(tmp_path / "in"))
    stems = {r.doc_id: r.stem for r in files.select("doc_id", "stem").collect()}
    assert sorted(stems.values()) == ["a b", "c", "d", "e"]
    got = {stems[r.doc_id]: (r.text, (r.error or "")[:13]) for r in read_documents(files).collect()}
    assert got == {"a b": ("word", ""), "c": ("text", ""), "d": (None, "not a Word fi"), "e": (None, "no reader for")}
    assert {r.doc_title for r in file_titles(files, F.when(F.col("stem") == "c", F.lit("Given"))).collect()} == {"a b", "Given", "d", "e"}
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "c.json").write_text(json.dumps({"headings": [{"block_id": 0, "title": "A", "level": 1}]}))
    assert [(stems[r.doc_id], r.title) for r in truth_of(files, read_truth(spark, str(tmp_path / "gt"))).collect()] == [("c", "A")]


def test_code_by_the_font_of_the_style():
    with_font = STYLES.replace("</w:styles>", '<w:style w:styleId="Code"><w:name w:val="Code"/><w:rPr><w:rFonts w:ascii="Consolas"/></w:rPr></w:style><w:style w:styleId="Sub"><w:name w:val="Sub"/><w:basedOn w:val="Code"/></w:style></w:styles>')
    body = '<w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr><w:r><w:t>x = 1</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Arial"/></w:rPr><w:t>plain</w:t></w:r></w:p>'
    got = read(body, styles=with_font)
    assert [(b["type"], b["text"]) for b in got] == [("code", "x = 1"), ("text", "plain")]
