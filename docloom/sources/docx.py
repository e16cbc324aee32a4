"""Word files as blocks, with the standard library's zip and XML readers.

Each file is read on its own in a batch of ``mapInPandas``; a file that cannot be read gives a row
in ``error`` and not a failed job.  What a paragraph gives, in this order: its text (or a
rule), display formulas, pictures, text boxes.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BLOCK_FIELDS
from .text import with_document_ids

# Namespaces, and what the strict form of the format calls them.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
V = "urn:schemas-microsoft-com:vml"
O = "urn:schemas-microsoft-com:office:office"  # noqa: E741
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
STRICT = {
    b"http://purl.oclc.org/ooxml/wordprocessingml/main": W.encode(),
    b"http://purl.oclc.org/ooxml/officeDocument/math": M.encode(),
    b"http://purl.oclc.org/ooxml/drawingml/main": A.encode(),
    b"http://purl.oclc.org/ooxml/officeDocument/relationships": R.encode(),
    b"http://purl.oclc.org/ooxml/drawingml/wordprocessingDrawing": WP.encode(),
    b"http://purl.oclc.org/ooxml/drawingml/picture": PIC.encode(),
}
#: Fonts of code, elements of the body without content, alignments.
MONO = frozenset({"courier", "courier new", "consolas", "monaco", "lucida console", "dejavu sans mono", "menlo", "source code pro", "fira code", "jetbrains mono", "等线"})
EMPTY = frozenset({"bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd", "commentRangeStart", "commentRangeEnd", "customXml", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "lastRenderedPageBreak", "sectPr"})
ALIGN = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "justify": "justify"}
PICTURES = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "svg": "svg+xml", "tif": "tiff", "tiff": "tiff", "emf": "x-emf", "wmf": "x-wmf"}


def _w(name: str) -> str:
    return f"{{{W}}}{name}"


def _value(parent: ET.Element | None, name: str) -> str | None:
    child = parent.find(_w(name)) if parent is not None else None
    return None if child is None else child.get(_w("val"), "")


def _flag(parent: ET.Element | None, name: str) -> bool | None:
    """On, off, or not said."""
    value = _value(parent, name)
    return None if value is None else value.lower() not in ("0", "false", "off", "none")


def _font(props: ET.Element | None) -> str:
    """The first font that is named."""
    fonts = props.find(_w("rFonts")) if props is not None else None
    return "" if fonts is None else next((n for n in (fonts.get(_w(k), "") for k in ("ascii", "hAnsi", "eastAsia", "cs")) if n), "")


@dataclass
class Style:
    name: str = ""
    bold: bool | None = None
    size: float | None = None
    font: str = ""


@dataclass
class Run:
    text: str
    bold: bool | None = None
    italic: bool = False
    underline: bool = False
    strike: bool = False
    sup: bool = False
    sub: bool = False
    code: bool = False
    size: float | None = None
    font: str = ""  # its own, if it names one
    plain: bool = False  # formulas and pictures inside the text: no marks

    @property
    def style(self) -> tuple:
        return bool(self.bold), self.italic, self.underline, self.strike, self.sup, self.sub, self.code


@dataclass
class Package:
    """The parts of a file that blocks are made from."""

    body: ET.Element
    styles: dict[str, Style]
    targets: dict[str, str]
    files: zipfile.ZipFile
    pictures: dict[str, str] = field(default_factory=dict)

    @classmethod
    def open(cls, content: bytes) -> Package:
        if not content:
            raise ValueError("empty file")
        try:
            files = zipfile.ZipFile(io.BytesIO(content))
            document = _strict(files.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError) as e:
            raise ValueError(f"not a Word file: {e}") from e
        body = ET.fromstring(document).find(_w("body"))
        if body is None:
            raise ValueError("no body")
        names = set(files.namelist())
        styles = cls._styles(_strict(files.read("word/styles.xml"))) if "word/styles.xml" in names else {}
        rels = "word/_rels/document.xml.rels"
        targets = {x.get("Id", ""): x.get("Target", "") for x in ET.fromstring(_strict(files.read(rels)))} if rels in names else {}
        return cls(body, styles, targets, files)

    @staticmethod
    def _styles(xml: bytes) -> dict[str, Style]:
        based, out = {}, {}
        for s in ET.fromstring(xml).iter(_w("style")):
            props = s.find(_w("rPr"))
            size = _value(props, "sz")
            key = s.get(_w("styleId"), "")
            out[key] = Style(_value(s, "name") or "", _flag(props, "b"), float(size) / 2 if size else None, _font(props))
            based[key] = _value(s, "basedOn")
        for key, style in out.items():  # what a style does not say its base says
            seen, up = {key}, based[key]
            while up in out and up not in seen:
                seen.add(up)
                style.bold = out[up].bold if style.bold is None else style.bold
                style.size = out[up].size if style.size is None else style.size
                style.font = style.font or out[up].font
                up = based[up]
        return out

    def picture(self, rid: str | None) -> str | None:
        """A data URI, or a placeholder for what the file does not hold."""
        target = self.targets.get(rid or "", "")
        if not target:
            return None
        if target not in self.pictures:
            name = target.lstrip("/") if target.startswith("/") else f"word/{target}"
            kind = PICTURES.get(target.rpartition(".")[2].lower(), "octet-stream")
            try:
                self.pictures[target] = f"data:image/{kind};base64,{base64.b64encode(self.files.read(name)).decode()}"
            except KeyError:
                self.pictures[target] = f"[image:{rid}]"
        return self.pictures[target]


def _strict(xml: bytes) -> bytes:
    """The strict form's namespaces rewritten to the common ones."""
    for old, new in STRICT.items():
        xml = xml.replace(old, new)
    return xml


def _math(element: ET.Element) -> str:
    """Fractions in LaTeX, everything else as its text in a row."""
    name = element.tag.rpartition("}")[2]
    if name == "f":
        parts = {c.tag.rpartition("}")[2]: _math(c) for c in element}
        return rf"\frac{{{parts.get('num', '')}}}{{{parts.get('den', '')}}}"
    if name == "t":
        return element.text or ""
    return "".join(_math(c) for c in element)


class Reader:
    """Blocks of one file, in order."""

    def __init__(self, content: bytes):
        self.package = Package.open(content)
        self.blocks: list[dict] = []

    def read(self) -> list[dict]:
        for element in self.package.body:
            before = len(self.blocks)
            try:
                self._element(element)
            except Exception:  # noqa: BLE001  one odd element does not cost the file
                del self.blocks[before:]
        merged: list[dict] = []
        for b in self.blocks:
            if merged and b["type"] == "code" == merged[-1]["type"]:
                merged[-1]["text"] = f"{merged[-1]['text']}\n{b['text']}"
            else:
                merged.append(b)
        return [b | {"pos": i, "block_id": i} for i, b in enumerate(merged)]

    def _add(self, kind: str, text: str | None, **more) -> None:
        self.blocks.append({"type": kind, "text": text, "is_bold": False, "is_heading_style": False, "metadata": {}, **more})

    def _element(self, element: ET.Element) -> None:
        space, _, name = element.tag.rpartition("}")
        if element.tag == _w("p"):
            self._paragraph(element)
        elif element.tag == _w("tbl"):
            self._table(element)
        elif space == f"{{{M}" and name in ("oMath", "oMathPara"):
            if text := _math(element).strip():
                self._add("formula", text)
        elif name not in EMPTY:
            inner = "".join(t.text or "" for t in element.iter(_w("t"))).strip()
            self._add("text", f"[RAW_XML_NODE: {name}] {inner}".rstrip(), metadata={"source": "raw_xml", "tag": name})

    def _paragraph(self, p: ET.Element) -> None:
        props = p.find(_w("pPr"))
        style = self.package.styles.get(_value(props, "pStyle") or "", Style())
        runs, pictures = self._runs(p, style)
        shown = [r for r in runs if r.text.strip() and not r.plain]
        share = lambda good: bool(shown) and sum(map(good, shown)) >= 0.8 * len(shown)
        bold = share(lambda r: bool(style.bold if r.bold is None else r.bold))
        code = share(lambda r: r.code or (not r.font and style.font.lower() in MONO))
        sizes = [r.size for r in shown if r.size]
        heading = re.fullmatch(r"heading\s+(\d+)", style.name, re.IGNORECASE)
        level = props.find(f"{_w('numPr')}/{_w('ilvl')}") if props is not None else None
        metadata = {"style": style.name} if style.name else {}
        if level is not None:
            metadata["list_level"] = level.get(_w("val"), "0")
        text = "".join(r.text for r in runs).strip() if code else _render(runs, bold).strip()
        if text:
            features = {"is_bold": bold, "font_size": max(sizes, default=style.size), "alignment": ALIGN.get(_value(props, "jc") or ""), "is_heading_style": heading is not None, "heading_level": int(heading[1]) if heading else None, "metadata": metadata}
            self._add("code" if code and not heading else "text", text, **features)
        elif props is not None and props.find(f"{_w('pBdr')}/{_w('bottom')}") is not None:
            self._add("text", "---", metadata={"source": "horizontal_rule"})
        for display in p.iter(f"{{{M}}}oMathPara"):
            if formula := _math(display).strip():
                self._add("formula", formula)
        if not text or not pictures:
            for data, caption in self._pictures(p):
                self._add("image", None, image_data=data, caption=caption)
        for box in p.iter(_w("txbxContent")):
            lines = ["".join(t.text or "" for t in q.iter(_w("t"))).strip() for q in box.iter(_w("p"))]
            if joined := "\n".join(x for x in lines if x):
                self._add("text", joined, metadata={"source": "textbox"})

    def _runs(self, p: ET.Element, style: Style) -> tuple[list[Run], bool]:
        """The text of a paragraph in order, formulas and pictures in their places."""
        out: list[Run] = []
        pictures = False
        stack = list(reversed(p))
        while stack:
            e = stack.pop()
            if e.tag == f"{{{M}}}oMath":
                out.append(Run(f"${_math(e).strip()}$", plain=True))
            elif e.tag == f"{{{M}}}oMathPara":
                if any(x.tag == _w("r") for x in p):
                    out.append(Run(f"\n$${_math(e).strip()}$$\n", plain=True))
            elif e.tag == _w("r"):
                pictures = self._run(e, out) or pictures
            elif e.tag in (_w("hyperlink"), _w("ins"), _w("smartTag"), _w("sdt"), _w("sdtContent")):
                stack.extend(reversed(e))
        return out, pictures

    def _run(self, r: ET.Element, out: list[Run]) -> bool:
        props, pictures = r.find(_w("rPr")), False
        size, place = _value(props, "sz"), _value(props, "vertAlign")
        font = _font(props)
        styled = {"bold": _flag(props, "b"), "italic": _flag(props, "i") is True, "underline": _flag(props, "u") is True, "strike": _flag(props, "strike") is True, "sup": place == "superscript", "sub": place == "subscript", "code": font.lower() in MONO, "font": font, "size": float(size) / 2 if size else None}
        text = ""
        for child in r:
            name = child.tag.rpartition("}")[2]
            if name == "t":
                text += child.text or ""
            elif name in ("br", "cr"):
                text += "\n"
            elif name == "tab":
                text += "\t"
            elif name == "noBreakHyphen":
                text += "-"
            elif name in ("drawing", "pict") and (found := self._pictures(child)):
                if text:
                    out.append(Run(text, **styled))
                    text = ""
                out += [Run(f"![{caption or 'Image'}]({data})", plain=True) for data, caption in found]
                pictures = True
        if text:
            out.append(Run(text, **styled))
        return pictures

    def _pictures(self, element: ET.Element) -> list[tuple[str, str | None]]:
        """Drawings, a vector form before its fallback, then old pictures."""
        out = []
        for d in element.iter(_w("drawing")):
            named = d.find(f".//{{{WP}}}docPr")
            caption = (named.get("descr") or named.get("name") or None) if named is not None else None
            for blip in d.iter(f"{{{A}}}blip"):
                vector = next((x.get(f"{{{R}}}embed") for x in blip.iter() if x.tag.endswith("}svgBlip")), None)
                data = self.package.picture(vector) or self.package.picture(blip.get(f"{{{R}}}embed"))
                if data:
                    out.append((data, caption))
        for image in element.iter(f"{{{V}}}imagedata"):
            if data := self.package.picture(image.get(f"{{{R}}}id")):
                out.append((data, image.get(f"{{{O}}}title") or image.get("title")))
        return out

    def _table(self, table: ET.Element) -> None:
        rows: list[list[str]] = []
        for tr in table.findall(_w("tr")):
            row: list[str] = []
            for tc in tr.findall(_w("tc")):
                props = tc.find(_w("tcPr"))
                merged = props.find(_w("vMerge")) if props is not None else None
                below = merged is not None and merged.get(_w("val"), "continue") == "continue"
                text = "\n".join("".join(t.text or "" for t in p.iter(_w("t"))) for p in tc.findall(_w("p"))).strip()
                row.append("" if below else text)
                row += [""] * (int(_value(props, "gridSpan") or 1) - 1)
            rows.append(row)
        if rows:
            self._add("table", _table_text(rows), table_data={"rows": rows})


def _table_text(rows: list[list[str]]) -> str:
    wide = len(rows[0])
    line = lambda cells: "| " + " | ".join(c.replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * wide), *(line((r + [""] * wide)[:wide]) for r in rows[1:])])


def _render(runs: list[Run], all_bold: bool) -> str:
    """Runs of equal style together, each in its marks (see operators.runs for whole columns)."""
    merged: list[Run] = []
    for r in runs:
        r = Run(r.text, bool(r.bold) and not all_bold, r.italic, r.underline, r.strike, r.sup, r.sub, r.code, plain=r.plain)
        blank = not r.text.strip() and not any(r.style)
        if merged and not r.plain and not merged[-1].plain and (r.style == merged[-1].style or blank):
            merged[-1].text += r.text
        else:
            merged.append(r)
    return "".join(r.text if r.plain else _marked(r) for r in merged)


def _marked(r: Run) -> str:
    def wrap(text: str, before: str, after: str) -> str:
        core = text.strip()
        if not core:
            return text
        at = text.index(core)
        return text[:at] + before + core + after + text[at + len(core) :]

    text = wrap(r.text.replace("`", r"\`"), "`", "`") if r.code else r.text
    marks = [(r.strike, "~~", "~~"), (r.italic, "*", "*"), (r.bold, "**", "**"), (r.underline and not r.bold and not r.italic, "<u>", "</u>"), (r.sup, "<sup>", "</sup>"), (r.sub, "<sub>", "</sub>")]
    for on, before, after in marks:
        text = wrap(text, before, after) if on else text
    return text


OUTPUT = T.StructType([T.StructField("doc_id", T.LongType()), *BLOCK_FIELDS, T.StructField("error", T.StringType())])


def docx_blocks(files: DataFrame) -> DataFrame:
    """doc_id, content -> blocks, with ``error`` for files that cannot be read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in OUTPUT.fields]
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = Reader(bytes(content or b"")).read()
                except (ValueError, ET.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    rows = [{"error": str(e)}]
                yield pd.DataFrame([{**dict.fromkeys(names), **r, "doc_id": doc_id} for r in rows], columns=names).astype(object)

    return files.select("doc_id", "content").mapInPandas(work, OUTPUT)


def read_docx(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The blocks of all ``.docx`` files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where(F.lower("path").endswith(".docx"))
    return docx_blocks(with_document_ids(files))
