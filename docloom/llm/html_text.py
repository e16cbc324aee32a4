"""HTML extraction by equivalence classes of tokens.

A page is read as tokens: tags by their path, and blocks of text by path and content.  A
token's occurrence vector holds its number in each page of the host.  Vectors are never
gathered: a commutative sum of hashes over the pages stands for each, built by partial sums,
so tokens of one host with equal sums, page counts and totals form an equivalence class.

Classes nest as the elements do: wherever a token occurs its parent tag does, so the class of a
tag that occurs in enough pages lies in the class of its parent, up to the root's (once in every
page).  The template of a host are its tags, and of its texts

* those of the root's class: said once on every page;
* those of a nested class that repeats within pages and is that of their own element: said each
  time the element occurs, as the label of a button below each item of a list.

All other texts fill slots of the template and differ from page to page.  A host needs ``PAGES``
pages, not all alike, for its template to count; a text counts in ``PAGES`` of them or more.

The main text are the slots that rank best on a page: first those in an ``article``, then those in a
``main``, then all others.  Elements, roles and words of class and id rank those of navigation, headers,
footers, sidebars, forms, notices, adverts, reader comments and code last, and these are never taken;
paragraphs, headings, items and cells of an article are ranked so by the words for adverts alone.
An article whose class names a comment is one; one that is named a teaser or card is no article.

Defined results: null pages count as empty; pages without text give an empty string; a null
URL is of the host ``""``; unclosed and crossed tags are closed as browsers do; text of any length
and elements of any depth are read whole; white space is any Unicode white space; repeated rows stay;
an empty table gives an empty result; the added column replaces one of its name, and others may have
any name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, cut, fresh, map_arrow
from .urls import url_host

PAGES = 3


# Elements of HTML, and what names parts that are no article.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"})
BLOCKS = frozenset({"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"})
CELLS = frozenset({"table", "td", "th", "caption"})
LEFT_OUT = frozenset({"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "template", "svg", "canvas", "object", "audio", "video", "datalist"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"})
WORDS = frozenset({"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "sponsor", "sponsored", "promo", "promotion", "sidebar", "sidebars", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "respond", "discussion", "disqus", "replies", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "skip"})
ADVERTS = frozenset({"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion"})
COMMENTS = frozenset({"comment", "comments", "reply", "replies", "respond", "discussion", "disqus"})
TEASERS = frozenset({"teaser", "teasers", "card", "cards", "related", "recommended", "recommendations"})
TEXT_LEVEL = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption"})
HEADERS = frozenset({"header", "topbar"})
NOT_PARTS = frozenset({"has", "with", "no", "without", "is", "not"})
#: Opening the one closes an open one of the others.
CLOSES = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tbody": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), "option": frozenset({"option"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"})}
LIMITS = {"li": frozenset({"ul", "ol", "menu", "table"}), "dt": frozenset({"dl", "table"}), "dd": frozenset({"dl", "table"}), "option": frozenset({"select", "datalist"})}

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _is_part(names: str, words: frozenset[str]) -> bool:
    """Whether a class or id names a part of the page by its first or last word."""
    for name in names.split():
        parts = [p.lower() for p in PART.findall(name)]
        if parts and not NOT_PARTS.intersection(parts) and (parts[0] in words or parts[-1] in words):
            return True
    return False


class Page:
    """The blocks of text and the tags of a page, in order.

    ``blocks``: (path, text, in an article, in a main); ``tags``: paths, one for each tag.  Paths are
    hashes of the names and classes from the root on."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.tags: list[int] = []
        self.parents: dict[int, int] = {}
        self.has_article = self.has_main = False
        self._names: Counter[str] = Counter()  # of open elements
        # name, path, left out, in an article, in a main
        self._stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self._text: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TAG.search(source, at)
            if found is None:
                self._say(source[at:])
                break
            if found.start() > at:
                self._say(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            attributes = found[3] or found[6] or ""
            self._open(name, attributes)
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.start() if end else size
        self._flush()

    def _say(self, text: str) -> None:
        if not self._stack[-1][2]:
            self._text.append(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                _, path, _, article, main = self._stack[-1]
                self.blocks.append((path, text, article, main))

    def _open(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self._flush()
            self._close_implied(name)
        elif name == "br":
            self._say(" ")
        _, parent, out, article, main = self._stack[-1]
        named = {}
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                named.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        path = xxhash.xxh64_intdigest(f"{parent} {name} {named.get('class', '')}") >> 1
        self.tags.append(path)
        self.parents[path] = parent
        if name in VOID:
            return
        names = f"{named.get('class', '')} {named.get('id', '')}"
        if name == "article" and not out:
            out, teaser = _is_part(names, COMMENTS), _is_part(names, TEASERS)
            if not out and not teaser:
                self.has_article = article = True
        elif not out and name not in ("html", "body", "main"):
            words = ADVERTS if article and name in TEXT_LEVEL else WORDS
            out = name in LEFT_OUT or name in RAW or "hidden" in named or named.get("role", "").lower() in ROLES or _is_part(names, words)
            if not article and not main:
                out = out or name == "header" or _is_part(names, HEADERS)
        if name == "main" and not out:
            self.has_main = main = True
        self._stack.append((name, path, out, article, main))
        self._names[name] += 1

    def _leave(self, k: int) -> None:
        """Close the k-th open element and those in it."""
        for name, *_ in self._stack[k:]:
            self._names[name] -= 1
        del self._stack[k:]

    def _close_implied(self, name: str) -> None:
        if self._names["p"]:
            for k in range(len(self._stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if self._stack[k][0] == "p":
                    self._leave(k)
                    break
                if self._stack[k][0] in BLOCKS:
                    break
        if name not in CLOSES or not any(self._names[n] for n in CLOSES[name]):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in LIMITS.get(name, CELLS - CLOSES[name]):
                break
            if self._stack[k][0] in CLOSES[name]:
                self._leave(k)
                if name not in ("tr", "tbody", "tfoot"):
                    break
                return self._close_implied(name)

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if not self._names[name]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == name:
                return self._leave(k)
            if self._stack[k][0] in CELLS and name not in CELLS and name not in ("tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def main_text(self, template: frozenset[int] = frozenset()) -> str:
        """The texts of the slots that rank best."""
        slots = [(2 if article else 1 if main else 0, text) for path, text, article, main in self.blocks if block_token(path, text) not in template]
        best = 2 if self.has_article else 1 if self.has_main else 0
        return "\n".join(text for rank, text in slots if rank >= best)


def block_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path} {text}") >> 1


TOKENS = "host string, token long, parent long, is_text boolean, pages long, total long, vector long"


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, html -> for each host and token the sums that stand for its occurrence vector.

    The token 0 is the page itself; its vector tells how many pages there are and, with
    ``least`` and ``most`` of the pages' hashes, whether they differ."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                host, source = host.as_py(), source.as_py() or ""
                page, counts = Page(source), {(0, 0, False): 1}
                for path in page.tags:
                    key = path, page.parents[path], False
                    counts[key] = counts.get(key, 0) + 1
                for path, text, _, _ in page.blocks:
                    key = block_token(path, text), path, True
                    counts[key] = counts.get(key, 0) + 1
                digest = xxhash.xxh64_intdigest(source)
                for (token, parent, is_text), n in counts.items():
                    s = sums.setdefault((host, token), [parent, is_text, 0, 0, 0, 1 << 62, 0])
                    s[2] += 1
                    s[3] += n
                    s[4] = (s[4] + xxhash.xxh64_intdigest(f"{digest} {n}")) & 0x3FFFFFFFFFF
                    s[5], s[6] = min(s[5], digest >> 2), max(s[6], digest >> 2)
            rows = [(h, t, *v) for (h, t), v in sums.items()]
            names = ["host", "token", "parent", "is_text", "pages", "total", "vector", "least", "most"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    parts = map_arrow(pages.select("host", "html"), work, TOKENS + ", least long, most long")
    sums = F.pmod(F.sum("vector"), F.lit(1 << 42)).alias("vector")
    return parts.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.max("is_text").alias("is_text"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), sums, F.min("least").alias("least"), F.max("most").alias("most"))


def templates(vectors: DataFrame, pages: int = PAGES) -> DataFrame:
    """host and ``template``, the text tokens of its template, for hosts with enough pages.

    ``vectors`` may lack tokens of fewer pages, but not the roots."""

    def side(rows: DataFrame, mark: str) -> DataFrame:
        of = [F.col(c).alias(f"{mark}_{c}") for c in ("pages", "total", "vector")]
        return rows.select(F.col("host").alias(f"{mark}_host"), F.col("token").alias(f"{mark}_token"), *of)

    def same(mark: str) -> Column:
        return (F.col("pages") == F.col(f"{mark}_pages")) & (F.col("total") == F.col(f"{mark}_total")) & (F.col("vector") == F.col(f"{mark}_vector"))

    root = side(vectors.where("token = 0 and least <> most").where(F.col("pages") >= pages), "root")
    tags = side(vectors.where("not is_text"), "tag")
    texts = vectors.where("is_text").where(F.col("pages") >= pages).join(root, F.col("host") == F.col("root_host"))
    nested = texts.join(tags, (F.col("host") == F.col("tag_host")) & (F.col("parent") == F.col("tag_token")))
    return nested.where(same("root") | (same("tag") & (F.col("total") > F.col("pages")))).groupBy("host").agg(F.collect_list("token").alias("template"))


def extract_text(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the source, with the main text.

    The templates of hosts are as large as what their pages share, so a page at most."""
    kept = [f for f in pages.schema.fields if f.name not in (source, text)]
    host, of, template, raw = fresh(pages.columns, "_host", "_of", "_template", "_source")
    hosted = pages.withColumn(host, F.coalesce(url_host(pages[url]), F.lit("")))
    vectors = token_vectors(hosted.select(F.col(host).alias("host"), F.col(source).alias("html")))
    found = cut(templates(cut(vectors.where(f"token = 0 or pages >= {PAGES}"))).select(F.col("host").alias(of), F.col("template").alias(template)))
    joined = attach(hosted, found, F.col(host) == F.col(of))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(list(range(len(kept))))
            out = []
            for s, t in zip(batch.column(raw), batch.column(template), strict=True):
                out.append(Page(s.as_py() or "").main_text(frozenset(t.as_py() or ())))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], names=[*rest.schema.names, text])

    columns = [*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias(raw), F.col(template)]
    return map_arrow(joined.select(*columns), work, T.StructType([*kept, T.StructField(text, T.StringType())]))
