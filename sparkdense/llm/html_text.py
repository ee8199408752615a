"""Main text of web pages by consensus host paths.

Every page's containers are scored, and the best one votes, with its score, for its generalised path of tags and
classes. Votes are summed for each host; all pages of the host are then extracted again from the containers at the
winning path. A page that has no such container, or no text in it, falls back to its own best container.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdense.llm.common import append_columns, spread, stored

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")

# Elements by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object select option xmp noframes".split())
_BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset details summary address hr menu dialog".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "summary", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_CHROME_TAGS = frozenset("nav header footer aside form menu dialog button head label input".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter subscribe signup login "
    "comment comments reply replies respond disqus share sharing social related recommended widget pagination pager toolbar".split()
)


class Page:
    """Elements of a page in order, as (tag, generalised path, parent, is chrome), and its text blocks in order."""

    def __init__(self, source: str):
        self.elements: list[tuple[str, str, int, bool]] = [("", "", -1, False)]
        self.blocks: list[tuple[int, str, int]] = []  # innermost block element, text, characters inside links
        self._stack = [0]
        self._parts: list[str] = []
        self._linked, self._in_link = 0, 0
        at = 0
        while at < len(source):
            tag = _TAG.search(source, at)
            self._text(source[at : tag.start() if tag else len(source)])
            if not tag:
                break
            at = tag.end()
            name = (tag.group(2) or "").lower()
            if not name:
                continue
            if tag.group(1):
                self._close(name)
            else:
                self._open(name, tag.group(3))
                if name in _RAW and not tag.group(0).endswith("/>"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(name)
        self._end_block()

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._linked += len(text.strip())

    def _end_block(self) -> None:
        if self._parts:
            text = _SPACES.sub(" ", entities.unescape("".join(self._parts))).strip()
            if text:
                owner = next(i for i in reversed(self._stack) if i == 0 or self.elements[i][0] in _BLOCK)
                self.blocks.append((owner, text, self._linked))
            self._parts = []
        self._linked = 0

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if name in _BLOCK:
            self._end_block()
        if name in _CLOSES_P:
            self._close_within("p", {"table", "td", "th", "button"})
        for sibling in _SIBLINGS.get(name, ()):
            self._close_within(sibling, _LIMITS[name] - {sibling})
        if name in _VOID:
            return
        words, chrome = [], name in _CHROME_TAGS
        for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            value, key = "".join(values), key.lower()
            if key == "class":
                words = sorted({_DIGITS.sub("", w) for w in value.split()} - {""})
            if key in ("class", "id"):
                chrome |= any(w.lower() in _CHROME_WORDS for w in _WORD_PARTS.findall(value))
            chrome |= key == "role" and value.lower() in _CHROME_ROLES
            chrome |= key == "hidden" or key == "aria-hidden" and value.lower() == "true"
        parent = self._stack[-1]
        above = self.elements[parent]
        path = f"{above[1]}>{'.'.join([name, *words])}"
        self._stack.append(len(self.elements))
        # the page's own frame is never chrome, whatever its classes say
        self.elements.append((name, path, parent, above[3] or (chrome and name not in ("html", "body"))))
        self._in_link += name == "a"

    def _close(self, name: str) -> None:
        if any(self.elements[i][0] == name for i in self._stack):
            if name in _BLOCK:
                self._end_block()
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name = self.elements[self._stack[-1]][0]
        if name in _BLOCK:
            self._end_block()
        self._stack.pop()
        self._in_link -= name == "a"
        return name

    def _close_within(self, name: str, limits: set[str]) -> None:
        for i in reversed(self._stack):
            tag = self.elements[i][0]
            if tag == name:
                self._close(name)
                return
            if tag in limits:
                return

    def best_path(self) -> tuple[str, float]:
        """The path of the container with the highest score: text that is no link, halved at each level upwards."""
        scores: dict[str, float] = {}
        for owner, text, linked in self.blocks:
            tag, _, parent, chrome = self.elements[owner]
            if chrome:
                continue
            weight = max(0.0, len(text) - 2 * linked) * (1.0 if tag in ("p", "pre", "blockquote", "li", "td") else 0.5)
            at = parent if tag not in ("article", "main", "section", "div", "body", "") else owner
            share = 1.0
            while at > 0:
                name, path, parent, _ = self.elements[at]
                favour = 1.5 if name in ("article", "main") else 1.0
                scores[path] = scores.get(path, 0.0) + weight * share * favour
                share, at = share / 2, parent
        if not scores:
            return "", 0.0
        return min(scores.items(), key=lambda x: (-x[1], x[0]))

    def text_at(self, path: str) -> str:
        """Blocks below the containers at ``path``, without chrome, joined in page order."""
        inside = [False] * len(self.elements)
        for i, (_, own, parent, _) in enumerate(self.elements):
            inside[i] = own == path or (i > 0 and inside[parent])
        return "\n".join(t for owner, t, _ in self.blocks if inside[owner] and not self.elements[owner][3])


def host_of(url_column: str = "url"):
    """The host in lower case; a null or odd url belongs to the host named by the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of the host's pages; ties go to the least path."""

    def make():
        def work(sources):
            votes = [Page(s or "").best_path() for s in sources]
            return [[p for p, _ in votes], [s for _, s in votes]]

        return work

    fields = [T.StructField("path", T.StringType()), T.StructField("vote", T.DoubleType())]
    voted = append_columns(pages.select(host_of().alias("host"), "html"), fields, ["html"], make).where("path <> ''")
    # votes are rounded so that their sum does not depend on the order of the rows
    sums = voted.groupBy("host", "path").agg(F.sum(F.round("vote").cast("long")).alias("votes"))
    best = sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("lost"), "path")).alias("best"))
    return stored(best.select("host", F.col("best.path").alias("path")), "host-paths")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for every row of ``pages``; text is empty if there is none, html null as empty.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines.
    Pages of a very large host are joined with its one path by a join whose large side can be split.
    """
    pages = spread(pages.select("page_id", "url", "html"))
    joined = pages.withColumn("host", host_of()).join(host_paths(pages), "host", "left")

    def make():
        def work(sources, paths):
            texts, used = [], []
            for source, path in zip(sources, paths, strict=True):
                page = Page(source or "")
                text = page.text_at(path) if path else ""
                if not text:
                    path = page.best_path()[0]
                    text = page.text_at(path) if path else ""
                texts.append(text)
                used.append(path or None)
            return [texts, used]

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("used_path", T.StringType())]
    found = append_columns(joined, fields, ["html", "path"], make)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("used_path").alias("path"))
