"""Main text of web pages, by rules on blocks in two passes.

Markup is cut into blocks at block-level tags.  The first pass decides a block by its place
(menus, footers, forms and the like), its share of linked text, its length and its share of
stop words; short blocks and those between the marks stay open.  In the second pass an open
block inherits the label of its nearest decided neighbours.

Where a page marks its article (``article``, ``main``), only blocks inside are candidates,
and there the rules on stop words and links never reject by themselves: what stays open among
good blocks is kept, such as headings, last lines and linked paragraphs.  Without that mark, or if
nothing good is inside, all blocks compete.

A class or id that is the name of something apart (``sidebar``) sets its element apart, but not a
``main`` inside it.  One that has such a name in it (``cookie-notice``) does so outside of articles, if
nothing in it speaks of a state or a layout (``with-sidebar``, ``nav-open``); inside an article
it is evidence: only blocks that the first pass finds good are kept there.

Null and empty pages give an empty text.  Broken markup is read as far as it goes: an open
element ends with its page, an unfinished tag at the end is dropped, and so is all after
an unclosed comment or script.  Repeated rows get equal texts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from aerolith.llm.common import pack, unpack
from aerolith.llm.registry import query
from aerolith.workload.registry import table

#: Frequent function words of four languages.
STOP_WORDS = frozenset((
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this "
    "to was were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nach nicht sich sie sind "
    "und von war wie wird zu zum zur über "
    "au aux avec ce ces cette dans des du elle en est et il ils je la le les leur mais ne nous par pas plus pour qu que qui sa se "
    "son sont sur un une vous à "
    "al como con de del el ella este fue ha las lo los más no para pero por se ser si sin su sus también una y ya"
).split())

#: Text inside is no text of the page.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Never part of an article.
_APART = frozenset("head nav footer aside form button select menu dialog noscript template svg math object canvas video audio".split())
_SECTIONS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup "
    "html li main menu nav ol section summary table tbody td tfoot th thead tr ul"
).split())
_BLOCKS = _SECTIONS | frozenset("h1 h2 h3 h4 h5 h6 hr option p pre".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_APART_NAMES = frozenset((
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promotion related recommended respond share sharing sidebar signup social sponsor sponsored subscribe subscription widget"
).split())
#: Apart as well, unless they stand in an article.
_HEADER_NAMES = frozenset("header masthead topbar".split())

_TAG_END = re.compile(r"""(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>""")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


@dataclass(frozen=True)
class Marks:
    """Where the first pass decides."""

    link_density: float = 0.4
    short_chars: int = 70
    long_chars: int = 200
    low_stops: float = 0.1
    high_stops: float = 0.2


@dataclass(frozen=True)
class Place:
    """What the open elements say of the text inside."""

    by_tag: bool = False  # in an element, or a hidden one, that is no part of an article
    by_name: bool = False
    hinted: bool = False
    article: bool = False


@dataclass
class Block:
    place: Place = Place()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def apart(self) -> bool:
        return self.place.by_tag or self.place.by_name or self.place.hinted and not self.place.article

    @property
    def article(self) -> bool:
        return self.place.article


#: Parts of a name that speaks of a state or a layout and names nothing.
_STATES = frozenset("with without has have no not is open closed opened collapsed expanded enabled disabled layout page wrap wrapper row col grid".split())


def _named(attributes: str, article: bool) -> Place:
    """What an element's attributes say: hidden or a role, a name, a part of a name."""
    by_tag = by_name = hinted = False
    names = _APART_NAMES if article else _APART_NAMES | _HEADER_NAMES
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            by_tag = True
        elif name == "style":
            by_tag = by_tag or bool(re.search(r"display\s*:\s*none", value))
        elif name == "role":
            by_tag = by_tag or value in _ROLES
        elif name in ("class", "id"):
            for token in value.split():
                parts = [part for part in re.split(r"[_-]+", token) if part]
                if len(parts) == 1:
                    by_name = by_name or parts[0] in names
                elif parts and _STATES.isdisjoint(parts):
                    hinted = hinted or parts[-1] in names or len(parts) == 2 and parts[0] in names
    return Place(by_tag, by_name, hinted)


class Reader:
    """Reads a page once, from its start, into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.block = Block()
        self.open: list[tuple[str, Place]] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.link = False
        self.breaks = 0

    def place(self) -> Place:
        return self.open[-1][1] if self.open else Place()

    def end_block(self) -> None:
        text = " ".join("".join(self.block.parts).split())
        if text:
            self.block.text = text
            self.blocks.append(self.block)
        self.block = Block(self.place())
        self.breaks = 0

    def add(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            self.breaks = 0
            if self.link:
                self.block.linked += len(text)
        self.block.parts.append(text)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            self.block.parts.append(" ")
            if self.breaks > 1:
                self.end_block()
            return
        if name == "a":
            self.link = bool(re.search(r"\bhref\b", attributes, re.I))
        outer = self.place()
        if name == "body":
            self.open, self.names, outer = [], Counter(), Place()
        if name in ("html", "body"):
            place = outer
        else:
            own = _named(attributes, outer.article or name in ("article", "main"))
            by_tag = own.by_tag or name in _APART or name == "header" and not outer.article
            if name == "main":  # what holds the main text is not set apart by a name
                place = Place(outer.by_tag or by_tag, own.by_name, False, True)
            elif name == "article":
                place = Place(outer.by_tag or by_tag, outer.by_name or own.by_name or own.hinted, False, True)
            else:
                place = Place(outer.by_tag or by_tag, outer.by_name or own.by_name, outer.hinted or own.hinted, outer.article)
        if name not in _VOID and (name in _SECTIONS or place != outer):
            self.open.append((name, place))
            self.names[name] += 1
            self.end_block()
        elif name in _BLOCKS:
            self.end_block()

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        if self.names[name]:
            while True:
                closed, _ = self.open.pop()
                self.names[closed] -= 1
                if closed == name:
                    break
            self.end_block()
        elif name in _BLOCKS:
            self.end_block()

    def read(self, page: str) -> list[Block]:
        at = 0
        while at < len(page):
            tag = page.find("<", at)
            if tag < 0:
                self.add(page[at:])
                break
            self.add(page[at:tag])
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = len(page) if end < 0 else end + 3
                continue
            name = _TAG_NAME.match(page, tag + 1)
            if not name and page[tag + 1:tag + 2] not in ("!", "?", "/"):
                self.add("<" if tag + 1 < len(page) else "")
                at = tag + 1
                continue
            end = _TAG_END.match(page, tag + 1)
            at = end.end() if end else page.find(">", tag) + 1
            if not at:
                break
            if not name:
                continue
            lowered = name.group(1).lower()
            if name.group().startswith("/"):
                self.end(lowered)
            elif lowered in _RAW:
                close = re.compile(f"</{lowered}(?![a-zA-Z0-9])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            else:
                self.start(lowered, page[name.end():at - 1])
        self.end_block()
        return self.blocks


GOOD, BAD, OPEN = 1, -1, 0


def first_pass(block: Block, marks: Marks) -> int:
    if block.apart or not block.article and block.linked > marks.link_density * len(block.text):
        return BAD
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if len(block.text) >= marks.short_chars and block.linked <= marks.link_density * len(block.text) and stops >= (
            marks.high_stops if len(block.text) < marks.long_chars else marks.low_stops):
        return GOOD
    if block.article:
        return BAD if block.place.hinted else OPEN
    return OPEN if len(block.text) < marks.long_chars else BAD


def second_pass(labels: list[int], default: int) -> list[int]:
    """Open blocks take the label of the nearest decided one; between two equally near, good wins."""
    before, after = [], []
    for labelled, out in ((labels, before), (labels[::-1], after)):
        near, far = default, None
        for label in labelled:
            near, far = (label, 0) if label != OPEN else (near, None if far is None else far + 1)
            out.append((near, far))
    found = []
    for label, (left, near), (right, far) in zip(labels, before, after[::-1]):
        if label != OPEN:
            found.append(label)
        elif near is None or far is None:
            found.append(left if far is None and near is not None else right if far is not None else default)
        else:
            found.append(left if near < far else right if far < near else max(left, right))
    return found


def main_text(page: str | None, marks: Marks = Marks()) -> str:
    blocks = Reader().read(page or "")
    for zone, default in ([b for b in blocks if b.article], GOOD), (blocks, BAD):
        labels = [first_pass(block, marks) for block in zone]
        if default == GOOD:
            # Inside an article, what is rejected says nothing of the text beside it.
            zone = [block for block, label in zip(zone, labels) if label != BAD]
            labels = [label for label in labels if label != BAD]
        kept = [block.text for block, label in zip(zone, second_pass(labels, default)) if label == GOOD]
        if kept:
            return "\n\n".join(kept)
    return ""


@F.pandas_udf(StringType())
def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(page) for page in batch], dtype=object)


def extracted(page: Column) -> Column:
    return _main_texts(page)


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, which replace columns of those names."""
    done = pack(pages, found=extracted(F.col(page)))
    return unpack(done, text=F.col("found"), n_chars=F.length("found").cast("long"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
