"""Rows in HTML pages: a tokenizer that reads a page once, and the sections and links that its open elements tell.

Tokens are text, start tags with their attributes (either quote, or none; '>' may stand within quotes) and end tags. Comments,
declarations and the contents of script and style are left out. Elements that are never closed end with the one around them, and end
tags of elements that are not open are left out. Names are compared in lower case; character references are left as they are. Pages
are read in Arrow batches by the tasks that have them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.places import sent_with_tasks

sent_with_tasks(__name__)

# Elements without contents, and elements whose contents are no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
#: Elements that do not hold one another, and that no end tag closes from within a section.
ALONE = frozenset(("a", "h2", "p"))

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")

#: kind ('text', 'start' or 'end'), text or name, attributes.
Token = tuple[str, str, dict[str, str]]


def _attributes(page: str, at: int, closed: dict[str, bool]) -> tuple[dict[str, str], int]:
    """The attributes of a tag from a place on, the first of each name; and the place behind the tag. closed: whether each quote
    still comes again, so that a page of quotes without an end is not searched again and again."""
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return found, at
        if page[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE.match(page, at)
        if name is None:  # an equals sign without a name
            at += 1
            continue
        at, value = name.end(), ""
        if (equals := _EQUALS.match(page, at)) is not None:
            at = equals.end()
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and closed[quote] else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in closed:
                    closed[quote] = False
                bare = _BARE.match(page, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), value)


def tokens(page: str) -> Iterator[Token]:
    at, closed = 0, {"'": True, '"': True}
    while at < len(page):
        mark = page.find("<", at)
        mark = len(page) if mark < 0 else mark
        if mark > at:
            yield "text", page[at:mark], {}
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
        elif (name := _NAME.match(page, mark + 1)) is not None:
            word = name.group().lower()
            attributes, at = _attributes(page, name.end(), closed)
            yield "start", word, attributes
            if word in RAW:
                end = re.compile(rf"</{word}\b", re.IGNORECASE).search(page, at)
                at = end.start() if end is not None else len(page)
        elif page.startswith("</", mark) and (name := _NAME.match(page, mark + 2)) is not None:
            _, at = _attributes(page, name.end(), closed)
            yield "end", name.group().lower(), {}
        else:
            if mark < len(page):
                yield "text", page[mark : mark + 1], {}
            at = mark + 1


class _Open:
    """The names of the open elements, counted as a whole and since the last section, so that no look at them takes long."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.every: Counter[str] = Counter()
        self.within: list[Counter[str]] = [Counter()]

    def push(self, word: str) -> None:
        self.stack.append(word)
        self.every[word] += 1
        self.within[-1][word] += 1
        if word == "section":
            self.within.append(Counter())

    def pop_to(self, word: str | None) -> Iterator[tuple[str, str, dict[str, str]]]:
        """Close elements up to one of a name, or all."""
        while self.stack:
            last = self.stack.pop()
            self.every[last] -= 1
            if last == "section":
                self.within.pop()
            self.within[-1][last] -= 1
            yield "end", last, {}
            if last == word:
                return


def elements(page: str) -> Iterator[Token]:
    """tokens() with an end for each element that has a start, in the right order."""
    open_ = _Open()
    for kind, word, attributes in tokens(page):
        if kind == "text":
            yield kind, word, attributes
        elif kind == "start":
            closes = "p" if word == "section" else word if word in ALONE else None
            if closes is not None and open_.within[-1][closes]:
                yield from open_.pop_to(closes)
            yield kind, word, attributes
            if word in VOID:
                yield "end", word, {}
            else:
                open_.push(word)
        elif (open_.within[-1] if word in ALONE else open_.every)[word]:
            yield from open_.pop_to(word)
    yield from open_.pop_to(None)


def sections_of(page: str) -> list[tuple[str, str, str, str]]:
    """id, title, image and description of the sections with an id: the first h2, img and p that no section with an id within holds."""
    found: list[dict] = []
    open_: list[dict | None] = []  # of each open section; None: without an id
    reading: list[tuple[dict, str]] = []
    for kind, word, attributes in elements(page):
        own = next((s for s in reversed(open_) if s is not None), None)
        if kind == "text":
            for section, part in reading[-1:]:
                section[part].append(word)
        elif word == "section":
            if kind == "start":
                held = {"id": attributes["id"], "h2": None, "img": None, "p": None} if "id" in attributes else None
                open_.append(held)
                found += [] if held is None else [held]
            else:
                open_.pop()
        elif word in ("h2", "p") and own is not None:
            if kind == "start" and own[word] is None:
                own[word] = []
                reading.append((own, word))
            elif kind == "end" and reading and reading[-1] == (own, word):
                reading.pop()
        elif word == "img" and kind == "start" and own is not None and own["img"] is None:
            own["img"] = attributes.get("src", "")
    text = lambda parts: " ".join(" ".join(parts or ()).split())
    return [(s["id"], text(s["h2"]), s["img"] or "", text(s["p"])) for s in found]


def links_of(page: str) -> list[tuple[str, str]]:
    """href and label of the links."""
    found: list[list] = []
    inside = False
    for kind, word, attributes in elements(page):
        if word == "a" and kind != "text":
            inside = kind == "start"
            if inside:
                found.append([attributes.get("href", ""), []])
        elif kind == "text" and inside:
            found[-1][1].append(word)
    return [(href, "".join(parts).strip()) for href, parts in found]


def _rows(pages: DataFrame, key: str, html: str, names: tuple[str, ...], read: Callable[[str], list[tuple[str, ...]]]) -> DataFrame:
    """key, pos and the named columns of what is read from each page; of pages without HTML nothing."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, row, strict=True)) for row in read(page)] for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["key", "found"])

    fields = ",".join(f"{n}:string" for n in names)
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), html)
    rows = rows.mapInArrow(mapped, f"key {dict(pages.dtypes)[key]}, found array<struct<{fields}>>")
    return rows.select(F.col("key").alias(key), F.posexplode("found").alias("pos", "row")).select(key, "pos", "row.*")


def sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, id, title, image and description of the sections with an id in HTML pages; '' for what a section has not."""
    return _rows(pages, key, html, ("id", "title", "image", "description"), sections_of)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href and label of the links in HTML pages."""
    return _rows(pages, key, html, ("href", "label"), links_of)
