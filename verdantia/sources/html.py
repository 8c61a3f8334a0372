"""Links and paragraphs of HTML pages, by the standard parser in an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

PAGES = 64  # pages that are Python objects at once
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self, within: str | None, mark: str | None):
        super().__init__(convert_charrefs=True)
        self.within, self.mark, self.depth = within, mark, 0
        self.links: list[dict] = []
        self.paragraphs: list[dict] = []
        self.link = self.paragraph = None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if self.depth and tag not in _VOID and tag == self.within:
            self.depth += 1
        elif not self.depth and tag == self.within and (self.mark is None or self.mark in (found.get("class") or "").split() + [found.get("id")]):
            self.depth = 1
        if tag == "a":
            self.link = {"href": found.get("href"), "title": found.get("title"), "text": ""}
            self.links.append(self.link)
        if tag == "table" and self.paragraph is not None:
            self.paragraph["table"] = True
        if tag == "p" and (self.within is None or self.depth):
            self.paragraph = {"text": "", "table": False}
            self.paragraphs.append(self.paragraph)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag == "p":
            self.paragraph = None
        if self.depth and tag == self.within:
            self.depth -= 1
            self.paragraph = None

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"] += data
        if self.paragraph is not None:
            self.paragraph["text"] += data


def _read(page: str | None, within: str | None = None, mark: str | None = None) -> _Reader:
    reader = _Reader(within, mark)
    reader.feed(page or "")
    reader.close()
    return reader


def _each(column: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """``of`` every page as one Arrow array; of the batch, only ``PAGES`` at a time are Python objects."""
    parts = [pa.array([of(x.as_py()) for x in column.slice(at, PAGES)], kind) for at in range(0, len(column), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def links(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, links array(struct(href, title, text)))"""
    kind = "array<struct<href:string,title:string,text:string>>"
    typed = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string()), ("text", pa.string())]))

    def run(columns):
        for c in columns:
            yield _each(c, lambda x: _read(x).links, typed)

    return _typed(pages, key, page, run, kind, "links")


def _typed(pages, key, page, run, kind, name):
    def typed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(columns)

    return pages.select(key, F.arrow_udf(typed, kind)(F.col(page)).alias(name))


def paragraphs_of(page: Column, within: str | None = None, mark: str | None = None, joiner: str = "\n", kept=None, holds: str = "[a-z]") -> Column:
    """The paragraphs that hold a pattern (a lower-case letter) and no table inside ``within`` (an element, with a class or id), and which ``kept`` (a function of their column) takes, joined; null without any."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield _each(c, lambda x: [p["text"].strip() for p in _read(x, within, mark).paragraphs if not p["table"]], pa.list_(pa.string()))

    def joined(found: Column) -> Column:
        good = F.filter(found, lambda x: x.rlike(holds) & (F.lit(True) if kept is None else kept(x)))
        return let(good, lambda p: F.when(F.size(p) > 0, F.array_join(p, joiner)))

    return let(F.arrow_udf(run, "array<string>")(page), joined)


def paragraphs(pages: DataFrame, key: str, page: str, within: str | None = None, mark: str | None = None, joiner: str = "\n") -> DataFrame:
    """(key, text) by ``paragraphs_of``."""
    return pages.select(key, paragraphs_of(F.col(page), within, mark, joiner).alias("text"))


def index_by_link(linked: DataFrame, href_like: str, parameter: str, title: str | None = None) -> DataFrame:
    """(name, id): of links whose address fits, the text and a query parameter; the last one wins."""
    rows = linked.select(F.posexplode("links").alias("pos", "l")).filter(F.col("l.href").rlike(href_like))
    if title is not None:
        rows = rows.filter(F.col("l.title") == title)
    absolute = F.when(F.col("l.href").contains("://"), F.col("l.href")).otherwise(F.concat(F.lit("http://x/"), F.col("l.href")))
    return rows.groupBy(F.trim("l.text").alias("name")).agg(F.max_by(F.parse_url(absolute, F.lit("QUERY"), F.lit(parameter)), "pos").alias("id"))
