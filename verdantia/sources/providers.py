"""Descriptions from web floras, read from a stored table of pages.

``Pages`` is the cache: a table (url, status, body) that ``fetched`` extends by what is missing, with a function of the
caller's own; nothing here reaches the network by itself. A provider turns pages into (taxon, source, source_id, text).

Defined cases: taxa without a page, pages without a description, and pages of a refused status give no text (null); of
repeated pages of one url the last status 200 counts; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import html

#: Statuses of an answer that are no error: a page, or none for this query.
ALLOWED = (200, 400, 404)


class Provider(Protocol):
    name: str

    def describe(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        """(taxon, source, source_id, text) of every taxon."""


# ---------------------------------------------------------------- urls and pages
def with_query(url: str, **parameters) -> str:
    """The url with its parameters, in the order given."""
    return f"{url}?{urlencode(parameters)}" if parameters else url


def url_column(url: str, **parameters: Column) -> Column:
    """The same for columns."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in parameters.items()]
    return F.concat(F.lit(url + "?"), F.concat_ws("&", *pairs)) if pairs else F.lit(url)


def fetched(urls: DataFrame, pages: DataFrame, get: Callable[[str], tuple[int, str]]) -> DataFrame:
    """Pages of the distinct ``urls`` (url) that ``pages`` lacks, by ``get``: url -> (status, body). Another status than the allowed ones is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                status, body = get(url)
                if status not in ALLOWED:
                    raise OSError(f"{url}: status {status}")
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([status], pa.int32()), pa.array([body], pa.string())], names=["url", "status", "body"])

    missing = urls.select("url").filter("url is not null").distinct().join(pages.select("url"), "url", "left_anti")
    return missing.mapInArrow(run, "url string, status int, body string")


def _found(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``wanted`` (..., url) with ``body``: of a page that was found, else null."""
    good = pages.filter("status = 200").groupBy("url").agg(F.max("body").alias("body"))
    return wanted.join(good, "url", "left")


def _linked(pages: DataFrame, href: str) -> DataFrame:
    """(url, pos, name, href): the pages' links of fitting addresses, absolute."""
    rows = html.links(pages, "url", "body").select("url", F.posexplode("links").alias("pos", "l")).filter(F.col("l.href").rlike(href))
    address = F.when(F.col("l.href").contains("://"), F.col("l.href")).otherwise(F.concat(F.lit("http://x/"), F.col("l.href")))
    return rows.select("url", "pos", F.trim("l.text").alias("name"), F.col("l.title").alias("title"), address.alias("href"))


def _parameter(name: str) -> Column:
    return F.try_parse_url(F.col("href"), F.lit("QUERY"), F.lit(name))


# ---------------------------------------------------------------- ecological flora
@dataclass(frozen=True)
class EcologicalFlora:
    """An index page names all species with their plant numbers; a species' page has its description."""

    index_url: str
    page_url: str
    name: str = "ecoflora"

    def index(self, pages: DataFrame) -> DataFrame:
        """(taxon, plant_no): of several links of one name the last one."""
        links = _linked(pages.filter(F.col("url") == self.index_url), r"plant_no=")
        return links.groupBy(F.col("name").alias("taxon")).agg(F.max_by(_parameter("plant_no"), "pos").alias("plant_no"))

    def urls(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        """(taxon, source_id, url): a null url for taxa that the index lacks."""
        wanted = taxa.join(self.index(pages), "taxon", "left")
        return wanted.select("taxon", F.col("plant_no").cast("long").alias("source_id"), F.when(F.col("plant_no").isNotNull(), url_column(self.page_url, plant_no=F.col("plant_no"))).alias("url"))

    def describe(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        wanted = _found(self.urls(taxa, pages), pages)
        text = html.paragraphs_of(F.col("body"), "div", "description", " ")
        return wanted.select("taxon", F.lit(self.name).alias("source"), "source_id", text.alias("text"))


# ---------------------------------------------------------------- four floras of one site
#: The floras by their ids on the site.
FLORAS = {1: "flora_of_north_america", 2: "flora_of_china", 4: "moss_flora_of_china", 5: "flora_of_pakistan"}


@dataclass(frozen=True)
class SharedFloras:
    """One search over all floras of a site gives a taxon's id in each; a page a flora has its description."""

    search_url: str
    page_url: str
    vocabulary: tuple[str, ...] = ()
    floras: tuple[int, ...] = (1, 2, 4, 5)
    nothing: str = "No taxa found"
    name: str = "efloras"

    def search_urls(self, taxa: DataFrame) -> DataFrame:
        """(taxon, url): flora 0 is all of them."""
        return taxa.select("taxon", url_column(self.search_url, flora_id=F.lit(0), name_str=F.col("taxon")).alias("url"))

    def ids(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        """(taxon, flora_id, taxon_id): accepted names that the search page links; none where it says that it found none."""
        found = _found(self.search_urls(taxa), pages).filter(F.col("body").isNotNull() & ~F.col("body").contains(self.nothing))
        links = _linked(found.select("url", "body").distinct(), "^florataxon").filter("title = 'Accepted Name'")
        links = links.select("url", "pos", _parameter("flora_id").try_cast("int").alias("flora_id"), _parameter("taxon_id").try_cast("long").alias("taxon_id"))
        last = links.filter("flora_id is not null").groupBy("url", "flora_id").agg(F.max_by("taxon_id", "pos").alias("taxon_id"))
        return found.select("taxon", "url").join(last, "url").drop("url")

    def urls(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        """(taxon, flora_id, source_id, url) of the floras that have the taxon."""
        ids = self.ids(taxa, pages).filter(F.col("flora_id").isin(*self.floras))
        return ids.select("taxon", "flora_id", F.col("taxon_id").alias("source_id"), url_column(self.page_url, flora_id=F.col("flora_id"), taxon_id=F.col("taxon_id")).alias("url"))

    def describe(self, taxa: DataFrame, pages: DataFrame) -> DataFrame:
        floras = taxa.sparkSession.createDataFrame([(i, f"{self.name}.{FLORAS.get(i, i)}") for i in self.floras], "flora_id int, source string")
        wanted = _found(self.urls(taxa, pages), pages).join(floras, "flora_id")
        kept = lambda p: T.mentions(p, list(self.vocabulary)) if self.vocabulary else F.lit(True)
        text = html.paragraphs_of(F.col("body"), "div", "panelTaxonTreatment", "\n", kept, r"\S")
        every = taxa.select("taxon").distinct().join(floras, how="cross")  # four rows a taxon
        return every.join(wanted.select("taxon", "flora_id", "source_id", text.alias("text")), ["taxon", "flora_id"], "left").select("taxon", "source", "source_id", "text")


def descriptions(taxa: DataFrame, pages: DataFrame, providers: list[Provider]) -> DataFrame:
    """The providers' descriptions, those with a text, as one table."""
    found = [p.describe(taxa, pages) for p in providers]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("trim(text) <> ''")
