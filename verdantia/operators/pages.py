"""Pages of scanned text: which may hold a description of a taxon, which names they mention, which paragraphs describe it.

Defined cases: null and empty texts have no paragraphs, so they give no rows; repeated pages count as one page; empty tables
give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A genus, or its capital with a full stop, and an epithet.
NAME = r"(?<![\p{L}.])\p{Lu}(?:\p{Ll}+|\.)\s*(?<=[\s.])\p{Ll}{2,}(?:-\p{Ll}+)*"
LEAST_WORDS = 50  # a description has more


def candidates(pages: DataFrame, vocabulary: list[str], min_terms: int = 15, min_chars: int = 2500) -> DataFrame:
    """Pages with enough text and enough words of the vocabulary to be worth reading."""
    return pages.filter(T.mentions(F.col("text"), vocabulary, min_terms, min_chars))


def binomials(names: DataFrame, name: str = "taxon") -> DataFrame:
    """Names of two words; pages are not searched for others."""
    return names.filter(T.is_binomial(F.col(name)))


def names_in(t: Column) -> Column:
    """Names of a text in order, lower-cased, with one blank: array(string)."""
    return F.transform(F.regexp_extract_all(t, F.lit(NAME), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"\.?\s+|\.", " ")))


def name_key(name: Column) -> Column:
    """What ``names_in`` makes of a name."""
    return F.lower(F.trim(F.regexp_replace(F.replace(name, F.lit("**"), F.lit("")), r"\.?\s+", " ")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, taxon, idx, text, figure, title): the normalised page's paragraphs, those of a page once."""
    text = T.normalise_page(F.col("text"))
    rows = pages.dropDuplicates(["page_id", "taxon"]).select("page_id", "taxon", F.posexplode(T.paragraphs(text)).alias("idx", "text"))
    return rows.withColumn("figure", T.is_figure(F.col("text"))).withColumn("title", T.is_title(F.col("text")))


def with_names(rows: DataFrame, variants: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with n_taxa, the names in their text, and n_match, those that are a variant of the row's taxon.

    variants: (taxon, variant). known: (name) of all taxa; what looks like a name but is none of them does not count. Both are equi-joins on the name.
    """
    found = rows.select("page_id", "taxon", "idx", F.explode(names_in(F.col("text"))).alias("name"))
    own = variants.select(F.col("taxon").alias("__taxon"), name_key(F.col("variant")).alias("__name")).distinct().withColumn("match", F.lit(True))
    found = found.join(own, (F.col("taxon") == F.col("__taxon")) & (F.col("name") == F.col("__name")), "left")
    if known is not None:
        listed = known.select(name_key(F.col("name")).alias("name")).distinct().withColumn("listed", F.lit(True))
        found = found.join(listed, "name", "left").filter("match or listed")
    counts = found.groupBy("page_id", "taxon", "idx").agg(F.count("*").alias("n_taxa"), F.count("match").alias("n_match"))
    return rows.join(counts, ["page_id", "taxon", "idx"], "left").na.fill(0, ["n_taxa", "n_match"])


def description_paragraphs(rows: DataFrame, keys: tuple[str, ...] = ("page_id",), least_words: int = LEAST_WORDS, accept: Column | None = None) -> DataFrame:
    """Paragraphs that describe the taxon: the page's running state as window functions.

    rows: keys, idx, text, figure, title, n_taxa, n_match. A title turns the state off; a paragraph with taxon names turns it on
    if all of them match, else off; once as many matches are seen as the page has, and it is off, the page is over. While it is
    on, paragraphs of more than ``least_words`` words that ``accept`` (a classifier's column) takes are descriptions.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    read = ~F.col("figure") & ~F.col("title")
    event = F.when(F.col("figure"), None).when(F.col("title"), F.lit(False)).when(F.col("n_taxa") > 0, (F.col("n_match") > 0) & (F.col("n_match") == F.col("n_taxa")))
    df = rows.withColumn("total", F.sum("n_match").over(Window.partitionBy(*keys))).filter("total > 0").withColumn("event", event)
    df = df.withColumn("flag", F.coalesce(F.last("event", ignorenulls=True).over(order), F.lit(False))).withColumn("seen", F.sum(F.when(read, F.col("n_match")).otherwise(0)).over(order))
    stop = read & (F.col("n_taxa") > 0) & ~F.col("flag") & (F.col("seen") >= F.col("total"))
    df = df.withColumn("stopped", F.max(stop.cast("int")).over(order)).filter(F.col("flag") & read & (F.col("stopped") == 0))
    df = df.filter(F.size(T.tokens(F.col("text"))) > least_words)
    return (df if accept is None else df.filter(accept)).select(*keys, "idx", "text")


def join_paragraphs(rows: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, text): the paragraphs in order, a blank line between them."""
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"))
    return each.select(*keys, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def page_descriptions(pages: DataFrame, variants: DataFrame, known: DataFrame | None = None, least_words: int = LEAST_WORDS, accept: Column | None = None, source: str = "bhl") -> DataFrame:
    """(taxon, source, source_id, text) of pages (page_id, taxon, text) that describe their taxon; the others are left out."""
    found = description_paragraphs(with_names(paragraphs(pages), variants, known), ("page_id", "taxon"), least_words, accept)
    return join_paragraphs(found, ("page_id", "taxon")).select("taxon", F.lit(source).alias("source"), F.col("page_id").alias("source_id"), "text")
