"""Queries of text functions, pages and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frames as O
from ..operators import pages as G
from ..sources import html as H
from ..sources import sinks
from .base import query, read

_SPACE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_HYPHENS = f"replace(replace({_SPACE}, '--', '-'), '–', '-')"


@query(f"SELECT doc_id, {_HYPHENS} AS text FROM documents")
def normalise_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.hyphens(T.collapse_space(F.col("text"))).alias("text"))


_EM = r"'(^|[^\p{L}\p{N}_])em($|[^\p{L}\p{N}_])', '\1cm\2', 'g')"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_HYPHENS}, ',(\s+[A-Z])', '.\1', 'g'), {_EM}, {_EM} AS text FROM documents""")
def comma_to_period(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.common_errors(F.col("text")).alias("text"))


@query("""SELECT doc_id, replace(strip_accents(replace(replace(text, 'ß', 'ss'), 'ẞ', 'SS')), 'ł', 'l') AS text FROM documents""")
def translit(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.transliterate(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '([a-zA-Z0-9_])-[\s\n]+', '\1', 'g'), '\.[ \t]+\n', E'.\n', 'g') AS text FROM documents""")
def page_hyphenation(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.rejoined(F.col("text")).alias("text"))


@query()
def ocr_normalise(spark, sf_dir):
    """Compared with plain Python in the tests: the oracle's patterns cannot look back."""
    return read(spark, sf_dir, "documents").select("doc_id", T.normalise_page(F.col("text")).alias("text"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id""")
def last_wins(spark, sf_dir):
    return O.last_value(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug FROM part""")
def slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("""SELECT r_regionkey, CASE WHEN count(*) = 1 THEN lower(replace(trim(min(n_name)), ' ', '-')) ELSE sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) END AS name
FROM region JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 5 < r_regionkey + 1 GROUP BY r_regionkey""")
def output_names(spark, sf_dir):
    """Names of outputs: of one taxon, or of several."""
    rows = read(spark, sf_dir, "nation").filter("n_nationkey % 5 < n_regionkey + 1").orderBy("n_nationkey").collect()  # 25 rows
    lists: dict = {}
    for r in rows:
        lists.setdefault(r.n_regionkey, []).append(r.n_name)
    return spark.createDataFrame([(k, sinks.output_name(v)) for k, v in lists.items()], "r_regionkey int, name string")


# ---------------------------------------------------------------- paragraphs of pages
def _paragraphs(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    n = lambda w: F.regexp_count("text", F.lit(rf"\b{w}\b"))
    return df.select("page_id", "idx", "text", T.is_figure(F.col("text")).alias("figure"), T.is_title(F.col("text")).alias("title"), (n("The") + n("And")).alias("n_taxa"), n("The").alias("n_match"))


_STATE = r"""WITH p AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
a AS (SELECT *, regexp_matches(text, '^[0-9]+[a-zA-Z][.|\s]') AS figure, length(text) > 1 AND len(regexp_extract_all(text, '[a-z]+')) <= 1 AS title,
  len(regexp_extract_all(text, '\bThe\b')) AS n_match, len(regexp_extract_all(text, '\bAnd\b')) + len(regexp_extract_all(text, '\bThe\b')) AS n_taxa FROM p),
b AS (SELECT *, sum(n_match) OVER (PARTITION BY page_id) AS total, CASE WHEN figure THEN NULL WHEN title THEN false WHEN n_taxa > 0 THEN n_match > 0 AND n_match = n_taxa END AS event FROM a),
c AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER w, false) AS flag, sum(CASE WHEN NOT figure AND NOT title THEN n_match ELSE 0 END) OVER w AS seen FROM b WHERE total > 0 WINDOW w AS (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, max((NOT figure AND NOT title AND n_taxa > 0 AND NOT flag AND seen >= total)::INT) OVER (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS stopped FROM c),
e AS (SELECT page_id, idx::INT AS idx, text FROM d WHERE flag AND NOT figure AND NOT title AND stopped = 0 AND len(regexp_extract_all(text, '\S+')) > 20 AND regexp_matches(text, '[aeiou]'))
"""


@query(_STATE + "SELECT * FROM e")
def paragraph_state(spark, sf_dir):
    """State, length and a classifier's column."""
    return G.description_paragraphs(_paragraphs(spark, sf_dir), least_words=20, accept=F.col("text").rlike("[aeiou]"))


@query(_STATE + "SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM e GROUP BY page_id")
def paragraph_concat(spark, sf_dir):
    return G.join_paragraphs(G.description_paragraphs(_paragraphs(spark, sf_dir), least_words=20, accept=F.col("text").rlike("[aeiou]")))


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END::BIGINT AS n_taxa, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::BIGINT AS n_match FROM part""")
def taxon_names(spark, sf_dir):
    """Names in text against a taxon's variants: in full, abbreviated, in another case of the list, and other names."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Here Quercus robur grows; Q. robur is tall.' WHEN 1 THEN 'Quercus robur and Pinus nigra.' WHEN 2 THEN 'Near Pinus nigra.' ELSE 'Robur vulgaris, Q.  robur, Pinus nigra; The leaves.' END")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("Quercus robur").alias("taxon"), F.lit(0).alias("idx"), text.alias("text"))
    names = spark.createDataFrame([("Quercus robur",), ("Robur vulgaris",)], "taxon string")
    pairs = spark.createDataFrame([("Quercus robur", "Robur vulgaris")], "taxon string, synonym string")
    known = spark.createDataFrame([("Pinus nigra",)], "name string")
    return G.with_names(rows, O.name_variants(names.filter("taxon like 'Q%'"), pairs), known).select("page_id", "n_taxa", "n_match")


@query("""SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 2500 AND len(list_distinct(list_intersect(regexp_extract_all(lower(text), '\\S+'), ['the', 'of', 'and', 'to', 'in', 'le', 'la', 'der', 'und', 'que']))) >= 4""")
def page_prefilter(spark, sf_dir):
    pages = G.candidates(read(spark, sf_dir, "documents"), ["the", "of", "and", "to", "in", "le", "la", "der", "und", "que"], min_terms=4)
    return pages.select("doc_id", F.length("text").cast("long").alias("n"))


# ---------------------------------------------------------------- HTML
@query()
def html_paragraphs(spark, sf_dir):
    """Compared with an independent reading in the tests (character references are beyond the oracle's functions)."""
    return H.paragraphs(read(spark, sf_dir, "pages"), "page_id", "html", "article")
