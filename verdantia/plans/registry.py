"""Every registered query of the botanical engine over the driver's tables, and its oracle SQL.

Description text is synthesised from ``part`` (p_partkey k, p_size s) by the same concatenation in both engines, which then
each have to read it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import frames as O
from ..operators import training as R
from ..sources import html as H
from . import documents, pages, training  # noqa: F401  (they register their queries)
from .base import ORACLE, QUERIES, described, query, read

__all__ = ["ORACLE", "QUERIES"]

RANGE = "concat('Stems (', p_size, '-)', p_size + 2, '-', p_size + 6, '(-', p_size + 9, ') cm tall.')"


@query("""SELECT p_brand, min(p_size)::DOUBLE AS min_cm, max(p_size + 9)::DOUBLE AS max_cm, round(avg(p_size), 2) AS mean_min_cm, count(*) AS n FROM part GROUP BY p_brand""")
def range_minmax_by_brand(spark, sf_dir):
    df = described(spark, sf_dir, RANGE).select("p_brand", N.number_range(F.col("text")).alias("r"), N.unit(F.col("text")).alias("u"))
    df = df.select("p_brand", N.least_most(F.col("r")).alias("b"), "u").select("p_brand", N.convert(F.col("b.min"), F.col("u")).alias("lo"), N.convert(F.col("b.max"), F.col("u")).alias("hi"))
    return df.groupBy("p_brand").agg(F.min("lo").alias("min_cm"), F.max("hi").alias("max_cm"), F.round(F.avg("lo"), 2).alias("mean_min_cm"), F.count("*").alias("n"))


@query("""SELECT p_partkey, regexp_extract(t, '\\((\\d+)-\\)', 1)::DOUBLE AS lower_v, regexp_extract(t, '\\)(\\d+)-', 1)::DOUBLE AS from_v, regexp_extract(t, '-(\\d+)\\(', 1)::DOUBLE AS to_v, regexp_extract(t, '\\(-(\\d+)\\)', 1)::DOUBLE AS upper_v
FROM (SELECT p_partkey, concat('Stems (', p_size, '-)', p_size + 2, '-', p_size + 6, '(-', p_size + 9, ') cm tall.') AS t FROM part)""")
def range_parts(spark, sf_dir):
    r = N.number_range(F.col("text"))
    return described(spark, sf_dir, RANGE).select("p_partkey", *(r[x].alias(f"{x}_v") for x in ("lower", "from", "to", "upper")))


@query("""SELECT p_partkey, p_size / 10.0::DOUBLE AS length_cm, (p_size + 3) / 10.0::DOUBLE AS width_cm FROM part""")
def dimension_split(spark, sf_dir):
    parts = N.dimension_parts(F.col("text"))
    df = described(spark, sf_dir, "concat('Petals ', p_size, ' x ', p_size + 3, ' mm.')").select("p_partkey", parts.alias("d"))
    value = lambda k: F.round(N.convert(N.numbers(F.col("d")[k]["text"])[0].cast("double"), F.col("d")[k]["unit"]), 6)
    return df.select("p_partkey", value(0).alias("length_cm"), value(1).alias("width_cm"))





@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE (p_partkey % 3)::DOUBLE END AS min_v, p_size::DOUBLE AS max_v FROM part""")
def zero_is_no_minimum(spark, sf_dir):
    df = described(spark, sf_dir, "concat('Roots ', p_partkey % 3, '-', p_size, ' cm deep.')").select("p_partkey", "p_size", N.least_most(N.number_range(F.col("text"))).alias("b"))
    return df.select("p_partkey", F.coalesce("b.min", F.col("p_size").cast("double")).alias("min_v"), F.col("b.max").alias("max_v"))





@query("""SELECT p_partkey, concat('Leaves ', p_size, ' cm, inflorescence ', p_size + 1, ' cm diameter') AS text FROM part""")
def abbrev_expand(spark, sf_dir):
    return described(spark, sf_dir, "concat('Lvs ', p_size, ' cm, infl. ', p_size + 1, ' cm diam.')").select("p_partkey", T.expand_abbreviations(F.col("text")).alias("text"))


@query("""SELECT p_partkey, concat('about ', round_even((p_partkey % 9 + 1)::DOUBLE / (p_size % 9 + 1)::DOUBLE, 1), ' of stem') AS text FROM part""")
def fraction_decimal(spark, sf_dir):
    return described(spark, sf_dir, "concat('about ', p_partkey % 9 + 1, '/', p_size % 9 + 1, ' of stem')").select("p_partkey", T.fractions(F.col("text")).alias("text"))


@query("""SELECT p_partkey, concat('leaf ', p_size, ' cm, root (', p_size, ')') AS text FROM part""")
def conjoined_split(spark, sf_dir):
    return described(spark, sf_dir, "concat('leaf', p_size, 'cm,root(', p_size, ')')").select("p_partkey", T.split_conjoined(F.col("text")).alias("text"))





VOCABULARY = ["the", "and", "that", "this", "with", "for", "was", "are", "of", "to", "in"]
_VOC = ", ".join(f"'{w}'" for w in VOCABULARY)


@query(f"""SELECT doc_id, length(text) >= 100 AND len(list_intersect(list_distinct(regexp_extract_all(lower(text), '\\S+')), [{_VOC}])) >= 5 AS is_description FROM documents""")
def vocab_classifier(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), VOCABULARY).alias("is_description"))


@query(f"""SELECT quality::BIGINT AS truth, (length(text) >= 100 AND len(list_intersect(list_distinct(regexp_extract_all(lower(text), '\\S+')), [{_VOC}])) >= 5)::BIGINT AS guess, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def vocab_vs_labels(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return R.confusion(df.select(F.col("quality").cast("long").alias("q"), T.mentions(F.col("text"), VOCABULARY).cast("long").alias("g")), "q", "g")



@query("""SELECT doc_id, i::INT AS idx, length(p) > 1 AND len(regexp_extract_all(p, '[a-z]+')) <= 1 AS title, regexp_matches(p, '^[0-9]+[a-zA-Z][.| ]') AS figure
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)""")
def title_figure_paragraphs(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "p"))
    return df.select("doc_id", "idx", T.is_title(F.col("p")).alias("title"), T.is_figure(F.col("p")).alias("figure"))


_TRAITS = [("red", "red", "flower red", "petal"), ("white", "white", "flower white", None), ("leaf", "leaves", "leafy", "plant"), ("small", "brass", "fruit small", "fruit"), ("brass", "copper", "metallic", None)]


@query("""WITH t(term, character, trait, trait_part) AS (VALUES ('red', 'red', 'flower red', 'petal'), ('white', 'white', 'flower white', NULL), ('leaf', 'leaves', 'leafy', 'plant'), ('small', 'brass', 'fruit small', 'fruit'), ('brass', 'copper', 'metallic', NULL)),
e AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS text, CASE p_partkey % 4 WHEN 0 THEN 'plant' WHEN 1 THEN 'petal' WHEN 2 THEN 'fruit' END AS part FROM part)
SELECT DISTINCT id, text, part, false AS is_part, term, character, trait, trait_part FROM e JOIN t ON text = term OR text = character OR regexp_replace(text, 's$', '') = term
WHERE coalesce((part = 'plant' AND (trait_part IS NULL OR trait_part = 'plant')) OR (part <> 'plant' AND part = trait_part) OR (part IS NULL AND trait_part IS NULL), false)""")
def dictionary_join(spark, sf_dir):
    part = F.when(F.col("p_partkey") % 4 == 0, "plant").when(F.col("p_partkey") % 4 == 1, "petal").when(F.col("p_partkey") % 4 == 2, "fruit")
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("text"), part.alias("part"), F.lit(False).alias("is_part"))
    return O.dictionary_join(e, spark.createDataFrame(_TRAITS, "term string, character string, trait string, part string"))



@query("""SELECT n_name AS taxon, o AS synonym FROM (SELECT a.n_name, b.n_name AS o FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name <> b.n_name)""")
def synonym_closure(spark, sf_dir):
    """Nations as names: the first of each region is accepted, the others are its synonyms."""
    n = read(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("accepted"))
    flora = n.join(first, "n_regionkey").select(F.col("n_name").alias("scientificName"), F.col("n_nationkey").alias("taxonID"), F.col("accepted").alias("acceptedNameUsageID"), F.lit("SPECIES").alias("taxonRank"), F.when(F.col("n_nationkey") == F.col("accepted"), "ACCEPTED").otherwise("SYNONYM").alias("taxonomicStatus"))
    return O.synonyms(n.select(F.col("n_name").alias("taxon")), flora)


@query("""SELECT l_orderkey AS page_id, p_name AS name_confirmed FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7)""")
def page_semijoin(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    index = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("page_id"), F.col("p_name").alias("name_confirmed"))
    return O.pages_of(part.filter("p_size = 7").select(F.col("p_name").alias("name")).distinct(), index)


@query("""SELECT o_orderkey, concat(lpad((o_custkey)::VARCHAR, 6, '0')[1:3], '/', lpad(o_custkey::VARCHAR, 6, '0'), '/', lpad(o_custkey::VARCHAR, 6, '0'), '-', lpad(o_orderkey::VARCHAR, 8, '0'), '-', lpad((o_orderkey % 100)::VARCHAR, 4, '0')) AS key FROM orders""")
def archive_key(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.archive_key(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 100).alias("key"))


@query("""SELECT p_brand, min(p_size) AS size_min, max(p_size) AS size_max, CASE WHEN min(p_size) = max(p_size) THEN min(p_size)::VARCHAR ELSE concat(min(p_size), '-', max(p_size)) END AS size,
  string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS kinds, concat(max(p_size)::DECIMAL(18, 2), ' cm') AS "height max" FROM part GROUP BY p_brand""")
def type_directed_agg(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("size_min"), F.col("p_size").alias("size_max"), F.col("p_size").alias("size"), F.col("p_type").alias("kinds"), F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("cm")).alias("height max"))
    return O.aggregate_by_type(df, "p_brand", "p_partkey", ("height max",))


@query("""SELECT l_suppkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN min(l_linenumber)::VARCHAR ELSE concat(min(l_linenumber), '-', max(l_linenumber)) END AS lines FROM lineitem GROUP BY l_suppkey""")
def num_range(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(O.num_range(F.col("l_linenumber")).alias("lines"))


@query("""SELECT p_size, CASE WHEN count(*) FILTER (p_partkey % 2 = 0) = 0 THEN string_agg(concat('2n = ', p_partkey), '| ' ORDER BY concat('2n = ', p_partkey)) ELSE
  (SELECT string_agg(DISTINCT x, ', ' ORDER BY x) FROM (SELECT unnest(string_split(p_name, ' ')) AS x, q.p_size AS s FROM part q WHERE q.p_partkey % 2 = 0) WHERE s = p.p_size) END AS terms FROM part p GROUP BY p_size""")
def concat_terms(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_size", F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(", "))).otherwise(F.concat(F.lit("2n = "), F.col("p_partkey").cast("string"))).alias("t"))
    return df.groupBy("p_size").agg(O.terms(F.col("t")).alias("terms"))



@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE (p_size % 7)::VARCHAR END AS "first [mm]", p_type, NULL::VARCHAR AS missing FROM part""")
def coalesce_template(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("rest", F.nullif(F.col("p_size") % 7, F.lit(0)))
    return O.project_template(df, {"first [mm]": ["rest", "p_brand"], "p_type": None, "missing": "nowhere"}, ["p_partkey"])


@query("""SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_missing_cols(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return O.combine([a, read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))])


@query("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3""")
def limit_per_group(spark, sf_dir):
    return O.limit_per_group(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 3)


@query("""SELECT p_partkey, nullif(p_size % 7, 0) AS a, nullif(p_size % 5, 0) AS b FROM part WHERE p_size % 35 <> 0""")
def dropna_all(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("a"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("b"))
    return O.drop_empty(df, ["p_partkey"])



@query("""SELECT doc_id, len(regexp_split_to_array(trim(split_part(text, '.', 1)), '\\s+')) = 2 AND trim(split_part(text, '.', 1)) <> '' AS binomial FROM documents""")
def binomial_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.is_binomial(F.split("text", r"\.")[0]).alias("binomial"))


@query("""SELECT p_partkey, concat(upper(p_name[1:1]), lower(p_name[2:])) AS name FROM part""")
def capitalise(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.capitalise(F.col("p_name")).alias("name"))



@query("""SELECT p_partkey, round(p_size * f::DOUBLE, 12) AS metres FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 WHEN 2 THEN 1.0 ELSE 0.3048 END AS f FROM part)""")
def unit_conversion(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("mm", "cm", "m", "ft"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(N.convert(F.col("p_size").cast("double"), unit, "m"), 12).alias("metres"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href="')) AS n_links FROM pages""")
def html_links(spark, sf_dir):
    links = H.links(read(spark, sf_dir, "pages"), "page_id", "html")
    return links.select("page_id", F.size("links").cast("long").alias("n_links"))
