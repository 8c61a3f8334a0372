"""Queries of training sets, reports and the rest of the whole-frame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as O
from ..operators import pages as G
from ..operators import training as R
from .base import query, read


@query("""SELECT doc_id, quality, CASE WHEN r <= 0.7 + 1e-12 THEN 'train' WHEN r <= 0.85 + 1e-12 THEN 'dev' ELSE 'test' END AS split FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) / count(*) OVER (PARTITION BY quality) AS r FROM labels)""")
def stratified_split(spark, sf_dir):
    return R.stratified(read(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", {"train": 0.7, "dev": 0.15, "test": 0.15})


@query("""WITH l AS (SELECT quality::BIGINT AS t, (1 - toxic)::BIGINT AS g FROM labels), k AS (SELECT t AS label FROM l UNION SELECT g FROM l),
c AS (SELECT label, (SELECT count(*) FROM l WHERE t = label AND g = label) AS h, (SELECT count(*) FROM l WHERE g = label) AS n, (SELECT count(*) FROM l WHERE t = label) AS support FROM k)
SELECT label, round(coalesce(h / nullif(n, 0), 0), 9)::DOUBLE AS "precision", round(coalesce(h / nullif(support, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2 * h / nullif(n + support, 0), 0), 9)::DOUBLE AS f1, support::BIGINT AS support FROM c""")
def classification_report(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("t"), (1 - F.col("toxic")).cast("long").alias("g"))
    found = R.report(rows, "t", "g")
    return found.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS n_aligned, CASE p_partkey % 4 WHEN 0 THEN 'PART' ELSE 'MULTI' END AS label FROM part""")
def span_alignment(spark, sf_dir):
    """Spans whose ends cut a word are left out; a text's label is its spans' or MULTI."""
    span = lambda a, b, label: F.struct(F.lit(a).alias("start"), F.expr(b).cast("int").alias("end"), F.expr(label).alias("label"))
    text = F.lit("Leaf blade 5 cm.")
    spans = F.array(span(0, "4", "'PART'"), span(5, "CASE p_partkey % 3 WHEN 2 THEN 7 ELSE 10 END", "CASE p_partkey % 4 WHEN 0 THEN 'PART' ELSE 'SIZE' END"))
    df = read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), spans.alias("e"))
    return df.select("p_partkey", F.size(R.aligned(F.col("text"), F.col("e"))).alias("n_aligned"), R.span_label(F.col("e")).alias("label"))


_SENTENCES = "concat(CASE p_partkey % 4 WHEN 0 THEN '2n = ' WHEN 1 THEN '(broken ' WHEN 2 THEN 'a (fine) ' ELSE 'plain ' END, p_size, ' cm')"


@query(f"""SELECT DISTINCT {_SENTENCES} AS sentence FROM part WHERE p_partkey % 4 >= 2""")
def numeric_examples(spark, sf_dir):
    return R.numeric_examples(read(spark, sf_dir, "part").select(F.expr(_SENTENCES).alias("sentence")))


@query("""SELECT doc_id AS id, quality::BIGINT AS labels, least(len(regexp_extract_all(text, '\\w+')), 12) AS n_tokens FROM documents JOIN labels USING (doc_id) WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""")
def prepared_examples(spark, sf_dir):
    """Renamed, typed and cut to the model's length; texts in ASCII, as the dialects' words differ beyond it."""
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    cut = R.prepared(df.withColumn("text", F.concat_ws("\u0001", "doc_id", "text")), "text", "quality", 13)
    return cut.select(F.split("text", "\u0001")[0].cast("long").alias("id"), "labels", (F.size("tokens") - 1).alias("n_tokens"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def label_counts(spark, sf_dir):
    return R.label_counts(read(spark, sf_dir, "events"), "event_type")


@query("""SELECT DISTINCT term FROM (SELECT p_brand AS term FROM part WHERE p_size > 25 UNION SELECT p_type FROM part WHERE p_size > 25)""")
def distinct_terms(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, "discrete").otherwise("colour").alias("type"), F.col("p_brand").alias("term"), F.col("p_type").alias("character"))
    return R.distinct_terms(rows, "discrete")


@query("""SELECT lower(c_mktsegment) AS taxonomic_group, string_agg(c_name, '|' ORDER BY c_name) AS taxa, count(*) AS n FROM customer WHERE c_custkey <= 50 GROUP BY 1""")
def taxa_of_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").filter("c_custkey <= 50").select(F.lower("c_mktsegment").alias("taxonomic_group"), F.col("c_name").alias("taxon"))
    found = O.taxa_of_groups(rows.unionAll(rows))
    return found.select("taxonomic_group", F.array_join("taxa", "|").alias("taxa"), "n")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'leafy' WHEN 1 THEN 'erect leafy/tussock' ELSE 'erect leafy,tussock' END AS terms FROM part""")
def slash_terms(spark, sf_dir):
    """``a/b`` goes where ``a`` or ``b`` stands."""
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('leafy', 'leafy/tussock') WHEN 1 THEN array('erect leafy/tussock') ELSE array('tussock', 'erect leafy', 'erect leafy/tussock') END")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(O.without_halves(t)), ",").alias("terms"))


@query("""SELECT s_suppkey % 5 AS k, concat(min(s_acctbal)::DECIMAL(18, 2), ' cm') AS "height min", concat(max(s_acctbal)::DECIMAL(18, 2), ' cm') AS "height max", string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS names FROM supplier WHERE s_acctbal > 0 GROUP BY 1""")
def measured_columns(spark, sf_dir):
    """Columns of numbers with a unit are found by their values."""
    cm = F.concat(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" cm"))
    df = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select((F.col("s_suppkey") % 5).alias("k"), "s_suppkey", cm.alias("height min"), cm.alias("height max"), F.col("s_name").alias("names"))
    return O.aggregate_by_type(df, "k", "s_suppkey")


@query("""SELECT lower(n) AS source, count(*) AS n FROM (SELECT 'BHL' AS n FROM customer UNION ALL SELECT 'ECOFLORA' FROM nation) GROUP BY 1""")
def enabled_sources(spark, sf_dir):
    sources = {"BHL": read(spark, sf_dir, "customer").select("c_name"), "EcoFlora": read(spark, sf_dir, "nation").select("n_name"), "EFLORAS": read(spark, sf_dir, "region")}
    return O.enabled(sources, ["bhl", "ECOFLORA"]).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|gre')""")
def containing_words(spark, sf_dir):
    return O.containing(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["RED", "gre"])


@query("""SELECT p_brand, p_partkey, p_size AS "a.b.size", p_type AS "a.type" FROM part""")
def flattened_fields(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct(F.col("p_size").alias("size")).alias("b"), F.col("p_type").alias("type")).alias("a"), "p_brand")
    return O.first_columns(O.flattened(df), ["p_brand", "p_partkey"])


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 < 2""")
def binomials(spark, sf_dir):
    """Names of other than two words are not searched for."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 2, F.concat("p_name", F.lit(" var. x"))).otherwise(F.col("p_name")).alias("p_name"))
    return G.binomials(df, "p_name")
