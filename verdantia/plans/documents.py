"""Queries of the document engine: descriptions are put together from ``part`` in both dialects, and read by the engine alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import frames as O
from . import traits as P
from .base import described, query, read

PARTS = {
    "leaf": "leaf", "leaves": "leaf", "petal": "petal", "petals": "petal", "spike": "spike", "lamina": "leaf", "seed": "seed", "seeds": "seed",
    "stamen": "stamen", "stamens": "stamen", "root": "root", "roots": "root", "stem": "stem", "stems": "stem", "leaf blade": "leaf blade",
}
DICTIONARY = [
    ("colour", None, None, "pale yellow", "yellow", "petal colour"),
    ("colour", None, None, "white", "white", "petal colour"),
    ("colour", None, None, "red", "red", "petal colour"),
    ("discrete", "angiosperm", "plant", "erect", "erect", "habit"),
    ("discrete", "angiosperm", "leaf", "many-toothed", "toothed", "leaf margin"),
    ("discrete", "bryophyte", "leaf", "entire", "entire", "leaf margin"),
    ("discrete", "angiosperm", None, "fig", "syconium", "fruit type"),
]


def _dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "type string, group string, part string, term string, character string, trait string")


def _observed(spark, sf_dir, expression, **given):
    rows = described(spark, sf_dir, expression).select(F.col("p_partkey").alias("taxon"), F.col("p_brand").alias("source"), "text")
    return P.observations(rows, PARTS, _dictionary(spark), group="angiosperm", **given)


# ---------------------------------------------------------------- ranges and sizes
_FORMS = """CASE p_partkey % 6 WHEN 0 THEN concat(p_size, '-', p_size + 2, '(', p_size + 5, ')') WHEN 1 THEN concat('(', p_size, '-)', p_size + 1, '-', p_size + 4, '(-', p_size + 6, ')')
  WHEN 2 THEN concat(p_size, '-(', p_size + 3, ')') WHEN 3 THEN concat(p_size, '(-', p_size + 3, ')') WHEN 4 THEN concat('(', p_size, '-)', p_size + 2, ' - ', p_size + 3) ELSE concat(p_size, '.5') END"""


@query("""SELECT p_partkey, (CASE WHEN k IN (1, 4) THEN s END)::DOUBLE AS lower_v, (CASE k WHEN 1 THEN s + 1 WHEN 4 THEN s + 2 WHEN 5 THEN s + 0.5 ELSE s END)::DOUBLE AS from_v,
  (CASE k WHEN 0 THEN s + 2 WHEN 1 THEN s + 4 WHEN 4 THEN s + 3 END)::DOUBLE AS to_v, (CASE k WHEN 0 THEN s + 5 WHEN 1 THEN s + 6 WHEN 2 THEN s + 3 WHEN 3 THEN s + 3 END)::DOUBLE AS upper_v
FROM (SELECT p_partkey, p_size AS s, p_partkey % 6 AS k FROM part)""")
def range_forms(spark, sf_dir):
    """``a-b(c)``, ``(a-)b-c(-d)``, ``a-(b)``, ``a(-b)``, ``(a-)b - c`` and one number."""
    r = N.number_range(F.concat(F.lit("Stems "), F.expr(_FORMS), F.lit(" cm tall.")))
    return read(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", *(F.col(f"r.{x}").alias(f"{x}_v") for x in ("lower", "from", "to", "upper")))


def _sizes(spark, sf_dir, expression, *fields):
    seen = _observed(spark, sf_dir, expression)
    bound = lambda f: F.max(F.when(F.col("field") == f.rpartition(".")[0], F.col("most" if f.endswith("max") else "least")))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("taxon"))
    found = seen.groupBy("taxon").agg(*(F.round(bound(f), 6).alias(f.replace(" ", "_").replace(".", "_")) for f in fields))
    return parts.join(found, "taxon", "left")


@query("""SELECT p_partkey AS taxon, (CASE k WHEN 0 THEN NULL WHEN 1 THEN s WHEN 2 THEN s / 10.0 ELSE s END)::DOUBLE AS spike_measurement_length_max,
  (CASE k WHEN 0 THEN s WHEN 1 THEN s + 1 WHEN 2 THEN (s + 3) / 10.0 ELSE s + 2 END)::DOUBLE AS spike_measurement_width_max FROM (SELECT p_partkey, p_size AS s, p_partkey % 4 AS k FROM part)""")
def dimension_fold(spark, sf_dir):
    """An untyped size is length, then width; none after another type; ``A x B`` is both."""
    return _sizes(spark, sf_dir, """CASE p_partkey % 4 WHEN 0 THEN concat('Spike ', p_size, ' cm wide and ', p_size + 5, ' cm.') WHEN 1 THEN concat('Spike ', p_size, ' cm long, ', p_size + 1, ' cm wide.')
      WHEN 2 THEN concat('Spike ', p_size, ' x ', p_size + 3, ' mm.') ELSE concat('Spike ', p_size, ' cm and ', p_size + 2, ' cm.') END""", "spike measurement.length.max", "spike measurement.width.max")  # fmt: skip


@query("""SELECT p_partkey AS taxon, p_size::DOUBLE AS leaf_measurement_length_max, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 9)::DOUBLE END AS leaf_measurement_width_max FROM part""")
def fold_over_sentences(spark, sf_dir):
    """One part's sizes are assigned over the whole description: a second length is left out, a width is not."""
    return _sizes(spark, sf_dir, "concat('Leaves ', p_size, ' cm long. Erect. Leaves ', p_size + 9, CASE WHEN p_partkey % 2 = 0 THEN ' cm wide.' ELSE ' cm long.' END)", "leaf measurement.length.max", "leaf measurement.width.max")


@query("""SELECT p_partkey AS taxon, p_size::DOUBLE AS petal_measurement_length_max, CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1)::DOUBLE END AS petal_measurement_width_max FROM part""")
def measurement_scope(spark, sf_dir):
    """What stands behind another part is not the sentence's part's."""
    return _sizes(spark, sf_dir, "concat('Petals ', p_size, ' cm long ', CASE WHEN p_partkey % 3 = 0 THEN 'and ' ELSE 'with lamina ' END, p_size + 1, ' cm.')", "petal measurement.length.max", "petal measurement.width.max")


@query("""SELECT p_partkey AS taxon, round(p_size / CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 0.000001 END, 6)::DOUBLE AS seed_measurement_length_max FROM part""")
def volume_units(spark, sf_dir):
    """Cubic units, in cubic centimetres."""
    return _sizes(spark, sf_dir, "concat('Seeds of ', p_size, CASE p_partkey % 3 WHEN 0 THEN ' cm³' WHEN 1 THEN ' mm³' ELSE ' m³' END, '.')", "seed measurement.length.max")


# ---------------------------------------------------------------- values
def _values(observed, *fields):
    return observed.filter(F.col("field").isin(*fields)).select("taxon", "field", F.coalesce("value", F.col("most").cast("int").cast("string")).alias("value"))


@query("""SELECT p_partkey AS taxon, 'ploidy' AS field, concat('2n = ', 2 * p_size, ', ', 4 * p_size) AS value FROM part UNION ALL SELECT p_partkey, 'merosity', concat(p_partkey % 5 + 3, '-merous') FROM part""")
def ploidy_merosity(spark, sf_dir):
    return _values(_observed(spark, sf_dir, "concat('Annual; flowers ', p_partkey % 5 + 3, '-merous. 2n = ', 2 * p_size, ', ', 4 * p_size, '.')"), "ploidy", "merosity")


@query("""SELECT p_partkey AS taxon, 'stamen number' AS field, (p_partkey % 7 + 2)::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'seed number', p_size::VARCHAR FROM part WHERE p_partkey % 2 = 0""")
def part_counts(spark, sf_dir):
    """A bare number and the part behind it; the last one of a field holds. A number with a unit is none."""
    return _values(_observed(spark, sf_dir, "concat('Flowers with 1 stamen; ', p_partkey % 7 + 2, ' fertile stamens. ', p_size, CASE WHEN p_partkey % 2 = 0 THEN ' seeds.' ELSE ' mm seeds.' END)"), "stamen number", "seed number")


@query("""SELECT p_partkey AS taxon, 'petal colour' AS field, CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'white' ELSE 'pale yellow' END AS value FROM part""")
def colours(spark, sf_dir):
    """The longest term of the dictionary, in sentences with a part."""
    return _values(_observed(spark, sf_dir, "concat('Annual; rarely seen, red. Petals ', CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'white' ELSE 'pale yellow' END, '.')"), "petal colour", "plant colour")


@query("""SELECT p_partkey AS taxon, 'habit' AS field, 'erect' AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'leaf margin', 'toothed' FROM part UNION ALL SELECT p_partkey, 'fruit type', 'syconium' FROM part WHERE p_partkey % 3 = 0""")
def dictionary_terms(spark, sf_dir):
    """Terms of the plant in the first sentence, hyphenated terms of their part, none of another group; ``fig.`` is a figure."""
    text = "concat(CASE WHEN p_partkey % 2 = 0 THEN 'Erect' ELSE 'Creeping' END, ' herb. Leaves many-toothed, entire. See a ', CASE WHEN p_partkey % 3 = 0 THEN 'fig' ELSE 'fig.' END, ' there.')"
    return _values(_observed(spark, sf_dir, text), "habit", "leaf margin", "fruit type")


@query("""SELECT p_brand, min(p_size / 10.0)::DOUBLE AS least, max((p_size + 5) / 10.0)::DOUBLE AS most, count(DISTINCT (p_partkey, p_size)) AS n FROM part GROUP BY p_brand""")
def description_traits(spark, sf_dir):
    """End to end: abbreviations, sentences, the part's range, centimetres, one row a brand."""
    seen = _observed(spark, sf_dir, "concat('Herb. Lvs ', p_size, '-', p_size + 5, ' mm long; petals ', p_size, ' x ', p_size + 3, ' cm.')").filter("field = 'leaf measurement.length'")
    return seen.groupBy(F.col("source").alias("p_brand")).agg(F.round(F.min("least"), 6).alias("least"), F.round(F.max("most"), 6).alias("most"), F.count("*").alias("n"))


@query("""SELECT p_brand, min(p_size)::DOUBLE AS leaf_min_mm, max(p_size + 5)::DOUBLE AS leaf_max_mm, max(p_size + 3)::DOUBLE AS petal_width_cm, 'white' AS colour, 'toothed' AS margin FROM part GROUP BY p_brand""")
def traits_by_template(spark, sf_dir):
    """Observations of every sentence, then one row a taxon by a template with units, and fields to choose from."""
    text = "concat('Erect herb. Leaves ', p_size, '-', p_size + 5, ' mm long, many-toothed; petals white, ', p_size, ' x ', p_size + 3, ' cm.')"
    template = {"leaf_min_mm [mm]": "leaf measurement.length.min", "leaf_max_mm [mm]": "leaf measurement.length.max", "petal_width_cm": "petal measurement.width.max", "colour": ["flower colour", "petal colour"], "margin": "leaf margin"}
    out = P.by_template(_observed(spark, sf_dir, text), template, ("source",))
    return out.select(F.col("source").alias("p_brand"), *(F.col(f"`{c}`").cast("double").alias(c.split(" ")[0]) for c in list(template)[:3]), "colour", "margin")


@query("""SELECT p_partkey, concat(p_size, CASE p_partkey % 2 WHEN 0 THEN ' ovaries.' ELSE ' cm.' END) AS last, CASE p_partkey % 2 WHEN 0 THEN 4 ELSE 3 END AS n FROM part""")
def sentence_split(spark, sf_dir):
    """After a semicolon, a full stop before a capital, and one before a digit behind a word of three letters (``ca. 5`` stays whole)."""
    text = F.expr("concat('Herb; stem branched. Leaves ca. 5 cm', CASE p_partkey % 2 WHEN 0 THEN ' branched. ' ELSE ', ca. ' END, p_size, CASE p_partkey % 2 WHEN 0 THEN ' ovaries.' ELSE ' cm.' END)")
    s = T.sentences(text)
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(F.element_at(s, -1), r"([0-9]+ [a-z]+\.)$", 1).alias("last"), F.size(s).alias("n"))


@query("""WITH v(part, term) AS (SELECT DISTINCT 'group ' || r, r FROM (SELECT split_part(p_name, ' ', 1) AS r FROM part))
SELECT term, min(part) AS part FROM (SELECT part, term FROM v UNION ALL SELECT part, part AS term FROM v) GROUP BY term""")
def part_canonical(spark, sf_dir):
    """A synonym stands for its part, a part for itself."""
    rows = read(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("r")).distinct()
    return O.part_terms(rows.select(F.concat(F.lit("group "), "r").alias("part"), F.array("r").alias("synonyms")))
