"""Observations, their summaries, the command line, the stream and the classifier, on small inputs."""

import json

from verdantia import __main__ as cli
from verdantia.operators import classifier
from verdantia.plans import traits as P
from verdantia.streaming import descriptions as S

PARTS = {"leaf": ["leaves", "leaf blade"], "petal": None, "stamen": []}
TEXT = "Erect herb. Leaves 10-20 mm long; petals 3 x 4 cm, white. 2n = 18."
ROWS = [("Aa bb", "one", TEXT), ("Aa bb", "two", "Leaves 5-8 mm long."), ("Cc dd", "one", None), ("Cc dd", "two", "")]


def seen(spark, rows=ROWS, traits=None):
    return P.observations(spark.createDataFrame(rows, "taxon string, source string, text string"), cli.part_terms(PARTS), traits)


def test_observations(spark):
    got = {r.field: (r.least, r.most, r.value) for r in P.summary(seen(spark)).collect()}
    assert got["leaf measurement.length"] == (0.5, 2.0, None)
    assert got["petal measurement.length"][:2] == (3.0, 3.0) and got["petal measurement.width"][:2] == (4.0, 4.0)
    assert got["ploidy"][2] == "2n = 18"
    assert seen(spark, []).count() == 0
    assert seen(spark, ROWS + ROWS).count() == seen(spark).count()


WHOLE = (
    "Herbs to 40-100 cm tall, annual, much branched.  Leaves 10 cm long and 20 - 50 cm wide. Leaves 30 cm long. Petals 15 x 20 cm, pale yellow. Spike 10 cm wide and 15 cm. "
    "Roots 60 cm deep. Seeds 10-20 mm diameter. 2 ovaries. 56 stamens. See fig. 3. Flowers 5-merous. Petals 2-3 cm long with lamina 2 cm. 7-8 cm. 2n=23,34"
)


def test_a_whole_description(spark):
    """Ranges, units, dimensions, scope, counts, colours, figures and chromosome numbers of one text."""
    parts = {"leaf": ["leaves", "lamina"], "petal": None, "spike": None, "root": None, "seed": None, "ovary": ["ovaries"], "stamen": None, "flower": None}
    rows = [("colour", None, "pale yellow", "yellow", "petal colour", None), ("discrete", "angiosperm", "branched", "branched", "branching", "plant")]
    rows += [("discrete", "angiosperm", "fig", "fig", "fruit type", None), ("discrete", "bryophyte", "annual", "annual", "life form", "plant")]
    traits = spark.createDataFrame(rows, "type string, group string, term string, character string, trait string, part string")
    found = P.observations(spark.createDataFrame([("A", "s", WHOLE)], "taxon string, source string, text string"), cli.part_terms(parts), traits, group="angiosperm")
    sizes = {r.field.replace(" measurement.", " "): (round(r.least, 6), round(r.most, 6)) for r in found.collect() if r.least is not None}
    assert sizes == {
        "plant height": (40, 100), "leaf length": (10, 10), "leaf width": (20, 50), "petal length": (15, 15), "petal width": (20, 20), "spike width": (10, 10),
        "root depth": (60, 60), "seed diameter": (1, 2), "ovary number": (2, 2), "stamen number": (56, 56),
    }
    assert {(r.field, r.value) for r in found.collect() if r.value} == {("petal colour", "pale yellow"), ("branching", "branched"), ("merosity", "5-merous"), ("ploidy", "2n=23,34")}


def test_descriptions_of_one_taxon_stay_apart(spark):
    rows = [("A", "s", 1, "Leaves 1 cm long."), ("A", "s", 2, "Leaves 2 cm long."), (None, None, None, "Leaves 3 cm long.")]
    found = P.observations(spark.createDataFrame(rows, "taxon string, source string, source_id long, text string"), {"leaves": "leaf"}).collect()
    assert sorted((r.source_id or 0, r.most) for r in found) == [(0, 3.0), (1, 1.0), (2, 2.0)]


def test_plans_stay_small(spark):
    """Nothing is written twice into a plan."""
    plan = seen(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_texts_are_dealt_once_and_read_once(spark):
    """One exchange deals the texts to all tasks, a small dictionary is sent, and no filter repeats what a row's text was parsed for."""
    run = seen(spark, traits=spark.createDataFrame([("white", "petal", "white", "colour")], "term string, part string, character string, trait string"))._jdf.queryExecution()
    plan = run.executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(taxon") == 1 and "REPARTITION_BY_NUM" in plan
    assert not [line for line in run.optimizedPlan().toString().split("\n") if line.lstrip(" :+-").startswith("Filter") and "centimetre" in line]


def test_a_large_dictionary_is_joined_by_its_keys(spark, monkeypatch):
    traits = spark.createDataFrame([("white", "petal", "white", "colour"), ("erect", None, "upright", "habit")], "term string, part string, character string, trait string")
    sent = sorted(map(str, seen(spark, traits=traits).collect()))
    monkeypatch.setattr(P, "SENT", 0)
    monkeypatch.setattr(P, "TASKS", 1)
    assert sorted(map(str, seen(spark, traits=traits).collect())) == sent and len(sent) > 5


def test_dictionary_fits_part(spark):
    traits = spark.createDataFrame([("white", "petal", "white", "colour"), ("white", "leaf", "pale", "colour"), ("erect", None, "upright", "habit")], "term string, part string, character string, trait string")
    got = {(r.part, r.field, r.value) for r in seen(spark, traits=traits).filter("value is not null and field <> 'ploidy'").collect()}
    assert got == {("petal", "colour", "white"), ("plant", "habit", "upright")}


def test_template_units(spark):
    row = P.by_template(seen(spark), {"leaf max [mm]": "leaf measurement.length.max", "petal [m]": ["stamen measurement.length.min", "petal measurement.length.min"], "ploidy": None}).filter("taxon = 'Aa bb'").head()
    assert float(row["leaf max [mm]"]) == 20.0 and float(row["petal [m]"]) == 0.03 and row["ploidy"] == "2n = 18"
    with_units = P.by_template(seen(spark), {"leaf max [mm]": "leaf measurement.length.max"}, units=True).filter("taxon = 'Aa bb'").head()
    assert with_units["leaf max [mm]"] == "20.0 mm"


def test_command_line(spark, tmp_path):
    spark.createDataFrame(ROWS, "taxon string, source string, text string").write.parquet(f"{tmp_path}/d.parquet")
    (tmp_path / "parts.json").write_text(json.dumps(PARTS))
    (tmp_path / "template.json").write_text(json.dumps({"leaf [cm]": "leaf measurement.length.max"}))
    path = cli.main(["traits", "--taxa", "Aa bb", "--group", "angiosperm", "--descriptions", f"{tmp_path}/d.parquet", "--parts", f"{tmp_path}/parts.json", "--template", f"{tmp_path}/template.json", "--out", f"{tmp_path}/out"])
    assert path.endswith("aa-bb")
    assert [float(r[1]) for r in spark.read.parquet(f"{path}/combined").collect()] == [2.0]
    assert {(r.source, float(r["leaf [cm]"])) for r in spark.read.parquet(f"{path}/sources").collect()} == {("one", 2.0), ("two", 0.8)}


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(ROWS, S.SCHEMA).repartition(3).write.json(f"{tmp_path}/in")
    for _ in range(2):  # started again, it finds nothing new
        S.observe(S.arriving(spark, f"{tmp_path}/in"), cli.part_terms(PARTS), f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, seen(spark).select(got.columns).collect())) and got.count() > 3


def test_classifier(spark):
    rows = [(f"Leaves {k} mm long, petals white, stem erect", 1) for k in range(20)] + [(f"The ship sailed on day {k} of the year", 0) for k in range(20)]
    model = classifier.fit(spark.createDataFrame(rows, "text string, is_desc int"), features=1 << 12)
    got = classifier.score(model, spark.createDataFrame([("Stem erect, leaves long",), ("The ship sailed",), (None,)], "text string")).collect()
    assert [r.accepted for r in got] == [True, False, False]
