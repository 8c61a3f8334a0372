import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from verdantia.operators import frames as O
from verdantia.plans.settings import Settings, normaliser
from verdantia.sources import files, sinks


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Species name,Group\n Aa bb ,Angiosperm\n"Cc, dd",moss\n')
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": None}]))
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    rows = files.read_table(spark, str(tmp_path / "a.csv"))
    assert [r[0] for r in rows.collect()] == [" Aa bb ", "Cc, dd"]
    assert O.worklist(rows).collect() == [Row(taxon="Aa bb", taxonomic_group="angiosperm")]
    assert files.read_table(spark, str(tmp_path / "a.json"), "x long").count() == 2
    assert files.read_table(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "a.doc"))


def test_map_and_inline_names(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Aa bb": "7", "Cc dd": "8"}, indent=1))
    assert {tuple(r) for r in files.read_map(spark, str(tmp_path / "m.json"), "name", "id").collect()} == {("Aa bb", "7"), ("Cc dd", "8")}
    assert files.inline_taxa(spark, ["Aa bb", " Aa bb", ""], "bryophyte").count() == 1


def test_archive_pages(spark, tmp_path):
    folder = tmp_path / "000" / "000123"
    folder.mkdir(parents=True)
    (folder / "000123-00000045-0006.txt").write_text("page\ntext")
    (folder / "000123-00000099-0009.txt").write_text("not in the index")
    index = spark.createDataFrame([(45, 123, 6), (46, 123, 7), (47, 999, 1)], "page_id long, item_id long, sequence_order int")
    assert {r.page_id: r.text for r in files.archive_pages(spark, str(tmp_path), index).collect()} == {45: "page\ntext", 46: "", 47: ""}
    assert files.archive_pages(spark, str(tmp_path), index.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "x", None, "1"), ("B", "y", None, None)], "taxon string, source string, source_id long, v string")
    out = str(tmp_path / "out")
    sinks.write_by_source(df.select("taxon", "v"), df, out)
    assert spark.read.parquet(f"{out}/combined").count() == 1
    assert "source_id" not in spark.read.parquet(f"{out}/sources").columns
    sinks.write(df.limit(0), f"{out}/combined")
    assert spark.read.parquet(f"{out}/combined").count() == 1
    sinks.write(df, f"{out}/c", "csv", force=True)
    assert spark.read.csv(f"{out}/c", header=True).count() == 2
    assert sinks.output_name(["Aa bb"]) == "aa-bb" and len(sinks.output_name(["a", "b"])) == 64


def test_settings_files(spark, tmp_path):
    import yaml

    (tmp_path / "p.yml").write_text("leaf:\n  - leaves\npetal:\n")
    assert files.read_settings(str(tmp_path / "p.yml")) == {"leaf": ["leaves"], "petal": None}
    df = spark.createDataFrame([("A: b", 1), (None, 2)], "t string, n int")
    sinks.write(df, f"{tmp_path}/y", "yaml")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/y").collect())
    assert sorted(yaml.safe_load(text), key=lambda r: r["n"]) == [{"t": "A: b", "n": 1}, {"t": None, "n": 2}]
    sinks.descriptions_csv([df.select(F.lit("x").alias("taxon"), F.col("t").alias("text"))], f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 1
    (tmp_path / "d.jsonl").write_text('{"label": "LENGTH", "pattern": [{"LOWER": "long"}]}\n{"label": "X", "pattern": [{"LEMMA": "pale"}, {"LOWER": "red"}]}\n')
    assert {tuple(r) for r in files.read_jsonl_terms(spark, str(tmp_path / "d.jsonl")).collect()} == {("LENGTH", "long"), ("X", "pale red")}


def test_term_patterns(spark):
    terms = spark.createDataFrame([("TRAIT", "Leaves"), ("TRAIT", "many-toothed"), ("TRAIT", None)], "label string, term string")
    got = {(r.key, r.by) for r in sinks.term_patterns(terms).collect()}
    assert got == {("leaves", "lower"), ("leave", "lemma"), ("many-toothed", "lower"), ("many-toothed", "lemma"), ("many - toothed", "lower")}


def test_settings_and_steps(spark):
    given = Settings.of_environment({"VERDANTIA_SOURCES": "BHL, ecoflora", "VERDANTIA_DEBUG": "1"})
    assert given.sources == ("bhl", "ecoflora") and given.get("debug") is True and given.with_("text_source", "api").text_source == "api"
    for wrong in (lambda: given.get("nothing"), lambda: given.with_("archive", "x"), lambda: normaliser().put("x", F.upper, after="nothing")):
        with pytest.raises(KeyError):
            wrong()
    steps = normaliser().put("shout", F.upper, after="errors").put("ascii", lambda c: c)
    assert list(steps.steps)[2:5] == ["errors", "shout", "ascii"]
    assert spark.createDataFrame([("lvs é",)], "t string").select(steps(F.col("t"))).head()[0] == "LEAVES É"
