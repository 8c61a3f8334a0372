"""Pages, providers and training sets on small inputs with nulls, repeats and ties."""

import pytest
from pyspark.sql import functions as F

from verdantia.operators import frames as O
from verdantia.operators import pages as G
from verdantia.operators import training as R
from verdantia.sources import providers as V

LONG = "Leaves ovate and smooth with many teeth on each margin. " * 6


def test_page_descriptions(spark):
    page = f"FLORA OF NOWHERE.\n\nQuercus robur is a tree. {LONG}\n\nIt flowers late. {LONG}\n\nPinus nigra is another one. {LONG}\n\nThe end. {LONG}"
    pages = spark.createDataFrame([(1, "Quercus robur", page), (1, "Quercus robur", page), (2, "Quercus robur", f"Pinus nigra. {LONG}"), (3, "Quercus robur", None), (4, "Quercus robur", "")], "page_id long, taxon string, text string")
    pairs = spark.createDataFrame([("Quercus robur", "Quercus pedunculata")], "taxon string, synonym string")
    variants = O.name_variants(spark.createDataFrame([("Quercus robur",)], "taxon string"), pairs)
    known = spark.createDataFrame([("Pinus nigra",)], "name string")
    found = G.page_descriptions(pages, variants, known).collect()
    assert [(r.taxon, r.source, r.source_id) for r in found] == [("Quercus robur", "bhl", 1)]
    assert found[0].text.startswith("Quercus robur is a tree.") and "flowers late" in found[0].text and "Pinus" not in found[0].text
    assert G.page_descriptions(pages, variants, known, accept=F.lit(False)).count() == 0
    assert G.page_descriptions(pages, variants, known, least_words=1000).count() == 0
    assert G.page_descriptions(pages.limit(0), variants, known).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("Quercus  robur, Q. robur L. and A.B. of The trees; salix alba.",), (None,)], "t string")
    assert [r.n for r in df.select(G.names_in(F.col("t")).alias("n")).collect()] == [["quercus robur", "q robur", "l and", "the trees"], None]


INDEX = "<a href='/s?plant_no=1'>Aa bb</a><a href='s?plant_no=7'> Aa bb </a><a href='other'>Cc dd</a>"
SEARCH = "<a href='florataxon.aspx?flora_id=2&taxon_id=11' title='Accepted Name'>x</a><a href='florataxon.aspx?flora_id=2&taxon_id=12' title='Accepted Name'>x</a><a href='florataxon.aspx?flora_id=5&taxon_id=13' title='Synonym'>x</a><a href='florataxon.aspx?flora_id=4&taxon_id=14' title='Accepted Name'>x</a>"


def test_providers(spark):
    eco = V.EcologicalFlora("http://e/index", "http://e/page")
    shared = V.SharedFloras("http://f/search", "http://f/page")
    taxa = spark.createDataFrame([("Aa bb",), ("Cc dd",)], "taxon string")
    search = {r.taxon: r.url for r in shared.search_urls(taxa).collect()}
    assert search["Aa bb"] == "http://f/search?flora_id=0&name_str=Aa+bb" == V.with_query("http://f/search", flora_id=0, name_str="Aa bb")
    bodies = {
        "http://e/index": INDEX,
        "http://e/page?plant_no=7": "<div class='description'><p>A herb.</p><p>123</p><p>Tall.</p></div><p>no</p>",
        search["Aa bb"]: SEARCH,
        search["Cc dd"]: "No taxa found <a href='florataxon.aspx?flora_id=2&taxon_id=9' title='Accepted Name'>x</a>",
        "http://f/page?flora_id=2&taxon_id=12": "<div id='panelTaxonTreatment'><p>Leaves small.<br>x</p><p><table></table>cell</p><p>Petals red.</p></div>",
    }
    none = spark.createDataFrame([], "url string, status int, body string")
    urls = spark.createDataFrame([(u,) for u in [*bodies, *bodies, "http://f/page?flora_id=4&taxon_id=14"]], "url string")
    pages = V.fetched(urls, none, lambda u: (200, bodies[u]) if u in bodies else (404, "gone")).cache()
    assert pages.count() == 6 and V.fetched(urls, pages, lambda u: (500, "")).count() == 0
    assert {(r.taxon, r.source_id) for r in eco.urls(taxa, pages).collect()} == {("Aa bb", 7), ("Cc dd", None)}
    got = {(r.taxon, r.source, r.source_id, r.text) for r in V.descriptions(taxa, pages, [eco, shared]).collect()}
    assert got == {("Aa bb", "ecoflora", 7, "A herb. Tall."), ("Aa bb", "efloras.flora_of_china", 12, "Leaves small.x\nPetals red.")}
    assert shared.describe(taxa, pages).count() == 8 and eco.describe(taxa.limit(0), pages).count() == 0
    with pytest.raises(Exception, match="status 500"):
        V.fetched(urls, none, lambda u: (500, "")).collect()


def test_stratified_shares_are_exact_at_any_number_of_buckets(spark):
    rows = spark.createDataFrame([(k, None if k % 10 == 0 else k % 3) for k in range(200)] + [(7, 1)] * 3, "k long, l int")
    whole, dealt = (sorted(map(str, R.stratified(rows, "l", "k", {"a": 0.5, "b": 0.5}, buckets=n).collect())) for n in (1, 64))
    assert whole == dealt and len(whole) == 203
    assert R.stratified(rows.limit(0), "l", "k", {"a": 1.0}).count() == 0


def test_spans(spark):
    e = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([("Leaf blade", [(0, 4, "A"), (0, 3, "B"), (5, 10, "C"), (5, 99, "D"), (4, 4, "E")]), (None, None), ("", [])], f"t string, e {e}")
    got = [None if r.x is None else [s.label for s in r.x] for r in df.select(R.aligned(F.col("t"), F.col("e")).alias("x")).collect()]
    assert got == [["A", "C"], None, []]
