import re

import duckdb
import pytest
from pyspark.sql import functions as F

from verdantia.functions import numeric as N
from verdantia.functions import text as T
from verdantia.operators import frames as O
from verdantia.plans import registry
from verdantia.sources import html as H

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
PLAIN = {"ocr_normalise", "html_paragraphs"}  # compared with plain Python below


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _shown(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {quoted} from ({registry.ORACLE[name]})").fetchall()
    assert _shown(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect())) == _shown(want)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10-20 cm", (None, 10, 20, None)),
        ("1.5-2(-2.2) mm", (None, 1.5, 2, 2.2)),
        ("(3-)5-7 cm", (3, 5, 7, None)),
        ("0.5-1(1.5)", (None, 0.5, 1, 1.5)),
        ("5-(6) cm", (None, 5, None, 6)),
        ("(2-)3-4(-5)", (2, 3, 4, 5)),
        ("( 2 - ) 3 - 4 ( - 5 )", (2, 3, 4, 5)),
        ("7", (None, 7, None, None)),
        ("1/2", None),
        ("1 2 3 4 5", None),
        ("none", None),
        ("", None),
        (None, None),
    ],
)
def test_number_range(spark, text, want):
    got = one(spark, text, N.number_range)
    assert (got and tuple(got)) == want


def test_normaliser_keeps_clean_text(spark):
    assert one(spark, "A clean sentence. Another one.", T.normalise) == "A clean sentence. Another one."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("LvS 3–10 × 0.4–0.8 cm,infl.4", "Leaves 3-10 x 0.4-0.8 cm, inflorescence 4"),
        ("ca 5 c 4 em, The", "ca 5 ca. 4 cm. The"),
        ("½ α ø Ł ā 5°", "1/2 a o L a 5 deg"),
        ("leaf5cm(6)a 2n=4 cm3", "leaf 5 cm (6) a 2n=4 cm3"),
        (None, None),
    ],
)
def test_normaliser(spark, text, want):
    assert one(spark, text, T.normalise) == want


def test_every_character_to_ascii(spark):
    assert one(spark, "Ω ﬁ é 日", T.transliterate_wide) == "O fi e 日"


def test_page_normaliser_in_plain_python(spark):
    def plain(t):
        t = re.sub(r"(?i)(?<=\s)[vy]a[vr][.,]\s?", "var. ", t)
        t = re.sub(r"(?<=\.)[ \t]+(?=\n)", "", re.sub(r"(?<=\w)-\s+", "", t, flags=re.A))
        return re.sub(r"[^\S\n]+", " ", re.sub(r"(?<![.\n])\n+", " ", t), flags=re.A)

    rows = registry.QUERIES["ocr_normalise"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in rows} == {k: plain(t) for k, t in texts.items()}
    assert one(spark, "a con-\n  cave yav, x. \nnext\nline\n\npara", T.normalise_page) == "a concave var. x.\nnext line para"


def test_paragraphs_of_html(spark):
    page = "<p>out</p><article class='x'><p>One &amp; <b>two</b><p>Unclosed<p>HEAD 1</p><div><p>In div</p></div><p>T<table><tr><td>cell</td></tr></table></p></article><p>after</p>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<article>no paragraph</article>")], "page_id long, html string")
    got = {r.page_id: r.text for r in H.paragraphs(rows, "page_id", "html", "article", "x").collect()}
    assert got == {1: "One & two\nUnclosed\nIn div", 2: None, 3: None, 4: None}
    assert all(r.text is None or r.text for r in registry.QUERIES["html_paragraphs"](spark, DATA).collect())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLE) == PLAIN


def test_terms_of_ploidy_alone_and_mixed(spark):
    df = spark.createDataFrame([(1, "2n = 4"), (1, "2n = 8"), (2, "2n = 4"), (2, "red, blue"), (3, None)], "k int, t string")
    got = {r.k: r.x for r in df.groupBy("k").agg(O.terms(F.col("t")).alias("x")).collect()}
    assert got == {1: "2n = 4| 2n = 8", 2: "blue, red", 3: ""}


def test_blanks_and_bounds_as_by_lookbehind_and_by_groups(spark):
    """The cheaper patterns put the same blanks, and find the same bounds, as those that look at each place and each group on its own."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("am2n3(), .-x19") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    conjoined = re.compile(r"(?<=[a-z])(?=[(0-9])(?!(?<=m)3)|(?<=[0-9)])(?=[a-z])(?!(?<=2)n)|(?<=[^0-9][,.])(?=\S)")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_conjoined(F.col("t")).alias("s"), N.number_range(F.col("t")).alias("r")).collect()
    assert all(r.s == conjoined.sub(" ", r.t) for r in got)
    for r in got:
        bounds = [float(x) if x else None for x in re.match(N._BOUNDS, r.t).groups()]
        if len(re.findall(N.NUMBER, r.t)) in (2, 3, 4) and "/" not in r.t:
            assert (list(r.r) if r.r else None) == (bounds if sum(x is not None for x in bounds) == len(re.findall(N.NUMBER, r.t)) else None), r.t


def test_html_batches_are_not_python_objects_at_once():
    """Of a batch of 20 MB, far less than that is ever held as Python objects."""
    import tracemalloc

    import pyarrow as pa

    pages = pa.array(["<p>" + "x" * 10_000 + "</p>", None] * 2000)
    tracemalloc.start()
    got = H._each(pages, lambda x: [p["text"] for p in H._read(x).paragraphs], pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and got.to_pylist()[:2] == [["x" * 10_000], []] and len(got) == 4000
    assert len(H._each(pages[:0], len, pa.int64())) == 0
