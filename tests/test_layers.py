"""The library stands without its training-data part, and nothing of it is imported from there."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent / "verdantia"


def test_nothing_imports_the_training_data_operators():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_expressions_repeat_nothing(spark):
    """A value that is used twice is bound once, so the plan of a chain grows by its steps and not by their product."""
    from pyspark.sql import functions as F

    from verdantia.functions import numeric, text

    df = spark.createDataFrame([("Lvs 3-4 cm",)], "t string")
    size = lambda c: len(df.select(c)._jdf.queryExecution().analyzed().toString())
    assert size(text.normalise(F.col("t"))) < 12_000
    assert size(numeric.least_most(numeric.number_range(text.normalise(F.col("t"))))) < size(text.normalise(F.col("t"))) * 3 + 4000
