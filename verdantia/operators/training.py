"""Training sets for the recognisers: labels, checks of spans, splits with exact shares, reports.

Defined cases: rows with a null text or label are left out of training sets; equal keys are split alike; empty tables give
empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BUCKETS = 1 << 12


def stratified(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """A ``split`` column with exact shares of each label, in order of a hash of the key.

    A row's place among its label's is its place in its bucket of the hash, and the rows of the buckets before, counted
    ahead; so a label with most rows of the table is ranked by many tasks.
    """
    hashed = df.withColumn("__h", F.pmod((F.col(key) + seed) * 2654435761, F.lit(1 << 32)))
    hashed = hashed.withColumn("__b", F.shiftright("__h", 32 - (buckets - 1).bit_length()).cast("int"))
    counts = hashed.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    per = Window.partitionBy(label)
    before = counts.select(F.col(label).alias("__l"), F.col("__b").alias("__c"), (F.sum("__n").over(per.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(per).alias("__all"))
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    placed = hashed.withColumn("__r", rank).join(before, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    place, out, at = (F.col("__r") + F.col("__before")) / F.col("__all"), F.lit(None).cast("string"), 0.0
    steps = []
    for name, share in shares.items():
        at += share
        steps.append((name, at))
    for name, upto in reversed(steps):
        out = F.when(place <= upto + 1e-12, F.lit(name)).otherwise(out)
    return placed.select(*(f"`{c}`" for c in df.columns), out.alias("split"))


def span_label(entities: Column) -> Column:
    """The label of a text's spans: theirs if it is one, MULTI if there are several, null without any."""
    labels = F.array_distinct(F.transform(entities, lambda e: e["label"]))
    return F.when(F.size(labels) == 1, labels[0]).when(F.size(labels) > 1, "MULTI")


def aligned(text: Column, entities: Column) -> Column:
    """The spans (start, end, label) that begin and end where words do."""

    def fits(e: Column) -> Column:
        word = lambda at: F.substr(text, at, F.lit(1)).rlike(r"^[\p{L}\p{N}_]$")
        starts = (e["start"] == 0) | ~(word(e["start"]) & word(e["start"] + 1))
        return starts & ~(word(e["end"]) & word(e["end"] + 1)) & (e["end"] > e["start"]) & (e["end"] <= F.length(text))

    return F.filter(entities, fits)


def binary_labels(df: DataFrame, label: str, name: str) -> DataFrame:
    """A classifier's two complementary labels from 0 and 1."""
    return df.filter(F.col(label).isNotNull()).withColumn(name, F.col(label).cast("double")).withColumn(f"not_{name}", 1 - F.col(label).cast("double"))


def prepared(df: DataFrame, text: str, label: str, longest: int = 512) -> DataFrame:
    """(text, labels, tokens): renamed, typed, without nulls, cut to ``longest`` tokens, which is the model's limit."""
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("long").alias("labels")).na.drop()
    return rows.withColumn("tokens", F.slice(T.words(F.col("text")), 1, longest))


def balanced(t: Column) -> Column:
    """As many brackets opened as closed."""
    return F.length(t) - F.length(F.replace(t, F.lit("("), F.lit(""))) == F.length(t) - F.length(F.replace(t, F.lit(")"), F.lit("")))


def numeric_examples(sentences: DataFrame, text: str = "sentence") -> DataFrame:
    """Sentences fit to train the numbers' recogniser: with a number, balanced brackets and no chromosome count; each once."""
    t = F.col(text)
    return sentences.filter(t.rlike("[0-9]") & balanced(t) & ~t.rlike(r"\b2n\b|2n *=")).dropDuplicates([text])


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def distinct_terms(traits: DataFrame, kind: str | None = None) -> DataFrame:
    """(term): terms and characters of the dictionary, or of one type of it."""
    rows = traits if kind is None else traits.filter(F.col("type") == kind)
    return rows.select(F.explode(F.array("term", "character")).alias("term")).filter("term is not null").distinct()


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)"""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label that is a truth or a guess; a ratio without cases is 0."""
    counts = confusion(df, truth, guess)
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    each = counts.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), hit.cast("long").alias("h")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("guessed"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rates = sums.select("label", ratio("hits", "guessed").alias("precision"), ratio("hits", "support").alias("recall"), "support")
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return rates.select("label", "precision", "recall", f1.alias("f1"), "support")
