"""Outputs: deterministic names, results that are only written once, and one output per source beside the combined one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as O


def output_name(taxa: list[str]) -> str:
    """A slug for one name, a hash of the list for several."""
    return taxa[0].strip().lower().replace(" ", "-") if len(taxa) == 1 else hashlib.sha256("\n".join(taxa).encode()).hexdigest()


def write(df: DataFrame, path: str, kind: str = "parquet", *, force: bool = False, partition: tuple[str, ...] = ()) -> None:
    """Parquet, JSON lines, CSV with a header, text (one column), or a YAML list of records; what exists stays unless ``force``."""
    if kind == "yaml":  # JSON is a part of YAML, so a record is one line
        df, kind = df.select(F.concat(F.lit("- "), F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"})).alias("value")), "text"
    writer = df.write.mode("overwrite" if force else "ignore").partitionBy(*partition)
    writer.option("header", True).format(kind).save(path) if kind == "csv" else writer.format(kind).save(path)


def term_patterns(terms: DataFrame) -> DataFrame:
    """(label, key, by): how terms (label, term) are looked up: by lower-cased text and by lemma; a hyphenated one also word by word, by text only."""
    key = F.lower("term")
    split = F.when(F.col("term").contains("-"), F.struct(F.regexp_replace(key, "-", " - ").alias("key"), F.lit("lower").alias("by")))
    ways = F.array(F.struct(key.alias("key"), F.lit("lower").alias("by")), F.struct(O.lemma(F.col("term")).alias("key"), F.lit("lemma").alias("by")), split)
    return terms.filter("term is not null").select("label", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("label", "w.*").distinct()


def descriptions_csv(sources: list[DataFrame], path: str, *, force: bool = False) -> None:
    """All sources' (taxon, source, source_id, text) with a text, as one CSV."""
    write(O.combine(sources).filter("trim(text) <> ''"), path, "csv", force=force)


def drop_unused(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without those of the columns that hold no value at all; one pass for all of them."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    used = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).head()
    return df.drop(*(c for c in columns if not used[c]))


def write_by_source(combined: DataFrame, per_source: DataFrame, path: str, *, carried: tuple[str, ...] = ("taxon", "source", "source_id"), force: bool = False) -> None:
    """``path``/combined, and ``path``/sources with a partition for each source; rows without any value are left out.

    The columns that stay are found in what was written, not by running the plan again.
    """
    carries = lambda df: [c for c in carried if c in df.columns]
    spark = per_source.sparkSession
    write(O.drop_empty(combined, carries(combined)), f"{path}/combined", force=force)
    write(O.drop_empty(per_source, carries(per_source)), f"{path}/all", force=force)
    whole = spark.read.parquet(f"{path}/all")
    write(drop_unused(whole, ["source_id"]), f"{path}/sources", force=force, partition=("source",))
