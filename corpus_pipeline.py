"""The corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, byte-level BPE.

Each stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``:

1. ``quality``: rows that the standard policy of the quality rules rejects go;
2. ``near_duplicates``: of each component of texts with 80 % of their 5-word shingles in common, one row of the smallest doc_id stays;
3. ``repeated_passages``: bytes that a repeated 200-byte string covers go from the texts (a character that loses a part goes
   whole; n_chars follows the text); no row goes, texts may become empty;
4. ``decontamination``: rows with a benchmark window go;
5. ``encoding``: doc_id, n_tokens, ids_sha256, decoded_sha256 of the byte-level BPE ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantia.llm import byte_bpe, decontaminate, jaccard_join, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a rule of the standard policy go; null and empty texts fail for want of words; equal rows fare alike; an empty table stays empty."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component stays: of the smallest doc_id, a null one last; of equal rows one. Null and empty texts are linked with nothing and stay; an empty table stays empty."""
    return jaccard_join.deduplicate(docs, width=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; a null text stays null, a text all of whose bytes repeat becomes empty; equal rows repeat each other; an empty table stays empty."""
    cut = suffix_dedup.remove_repeats(docs, out="__repeats", words=True)
    text = F.when(F.col("text").isNull(), None).when(F.col("__repeats.n_removed") == 0, F.col("text")).otherwise(F.col("__repeats.kept"))
    cut = cut.withColumn("text", text).drop("__repeats")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with any word inside a benchmark window go; null and empty texts have none; an empty benchmark or table changes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, in no order; null and empty texts have no ids; an empty table gives an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, path), path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express BPE; tests compare the whole chain with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and reread."""
    from verdantia.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
