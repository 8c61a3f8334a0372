"""Tables from files by suffix, maps from JSON, names given inline, and pages of an archive of text files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, JSON records, JSON lines, Parquet or a workbook's first sheet; another suffix is an error."""
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if suffix == ".json":
        return reader.json(path, multiLine=True)
    if suffix in (".jsonl", ".ndjson"):
        return reader.json(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix in (".xlsx", ".xls"):
        return _workbook(spark, path, schema)
    raise ValueError(f"no reader for files like {path}")


def _workbook(spark: SparkSession, path: str, schema) -> DataFrame:
    """All cells as text unless a schema is given. A workbook is read on the driver: it has at most 1,048,576 rows a sheet."""
    import io

    import pandas as pd

    content = spark.read.format("binaryFile").load(path).select("content").head()
    try:
        cells = pd.read_excel(io.BytesIO(bytes(content.content)), dtype=str if schema is None else None)
    except ImportError as missing:
        raise ValueError(f"reading {path} needs the package {missing.name or 'openpyxl'}") from missing
    return spark.createDataFrame(cells.astype(object).where(cells.notna(), None), schema or ", ".join(f"`{c}` string" for c in cells.columns))


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """One row for each entry of a JSON object of texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def inline_taxa(spark: SparkSession, taxa: list[str], group: str) -> DataFrame:
    """(taxon, taxonomic_group) of names given by hand, each once."""
    return spark.createDataFrame([(t,) for t in dict.fromkeys(x.strip() for x in taxa) if t], "taxon string").withColumn("taxonomic_group", F.lit(group))


def read_settings(path: str) -> dict:
    """A configuration file on the driver: YAML (of which JSON is a part)."""
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            import json

            return json.load(file)
        try:
            import yaml
        except ImportError as missing:
            raise ValueError(f"reading {path} needs the package PyYAML") from missing
        return yaml.safe_load(file)


def read_jsonl_terms(spark: SparkSession, path: str) -> DataFrame:
    """(label, term) of a JSON-lines file of patterns: a pattern of several tokens is their words with blanks between."""
    rows = spark.read.schema("label string, pattern array<map<string,string>>").json(path)
    return rows.select("label", F.array_join(F.transform("pattern", lambda t: F.map_values(t)[0]), " ").alias("term"))


def archive_pages(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """``index`` (page_id, item_id, sequence_order, ...) with ``text``: the page's file under ``root``, empty if there is none.

    Only folders of items that the index names are listed, and only pages that it names are read.
    """
    keyed = index.withColumn("__key", T.archive_key(F.col("page_id"), F.col("item_id"), F.col("sequence_order")))
    base = root.rstrip("/")
    folders = [r.f for r in keyed.select(F.regexp_extract("__key", r"^(.*)/[^/]*$", 1).alias("f")).distinct().toLocalIterator()]
    found = _listed(spark, base, folders)
    if found is None:
        return keyed.drop("__key").withColumn("text", F.lit(""))
    files = found.withColumn("__key", F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)\.txt$", 1)).select("__key", F.decode("content", "UTF-8").alias("text"))
    return keyed.join(files, "__key", "left").drop("__key").withColumn("text", F.coalesce("text", F.lit("")))


def _listed(spark: SparkSession, base: str, folders: list[str]) -> DataFrame | None:
    """The text files of those of the folders that exist; None without any. The paths (some 60 bytes a scanned volume) are all that the driver holds."""
    if not folders:
        return None
    prefixes: dict[str, list[str]] = {}
    for f in folders:
        prefixes.setdefault(f.split("/")[0], []).append(f.split("/", 1)[1])
    globs = [f"{base}/{prefix}/{{{','.join(sorted(set(items)))}}}" for prefix, items in sorted(prefixes.items())]
    out = None
    for glob in globs:
        try:
            part = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(glob).select("path", "content")
        except AnalysisException:  # no such folder
            continue
        out = part if out is None else out.unionByName(part)
    return out
