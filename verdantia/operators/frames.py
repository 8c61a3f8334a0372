"""Operators on whole frames: work lists, dictionaries, fields, aggregation, taxonomy, pages, splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GROUPS = ("angiosperm", "bryophyte", "pteridophyte", "gymnosperm")
# ---------------------------------------------------------------- work lists
def find_column(columns: list[str], pattern: str) -> str:
    """The one column whose name fits."""
    found = [c for c in columns if re.search(pattern, c, re.I)]
    if len(found) != 1:
        raise ValueError(f"no single column like {pattern}: {found}")
    return found[0]


def worklist(df: DataFrame, taxon: str | None = None, group: str | None = None) -> DataFrame:
    """(taxon, taxonomic_group): trimmed, groups lower-cased and known."""
    taxon = taxon or find_column(df.columns, "name|species|taxon|taxa")
    group = group or find_column(df.columns, "group")
    rows = df.select(F.trim(F.col(f"`{taxon}`")).alias("taxon"), F.lower(F.trim(F.col(f"`{group}`"))).alias("taxonomic_group"))
    return rows.filter(F.col("taxonomic_group").isin(*GROUPS) & (F.col("taxon") != "")).distinct()


def limit_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__n") <= n).drop("__n")


# ---------------------------------------------------------------- dictionaries
def part_terms(parts: DataFrame) -> DataFrame:
    """(term, part): a part, its synonyms, or without synonyms its plural; a term that is a synonym stands for its part."""
    synonyms = parts.select("part", F.explode("synonyms").alias("term"))
    plain = parts.filter("synonyms is null or size(synonyms) = 0")
    own = parts.select("part", F.col("part").alias("term")).unionByName(plain.select("part", F.concat("part", F.lit("s")).alias("term")))
    both = synonyms.withColumn("first", F.lit(0)).unionByName(own.withColumn("first", F.lit(1)))
    return both.groupBy("term").agg(F.min_by("part", F.struct("first", "part")).alias("part"))


def lemma(t: Column) -> Column:
    """A light lemma of lower-cased plurals."""
    t = F.lower(t)
    return F.when(t.rlike("ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("(ss|us|is)$"), t).when(t.rlike("(x|ch|sh|s)es$"), F.regexp_replace(t, "es$", "")).otherwise(F.regexp_replace(t, "s$", ""))


def trait_keys(traits: DataFrame) -> DataFrame:
    """(key, term, character, trait, trait_part): a row for each distinct key of term and character, so that the four-way alternative of a match is an equi-join."""
    rows = traits.select("term", "character", "trait", F.col("part").alias("trait_part"))
    return rows.select("*", F.explode(F.array_distinct(F.array(F.lower("term"), F.lower("character")))).alias("key")).distinct()


def part_fits(part: Column, trait_part: Column) -> Column:
    """A trait of the plant, or of no part, is one of the sentence's plant; else the parts are the same, or both unknown."""
    plant = (part == "plant") & (trait_part.isNull() | (trait_part == "plant"))
    return F.coalesce(plant | ((part != "plant") & (part == trait_part)) | (part.isNull() & trait_part.isNull()), F.lit(False))


def dictionary_join(entities: DataFrame, traits: DataFrame, group: str | None = None) -> DataFrame:
    """Entities (id, text, part, is_part) with the dictionary rows whose term or character is their lower-cased text or lemma, and whose part fits; an entity that is a part itself fits any."""
    keys = trait_keys(traits if group is None else traits.filter(F.col("group") == group))
    own = entities.select("*", F.explode(F.array_distinct(F.array(F.lower("text"), lemma(F.col("text"))))).alias("key"))
    found = own.join(keys, "key").drop("key")  # Spark broadcasts the dictionary if its size allows it
    return found.filter(F.col("is_part") | part_fits(F.col("part"), F.col("trait_part"))).distinct()


# ---------------------------------------------------------------- fields
def project_template(df: DataFrame, template: dict[str, str | list[str] | None], carried: list[str]) -> DataFrame:
    """The template's columns in order: the same name, one field, or the first non-empty of several."""
    columns = []
    for name, source in template.items():
        fields = [name] if source is None else [source] if isinstance(source, str) else source
        known = [F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields if f in df.columns]
        columns.append((F.coalesce(*known) if known else F.lit(None).cast("string")).alias(name))
    return df.select(*carried, *columns)


def scope(entities: Column, foreign: Column) -> Column:
    """With several measurements and a foreign part, only those before the first of these."""
    return F.when((F.size(entities) > 1) & (F.size(foreign) > 0), F.filter(entities, lambda e: e["pos"] < F.array_min(foreign))).otherwise(entities)


# ---------------------------------------------------------------- aggregation, chosen by type and name
MEASURED = r"^[0-9.]+\s[a-z]+"


def terms(c: Column) -> Column:
    """All comma-separated terms, distinct and sorted; with 2n values alone, those joined by bars; with others besides, without them.

    A group keeps its distinct values, not its rows.
    """

    def joined(values: Column) -> Column:
        plain = F.filter(values, lambda x: ~x.startswith("2n"))
        split = F.array_sort(F.array_distinct(F.flatten(F.transform(plain, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))))
        return F.when((F.size(plain) == 0) & (F.size(values) > 0), F.array_join(F.array_sort(values), "| ")).otherwise(F.array_join(split, ", "))

    return T.let(F.collect_set(F.when(F.trim(c) != "", c)), joined)


def without_halves(terms: Column) -> Column:
    """Of an array of terms, those but ``a/b`` where ``a`` or ``b`` is there as well."""
    return F.filter(terms, lambda t: ~t.contains("/") | ~F.arrays_overlap(F.split(t, "/"), terms))


def measurement_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The text columns of which any value begins with a number, a blank and a unit; one pass for all of them."""
    texts = [n for n, kind in df.dtypes if kind == "string" and n not in skip]
    if not texts:
        return ()
    found = df.agg(*(F.bool_or(F.col(f"`{n}`").rlike(MEASURED)).alias(n) for n in texts)).head()
    return tuple(n for n in texts if found[n])


def num_range(c: Column) -> Column:
    return F.when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise(F.concat_ws("-", F.min(c), F.max(c)))


def measured(c: Column, name: str, order: Column) -> Column:
    """Of "value unit" texts: least, most or mean value, and the first row's unit."""
    value = F.regexp_extract(c, r"^([0-9.]+)", 1).try_cast("double")
    one = F.min(value) if "min" in name else F.max(value) if "max" in name else F.avg(value)
    unit = F.min_by(F.regexp_extract(c, r"^[0-9.]+ ([a-z]+)", 1), F.when(c.isNotNull(), order))
    return F.concat_ws(" ", F.round(one, 2).cast("decimal(18,2)").cast("string"), unit)


def aggregate_by_type(df: DataFrame, key: str, order: str, measured_columns: tuple[str, ...] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """One pass over the groups; numeric columns take min, max or range by their name, measured ones likewise, all others their terms.

    ``measured_columns``: text columns of numbers with a unit; if not given, they are found by their values.
    """
    if measured_columns is None:
        measured_columns = measurement_columns(df, (key, order, *skip))
    out = []
    for name, kind in df.dtypes:
        if name in (key, order, *skip):
            continue
        c = F.col(f"`{name}`")
        if kind in ("int", "bigint", "double", "float", "smallint") or kind.startswith("decimal"):
            value = F.min(c) if "min" in name else F.max(c) if "max" in name else num_range(c)
        else:
            value = measured(c, name, F.col(order)) if name in measured_columns else terms(c)
        out.append(value.alias(name))
    return df.groupBy(key).agg(*out)


def drop_empty(df: DataFrame, carried: list[str]) -> DataFrame:
    return df.na.drop(how="all", subset=[c for c in df.columns if c not in carried])


def combine(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- taxonomy
def synonyms(names: DataFrame, flora: DataFrame) -> DataFrame:
    """(taxon, synonym), one hop: an accepted name has the species whose accepted id is its own; a synonym has its accepted name and that one's synonyms; unknown and ambiguous names have none."""
    one = flora.groupBy("scientificName").agg(F.count("*").alias("n"), F.first("taxonID").alias("id"), F.first("acceptedNameUsageID").alias("accepted"), F.first("taxonomicStatus").alias("status"))
    known = names.join(one.filter("n = 1"), names.taxon == F.col("scientificName")).filter("status = 'ACCEPTED' or status like '%SYNONYM'")
    root = known.select("taxon", F.when(F.col("status") == "ACCEPTED", F.col("id")).otherwise(F.col("accepted")).alias("root"), (F.col("status") != "ACCEPTED").alias("synonym_itself"))
    others = flora.filter("taxonRank = 'SPECIES'").select(F.col("acceptedNameUsageID").alias("root"), F.col("scientificName").alias("synonym"))
    accepted = flora.select(F.col("taxonID").alias("root"), F.col("scientificName").alias("synonym"))
    both = root.join(others, "root").select("taxon", "synonym").unionByName(root.filter("synonym_itself").join(accepted, "root").select("taxon", "synonym"))
    return both.filter("taxon <> synonym").distinct()


def name_variants(names: DataFrame, synonym_pairs: DataFrame) -> DataFrame:
    """(taxon, variant): the name, its synonyms, and "G. epithet" forms unless one of them is a single word."""
    full = names.select("taxon", F.col("taxon").alias("variant")).unionByName(synonym_pairs.select("taxon", F.col("synonym").alias("variant"))).distinct()
    single = full.groupBy("taxon").agg(F.bool_or(~F.col("variant").contains(" ")).alias("single"))
    short = full.join(single, "taxon").filter("not single").select("taxon", F.concat(F.substring("variant", 1, 1), F.lit(". "), F.regexp_extract("variant", r"^\S+\s+(.*)$", 1)).alias("variant"))
    return full.unionByName(short).distinct()


def pages_of(names: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows of any of the names (a semi-join)."""
    return index.join(names, index.name_confirmed == names.name, "left_semi")


def taxa_of_groups(work: DataFrame) -> DataFrame:
    """(taxonomic_group, taxa, n): the distinct names of each group."""
    return work.groupBy("taxonomic_group").agg(F.array_sort(F.collect_set("taxon")).alias("taxa"), F.count_distinct("taxon").alias("n"))


def first_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """``first`` in front, each column once."""
    return df.select(*(f"`{c}`" for c in dict.fromkeys([*first, *df.columns])))


def flattened(df: DataFrame) -> DataFrame:
    """Fields of nested structs as columns with dotted names."""

    def leaves(kind, path: list[str]):
        for f in kind.fields:
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(".".join([*path, f.name]))

    return df.select(*leaves(df.schema, []))


def enabled(sources: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """The union of the sources that the settings name, in any case, each with a ``source`` column."""
    known = {k.lower(): v for k, v in sources.items()}
    missing = [w for w in wanted if w.lower() not in known]
    if missing:
        raise ValueError(f"no such source: {', '.join(missing)}")
    return combine([known[w.lower()].withColumn("source", F.lit(w.lower())) for w in wanted])


def containing(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text holds one of the words, in any case."""
    return df.filter(F.col(column).rlike("(?i)" + "|".join(re.escape(w) for w in words)))


def last_value(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, n): of each key the value that came last, and how many there were."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))
