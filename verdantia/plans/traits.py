"""From descriptions to fields: what a text says of a taxon's parts, one observation a row; then one row a taxon by a template.

Every step is a plain column of a frame, computed once: sentences, their lexemes, word runs looked up in the vocabulary by an
equi-join, one grouping by sentence (which part it speaks of), one by description (which size is a part's length). Nothing
is kept between rows, so batches and streams share it.

Defined cases: null and empty texts have no observations; repeated descriptions of one taxon and source count once; sizes in
sentences without a part are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import frames as O

COUNTED = 3  # lexemes after a bare number within which its part or trait stands
TASKS = 48  # at least, unless the session asks for fewer; each task compiles its projections anew, which takes as long as some hundred rows
SENT = 8 << 20  # bytes of parts and dictionary up to which they are sent to every task; larger ones are joined by their keys
_ENTITY = "struct<pos:int,n:int,label:string,text:string,lemma:string,part:string,dim:string,sizes:array<" + N.SIZE + ">>"


def vocabulary(parts: dict[str, str], traits: DataFrame) -> DataFrame:
    """(key, label, part): terms of parts, and terms and characters of the dictionary (COLOUR if its type is colour, else TRAIT)."""
    spark = traits.sparkSession
    own = spark.createDataFrame([(t.lower(), p) for t, p in parts.items()] or [], "key string, part string").select("key", F.lit("PART").alias("label"), "part")
    label = F.when(F.col("type") == "colour", "COLOUR").otherwise("TRAIT") if "type" in traits.columns else F.lit("TRAIT")
    terms = traits.select(F.explode(F.array_distinct(F.array(F.lower("term"), F.lower("character")))).alias("key"), label.alias("label"), F.lit(None).cast("string").alias("part"))
    return own.unionByName(terms).filter("key is not null").distinct()


def extent(parts: dict[str, str], traits: DataFrame) -> tuple[int, int]:
    """The most words of a term, and the bytes of all terms, in one pass over the dictionary."""
    words = lambda c: F.coalesce(F.size(F.split(c, " ")), F.lit(0))
    size = F.octet_length(F.concat_ws(" ", "term", "character", "trait", "part"))
    found = traits.agg(F.max(F.greatest(words(F.col("term")), words(F.col("character")))).alias("n"), F.sum(size + 64).alias("bytes")).head()
    return max([1, found.n or 0, *(len(t.split(" ")) for t in parts)]), (found.bytes or 0) + sum(len(t.encode()) + 64 for t in parts)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows by their keys over all tasks, however few parts the input is read in; groupings by these keys and more need no other exchange."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS))
    return rows.repartition(tasks, *keys).distinct()


def _runs(lexemes: Column, longest: int) -> Column:
    """Numbers, and runs of up to ``longest`` words: array(struct(pos, n, text, next)), as a hyphenated word is one lexeme."""

    def at(x: Column, i: Column) -> Column:
        run = lambda n: F.struct(i.alias("pos"), n.alias("n"), F.when(n == 1, x).otherwise(F.array_join(F.slice(lexemes, i + 1, n), " ")).alias("text"), F.try_element_at(lexemes, i + n + 1).alias("next"))
        words = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(lexemes) - i)), run), lambda g: (g["n"] == 1) | ~g["text"].rlike("[0-9,.;:]"))
        number = F.array(F.struct(i.alias("pos"), F.lit(1).alias("n"), x.alias("text"), F.lit(None).cast("string").alias("next")))
        return F.when(N.is_word(x), words).when(~N.is_mark(x), number).otherwise(F.array())

    return F.flatten(F.transform(lexemes, at))


def entities(sentences: DataFrame, keys: list[str], words: DataFrame, longest: int) -> DataFrame:
    """(keys, stop, e): the sentence's numbers, and the word runs that the vocabulary knows by their lower-cased text or lemma. stop: place of the first number or mark."""
    cut = sentences.withColumn("lexemes", N.lexemes(F.col("sentence")))
    first = F.array_position(F.transform("lexemes", lambda x: ~N.is_word(x)), True).cast("int")
    cut = cut.withColumn("stop", T.let(first, lambda n: F.when(n > 0, n - 1).otherwise(F.size("lexemes"))))
    rows = cut.withColumn("x", F.explode(_runs(F.col("lexemes"), longest))).select(*keys, "stop", "x.*")
    rows = N.parsed(rows, "text")
    rows = rows.withColumn("lemma", F.when(F.col("kind") == "WORD", O.lemma(F.col("text"))))
    # A figure has no keys, as a filter behind the join would be pushed below all that is computed here and compute it twice.
    figure = (F.col("lemma") == "fig") & (F.coalesce("next", F.lit("")) == ".")
    keyed = F.when(figure, F.array().cast("array<string>")).when(F.col("kind") == "WORD", F.array_distinct(F.array(F.lower("text"), "lemma"))).otherwise(F.array(F.lit(None).cast("string")))
    known = rows.withColumn("key", F.explode(keyed)).join(words, "key", "left").filter((F.col("kind") != "WORD") | F.col("label").isNotNull())
    e = F.struct("pos", "n", F.coalesce("label", "kind").alias("label"), F.lower("text").alias("text"), "lemma", "part", "dim", "sizes").cast(_ENTITY)
    return known.select(*keys, "stop", e.alias("e"))


def without_overlaps(found: Column) -> Column:
    """Entities in text order: where word runs overlap, parts come first, then the longest, then the earliest."""
    ranked = F.array_sort(F.transform(found, lambda e: F.struct(F.when(e["label"].isin("TRAIT", "COLOUR"), 1).otherwise(0).alias("rank"), (-e["n"]).alias("short"), e["pos"].alias("pos"), e["label"].alias("label"), e.alias("e"))))

    def add(kept: Column, r: Column) -> Column:
        # A run may be a trait and a colour, which are two entities of one place.
        meets = F.exists(kept, lambda k: (k["pos"] < r["e"]["pos"] + r["e"]["n"]) & (r["e"]["pos"] < k["pos"] + k["n"]) & ~((k["pos"] == r["e"]["pos"]) & (k["n"] == r["e"]["n"]) & (k["label"] != r["e"]["label"]) & (k["label"] != "PART")))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(r["e"])))

    return F.array_sort(F.aggregate(ranked, F.array().cast(f"array<{_ENTITY}>"), add))


def subject(parts: Column, stop: Column, idx: Column) -> Column:
    """The first part before the sentence's first number or mark; without one, ``plant`` in the first sentence."""
    first = F.try_element_at(parts, F.lit(1))
    return F.when(first["pos"] < stop, first["part"]).otherwise(F.when(idx == 0, F.lit("plant")))


def observations(descriptions: DataFrame, parts: dict[str, str], traits: DataFrame | None = None, carried: tuple[str, ...] = ("taxon", "source", "source_id"), group: str | None = None) -> DataFrame:
    """(carried, description, idx, part, field, least, most, value) of every description.

    Sizes (``leaf measurement.length``) are in centimetres, volumes in cubic centimetres; counts are ``stamen number``; ``petal colour``,
    ``ploidy``, ``merosity`` and dictionary traits have values. ``description``: a hash of the text, so that several of one taxon and source stay
    apart. ``parts``: term -> part, a configuration file's few hundred rows. ``traits``: (term, character, trait, part, and
    maybe type and group): field ``trait`` gets the value ``character``. Columns of ``carried`` that are not there are left out.
    """
    spark = descriptions.sparkSession
    carried = tuple(c for c in carried if c in descriptions.columns)
    if traits is None:
        traits = spark.createDataFrame([], "term string, character string, trait string, part string")
    longest, size = extent(parts, traits)
    sent = F.broadcast if size <= SENT else lambda table: table
    words = sent(vocabulary(parts, traits))
    keys = [*carried, "description", "idx"]
    dealt = _dealt(descriptions.select(*carried, F.xxhash64("text").alias("description"), F.col("text").alias("__text")), keys[:-1])
    described = dealt.withColumn("__text", T.normalise(F.col("__text")))
    split = described.select(*carried, "description", F.posexplode(T.sentences(F.col("__text"))).alias("idx", "sentence"))

    said = entities(split, keys, words, longest).groupBy(*keys, "stop").agg(F.collect_set("e").alias("found"))
    said = said.withColumn("found", without_overlaps(F.col("found")))
    of = lambda *labels: F.filter("found", lambda e: e["label"].isin(*labels))
    said = said.withColumn("parts", of("PART")).withColumn("part", subject(F.col("parts"), F.col("stop"), F.col("idx")))
    foreign = F.transform(F.filter("parts", lambda e: e["part"] != F.col("part")), lambda e: e["pos"])
    said = said.withColumn("sizes", F.when(F.col("part").isNotNull(), O.scope(of("DIMENSION", "MEASUREMENT"), foreign)))
    said = said.withColumn("values", F.concat(_colours(of("COLOUR")), _stated(of("PLOIDY", "MEROSITY")), _traits(of("TRAIT")), _counts(of("CARDINAL"), of("PART", "TRAIT"))))

    size = F.transform("sizes", lambda e: F.struct(F.col("part").alias("part"), F.col("idx").alias("idx"), e["pos"].alias("pos"), e["label"].alias("kind"), e["dim"].alias("dim"), e["sizes"].alias("sizes")))
    value = F.transform("values", lambda v: F.struct(F.col("part").alias("part"), F.col("idx").alias("idx"), *(v[c].alias(c) for c in ("pos", "field", "least", "most", "value", "text", "lemma"))))
    per = said.select(*keys, F.coalesce(size, F.array()).alias("size"), value.alias("value"))
    whole = per.groupBy(*keys[:-1]).agg(F.flatten(F.collect_set("size")).alias("size"), F.flatten(F.collect_set("value")).alias("value"))
    whole = whole.withColumn("size", F.array_sort("size"))
    each = F.transform(F.array_distinct(F.transform("size", lambda s: s["part"])), lambda p: F.struct(p.alias("part"), N.fold_dimensions(F.filter("size", lambda s: s["part"] == p)).alias("held")))
    whole = whole.withColumn("each", each)
    none, double = F.lit(None).cast("string"), F.lit(None).cast("int")
    sized = F.flatten(F.transform("each", lambda x: F.transform(F.map_entries(x["held"]), lambda m: F.struct(x["part"].alias("part"), double.alias("idx"), F.concat(x["part"], F.lit(" measurement."), F.lower(m["key"])).alias("field"), m["value"]["least"].alias("least"), m["value"]["most"].alias("most"), none.alias("value"), none.alias("text"), none.alias("lemma")))))
    stated = F.transform(_last_counts(F.col("value")), lambda v: F.struct(*(v[c].alias(c) for c in ("part", "idx", "field", "least", "most", "value", "text", "lemma"))))
    rows = whole.select(*keys[:-1], F.explode(F.concat(sized, stated)).alias("o")).select(*keys[:-1], "o.*")
    return _looked_up(rows, sent(O.trait_keys(discrete(traits, group))), keys[:-1])


_VALUE = ("pos", "field", "least", "most", "value", "text", "lemma")


def _value(pos: Column, field: Column, **given: Column) -> Column:
    kinds = {"least": "double", "most": "double", "value": "string", "text": "string", "lemma": "string"}
    return F.struct(pos.alias("pos"), field.cast("string").alias("field"), *(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _colours(found: Column) -> Column:
    """``part colour``, in sentences with a part only."""
    return F.when(F.col("part").isNull(), F.array()).otherwise(F.transform(found, lambda e: _value(e["pos"], F.concat(F.col("part"), F.lit(" colour")), value=e["lemma"])))


def _stated(found: Column) -> Column:
    """Chromosome numbers and merosity: the label is the field."""
    return F.transform(found, lambda e: _value(e["pos"], F.lower(e["label"]), value=F.trim(e["text"])))


def _traits(found: Column) -> Column:
    """To be looked up in the dictionary: no field yet."""
    return F.transform(found, lambda e: _value(e["pos"], F.lit(None), text=e["text"], lemma=e["lemma"]))


def _counts(found: Column, named: Column) -> Column:
    """``part number`` (or ``trait number``) of each bare number with a part or trait right behind it."""

    def count(e: Column) -> Column:
        near = F.array_sort(F.filter(named, lambda p: (p["pos"] > e["pos"]) & (p["pos"] <= e["pos"] + COUNTED)))
        name = F.try_element_at(F.transform(near, lambda p: F.coalesce(p["part"], p["lemma"])), F.lit(1))
        return _value(e["pos"], F.concat(name, F.lit(" number")), least=e["sizes"][0]["least"], most=e["sizes"][0]["most"])

    return F.filter(F.transform(found, count), lambda v: v["field"].isNotNull() & (v["least"].isNotNull() | v["most"].isNotNull()))


def _last_counts(values: Column) -> Column:
    """Of the counts of one field, the last one of the description; all other values."""
    return F.filter(values, lambda v: v["least"].isNull() & v["most"].isNull() | ~F.exists(values, lambda w: (w["field"] == v["field"]) & (w["least"].isNotNull() | w["most"].isNotNull()) & (F.struct(w["idx"], w["pos"]) > F.struct(v["idx"], v["pos"]))))


def discrete(traits: DataFrame, group: str | None) -> DataFrame:
    """The dictionary's rows that are no colours, of a taxonomic group if one is given."""
    if "type" in traits.columns:
        traits = traits.filter("type is null or type <> 'colour'")
    return traits if group is None or "group" not in traits.columns else traits.filter(F.col("group") == group)


def _looked_up(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a dictionary text become the traits that fit it and its part; the others stay."""
    key = F.explode(F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.array("text", "lemma"))))
    found = rows.withColumn("key", key).join(named, "key", "left")
    found = found.filter(F.col("text").isNull() | (F.col("trait").isNotNull() & O.part_fits(F.col("part"), F.col("trait_part"))))
    out = found.select(*keys, "idx", "part", F.coalesce("field", "trait").alias("field"), "least", "most", F.coalesce("value", F.when(F.col("text").isNotNull(), F.col("character"))).alias("value"))
    return out.distinct()


# ---------------------------------------------------------------- summaries
def _values(c: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))


def summary(observed: DataFrame, keys: tuple[str, ...] = ("taxon",)) -> DataFrame:
    """One row for each key and field: the bounds, and the distinct values, sorted."""
    return observed.groupBy(*keys, "field").agg(F.min(F.when(F.col("least") > 0, F.col("least"))).alias("least"), F.max("most").alias("most"), _values(F.col("value")).alias("value"))


def template_units(template: dict[str, str | list[str] | None]) -> dict[str, str]:
    """field -> unit, from ``[unit]`` in the template's column names; the last column of a field wins."""
    out = {}
    for name, source in template.items():
        if unit := re.search(r"\[([a-z³]+)\]", name):
            out |= {f.split(".")[0]: unit[1] for f in ([source] if isinstance(source, str) else source or [name])}
    return out


def by_template(observed: DataFrame, template: dict[str, str | list[str] | None], keys: tuple[str, ...] = ("taxon",), *, units: bool = False) -> DataFrame:
    """One row for each key with the template's columns, in one grouping.

    A column takes its first field with a value: its own name if the template names none; ``.min`` and ``.max`` of a field are its
    bounds, in the template's unit for the field (``units``: with that unit behind the number), else in centimetres.
    """
    unit_of, out = template_units(template), []
    for name, source in template.items():
        fields = []
        for wanted in [source] if isinstance(source, str) else source or [name]:
            field, _, bound = wanted.rpartition(".")
            if bound in ("min", "max"):
                own = F.col("field") == field
                value = F.min(F.when(own & (F.col("least") > 0), F.col("least"))) if bound == "min" else F.max(F.when(own, F.col("most")))
                if " measurement" in field:
                    unit = unit_of.get(field.split(".")[0], N.DEFAULT_UNIT)
                    source_unit = "cm3" if unit in N.VOLUMES else N.DEFAULT_UNIT
                    value = F.round(N.convert(value, F.lit(source_unit), unit), 4)
                    value = F.concat_ws(" ", value.cast("string"), F.when(value.isNotNull(), unit)) if units else value.cast("string")
                    fields.append(F.nullif(value, F.lit("")))
                else:
                    fields.append(value.cast("string"))
            else:
                fields.append(_values(F.when(F.col("field") == wanted, F.col("value"))))
        out.append(F.coalesce(*fields).alias(name))
    return observed.groupBy(*keys).agg(*out)
