"""Numbers, ranges, units and dimensions in text.

``lexemes`` cuts a sentence into numbers with their units, words and marks. ``parsed`` turns such lexemes, one a row, into
columns; each is computed once. ``fold_dimensions`` assigns a part's measurements to dimensions in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Metres of each unit.
UNITS = {
    "km": 1000.0, "kilometer": 1000.0, "kilometre": 1000.0,
    "m": 1.0, "meter": 1.0, "metre": 1.0,
    "cm": 0.01, "centimeter": 0.01, "centimetre": 0.01,
    "mm": 0.001, "millimeter": 0.001, "millimetre": 0.001,
    "um": 1e-6, "µm": 1e-6, "micrometer": 1e-6, "micrometre": 1e-6, "micron": 1e-6,
    "nm": 1e-9, "nanometer": 1e-9, "nanometre": 1e-9,
    "pm": 1e-12,
    "inch": 0.0254, "ft": 0.3048, "feet": 0.3048, "foot": 0.3048,
}
# Words and the dimension that they name.
DIMENSIONS = {
    "long": "LENGTH", "length": "LENGTH",
    "wide": "WIDTH", "width": "WIDTH", "breadth": "WIDTH", "across": "WIDTH", "broad": "WIDTH",
    "tall": "HEIGHT", "height": "HEIGHT", "high": "HEIGHT",
    "deep": "DEPTH", "depth": "DEPTH", "thick": "DEPTH",
    "diameter": "DIAMETER", "radius": "DIAMETER",
}
# Cubic metres of each unit of volume.
VOLUMES = {"mm3": 1e-9, "cm3": 1e-6, "m3": 1.0, "mm³": 1e-9, "cm³": 1e-6, "m³": 1.0}
DEFAULT_UNIT = "cm"
_UNIT = "|".join(sorted([*UNITS, *VOLUMES], key=lambda u: (-len(u), u)))
_DIM = "|".join(DIMENSIONS)
NUMBER = r"[0-9]+(?:\.[0-9]*)?"
_CROSS = r"(?i:\b(?:x|by)\b)"
_BOUNDS = rf"^[^0-9(]*(?:\(?\s*({NUMBER})\s*-?\s*\)\s*)?({NUMBER})?(?:\s*-?\s*({NUMBER}))?\s*-?\s*(?:\(\s*-?\s*({NUMBER}))?"


def numbers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))


def number_range(t: Column) -> Column:
    """struct(lower, from, to, upper) of ``(lower-)from-to(-upper)``: null unless every number of the text has its place.

    What stands in brackets before the inner run is its lower extreme, what stands in brackets after it the upper one, with
    or without a dash: ``0.5-1(1.5)`` and ``5-(6)`` have no lower extreme. One number alone is ``from``.
    """
    names = ("lower", "from", "to", "upper")

    def bounds(t: Column) -> Column:
        found = F.split(F.regexp_replace(t, rf"(?s){_BOUNDS}.*", "$1,$2,$3,$4"), ",")  # one match for all four; an empty text is no number
        return let(found, lambda x: F.struct(*(F.when(x[k] != "", x[k]).try_cast("double").alias(name) for k, name in enumerate(names))))  # a failing cast is slow

    def placed(x: Column) -> Column:
        b = x["bounds"]
        found = F.size(F.filter(F.array(*(b[k] for k in names)), lambda v: v.isNotNull()))
        none = F.lit(None).cast("double")
        one = F.struct(none.alias("lower"), F.coalesce(b["from"], b["lower"], b["upper"]).alias("from"), none.alias("to"), none.alias("upper"))
        return F.when(x["n"] == 1, one).when((x["n"] <= 4) & (found == x["n"]), b)

    def read(t: Column) -> Column:
        return F.when(t.rlike("[0-9]") & ~t.contains("/"), let(F.struct(bounds(t).alias("bounds"), F.regexp_count(t, F.lit(NUMBER)).alias("n")), placed))

    return let(t, read)


def least_most(r: Column) -> Column:
    """struct(min, max): over the non-zero {lower, from} and {to, upper}; a single value is both."""

    def bounds(r: Column) -> Column:
        z = lambda name: F.nullif(r[name], F.lit(0.0))
        single = r["to"].isNull() & r["upper"].isNull() & r["lower"].isNull()
        return F.struct(F.least(z("lower"), z("from")).alias("min"), F.when(single, z("from")).otherwise(F.greatest(z("to"), z("upper"))).alias("max"))

    return let(r, bounds)


def unit(t: Column) -> Column:
    """The last unit word of a text."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?s)^.*(?<![\p{{L}}])({_UNIT})(?![\p{{L}}0-9])"), F.lit(1)), F.lit(1))


def convert(value: Column, source: Column, target: Column | str = DEFAULT_UNIT) -> Column:
    """To the target unit; null where a unit is unknown, or one is of length and the other of volume."""
    to = F.lit(target) if isinstance(target, str) else F.coalesce(target, F.lit(DEFAULT_UNIT))
    lengths, volumes = (F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for table in (UNITS, VOLUMES))
    of = lambda table: F.try_element_at(table, source) / F.try_element_at(table, to)
    return value * F.coalesce(of(lengths), of(volumes))


def dimension_parts(t: Column) -> Column:
    """array(struct(text, unit)) of ``A x B`` or ``A by B``; the first takes the second's unit if it has none, never the reverse."""
    halves = F.transform(F.split(t, rf"\s*{_CROSS}\s*", 2), lambda x: F.struct(x.alias("text"), unit(x).alias("unit")))

    def both(h: Column) -> Column:
        first = F.struct(h[0]["text"].alias("text"), F.coalesce(h[0]["unit"], h[1]["unit"]).alias("unit"))
        return F.when(F.size(h) == 2, F.array(first, h[1]))

    return let(halves, both)


# ---------------------------------------------------------------- lexemes
_RANGE = rf"(?:\(\s*)?{NUMBER}(?:\s*-?\s*\)\s*{NUMBER})?(?:\s*-\s*{NUMBER})?(?:\s*-?\s*\(\s*-?\s*{NUMBER}\s*\))?"
_STOP = "and|or|to|of|in|at|by|the|a|an|is|are|with|from|on"
_PLOIDY = r"\b2n ?=[ 0-9,]*[0-9]"
_MEROUS = r"\b[0-9]+(?:-[0-9]+)?-merous\b"
_SIZED = rf"{_RANGE}\s*(?:{_UNIT})(?![\p{{L}}0-9])"
_TYPED = rf"{_SIZED}(?:\.?\s+(?:(?!(?:{_STOP})\b)[a-z]+\s+)?(?:{_DIM})\b)?"
_CROSSED = rf"{_RANGE}(?:\s*(?:{_UNIT}))?\s*\b(?:x|by)\b\s*{_SIZED}"
_WORD = r"[\p{L}]+(?:-[\p{L}]+)*"
LEXEME = rf"{_PLOIDY}|{_MEROUS}|{_CROSSED}|{_TYPED}|{_RANGE}|{_WORD}|[,.;:]"


def lexemes(t: Column) -> Column:
    """array(string) in text order: chromosome counts, merosity, ``A x B unit``, ranges with a unit and the dimension word after it (or after one word that is no stop word), other ranges, words, and marks."""
    return F.regexp_extract_all(t, F.lit(LEXEME), F.lit(0))


def is_word(lexeme: Column) -> Column:
    """Whether a lexeme is a word: all others begin with a bracket, a digit or a mark, which stand before the letters."""
    return lexeme >= "A"


def is_mark(lexeme: Column) -> Column:
    return lexeme.isin(",", ".", ";", ":")


def parsed(rows: DataFrame, text: str = "lexeme") -> DataFrame:
    """``rows`` with kind (PLOIDY, MEROSITY, DIMENSION, MEASUREMENT, CARDINAL, WORD or MARK), dim, and sizes: array(struct(text, unit, least, most)).

    DIMENSION has two sizes, MEASUREMENT and CARDINAL have one; a size without unit or bounds has null bounds. Lengths are
    in centimetres, volumes in cubic centimetres, cardinals as they are.
    """
    t = F.col(text)
    plain = F.when(t.rlike(r"^\p{L}"), "WORD").otherwise("MARK")
    kind = F.when(~t.rlike("[0-9]"), plain).when(t.rlike(rf"^{_PLOIDY}$"), "PLOIDY").when(t.rlike(rf"^{_MEROUS}$"), "MEROSITY")
    names = F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv])
    rows = rows.withColumn("kind", kind)
    to_cm = F.create_map(*[F.lit(x) for kv in ({u: v / UNITS["cm"] for u, v in UNITS.items()} | {u: v / VOLUMES["cm3"] for u, v in VOLUMES.items()}).items() for x in kv])
    own = F.array(F.struct(F.trim(t).alias("text"), unit(t).alias("unit")))
    rows = rows.withColumn("__halves", F.when(F.col("kind").isNull(), F.coalesce(F.when(t.rlike(_CROSS), dimension_parts(t)), own)))
    sized = F.exists("__halves", lambda h: h["unit"].isNotNull())
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.size("__halves") == 2, "DIMENSION").when(sized, "MEASUREMENT").otherwise("CARDINAL")))
    rows = rows.withColumn("dim", F.when(F.col("kind") == "MEASUREMENT", F.try_element_at(names, F.regexp_extract(t, rf"\b({_DIM})\b", 1))))

    plain = lambda h: F.regexp_replace(h["text"], r"\p{L}+[23³]?", " ")
    rows = rows.withColumn("__bounds", F.transform("__halves", lambda h: F.struct(least_most(number_range(plain(h))).alias("of"), F.when(F.col("kind") == "CARDINAL", 1.0).otherwise(F.try_element_at(to_cm, h["unit"])).alias("by"))))

    def size(h: Column, b: Column) -> Column:
        return F.struct(h["text"].alias("text"), h["unit"].alias("unit"), (b["of"]["min"] * b["by"]).alias("least"), (b["of"]["max"] * b["by"]).alias("most"))

    return rows.withColumn("sizes", F.zip_with("__halves", "__bounds", size)).drop("__halves", "__bounds")


_SLOTS = ("LENGTH", "WIDTH", "HEIGHT", "DEPTH", "DIAMETER")
SIZE = "struct<text:string,unit:string,least:double,most:double>"


def fold_dimensions(entities: Column) -> Column:
    """map(dimension, size) of one part's entities (array of struct(..., kind, dim, sizes)), which stand in text order.

    A DIMENSION sets length and width, whatever they hold; a typed MEASUREMENT fills its free slot; an untyped one is the length if nothing is set, the width if only the length is, and else left out. A size without unit or bounds is never stored.
    """
    empty = F.create_map().cast(f"map<string,{SIZE}>")

    def step(state: Column, e: Column) -> Column:
        free = F.when(F.size(state) == 0, "LENGTH").when((F.size(state) == 1) & F.map_contains_key(state, F.lit("LENGTH")), "WIDTH")
        slot = F.when(e["dim"].isNull(), free).when(~F.map_contains_key(state, e["dim"]), e["dim"])
        slots = F.when(e["kind"] == "DIMENSION", F.array(F.lit("LENGTH"), F.lit("WIDTH"))).otherwise(F.array(slot))
        pairs = F.zip_with(slots, e["sizes"], lambda slot, size: F.struct(slot.alias("slot"), size.cast(SIZE).alias("size")))
        held = lambda x: x["slot"].isNotNull() & x["size"]["unit"].isNotNull() & (x["size"]["least"].isNotNull() | x["size"]["most"].isNotNull())
        return F.element_at(F.transform(F.array(F.filter(pairs, held)), lambda new: F.map_concat(F.map_filter(state, lambda k, _: ~F.exists(new, lambda x: x["slot"] == k)), F.map_from_entries(new))), 1)

    return F.aggregate(entities, empty, step)


def ploidy(t: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(t, _PLOIDY, 0)), F.lit(""))


def merosity(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, _MEROUS, 0), F.lit(""))
