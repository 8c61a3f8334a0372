"""Text functions: Column in, Column out. All but the wide transliteration are built-in expressions.

Deliberate difference from a mutate-while-matching rewriter: matches are replaced where they stand (no offset drift).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "lf": "leaf",
    "lvs": "leaves",
    "lfless": "leafless",
    "fl": "flower",
    "fls": "flowers",
    "flrs": "flowers",
    "fld": "flowered",
    "fr": "fruit",
    "frt": "fruit",
    "frts": "fruits",
    "sds": "seeds",
    "fil": "filaments",
    "pet": "petals",
    "infl": "inflorescence",
    "inf": "inflorescence",
    "lflets": "leaflets",
    "lflet": "leaflet",
    "lfy": "leafy",
    "lngth": "length",
    "diam": "diameter",
}

def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rewrite(t: Column, pattern: str, value) -> Column:
    """Every match of the pattern replaced, where it stands, by ``value`` of it. Texts without a match are not cut."""

    def run(x: Column) -> Column:
        rest, found = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        replaced = F.array_join(F.zip_with(rest, F.transform(found, value), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(x.rlike(pattern), replaced).otherwise(x)

    return let(t, run)


# ---------------------------------------------------------------- to ASCII
#: Signs that no rule below derives.
_SIGNS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "×": "x", "÷": "/", "±": "+-", "°": "deg", "µ": "u", "μ": "u",
    "–": "-", "—": "-", "‐": "-", "‑": "-", "‒": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"', "•": "*", "≤": "<=", "≥": ">=", "≈": "~",
}
_GREEK = {"THETA": "th", "PHI": "ph", "CHI": "kh", "PSI": "ps"}


def ascii_of(c: str) -> str | None:
    """What a character is written as in ASCII: a letter without its marks, a Greek letter by its name, a fraction with a slash; None if unknown."""
    if c in _SIGNS:
        return _SIGNS[c]
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("\u2044", "/")
    name = unicodedata.name(plain[:1] or c, "").split()
    if plain.isascii():
        return plain
    if name[:1] == ["LATIN"] and "LETTER" in name and len(letter := name[name.index("LETTER") + 1]) == 1:
        return letter if "CAPITAL" in name else letter.lower()
    if name[:1] == ["GREEK"] and "LETTER" in name and (letter := name[-1] if "FINAL" in name else name[name.index("LETTER") + 1]).isalpha():
        own = _GREEK.get(letter, letter[0].lower())
        return own.capitalize() if "CAPITAL" in name else own
    return None


def _table() -> dict[str, str]:
    blocks = (range(0xA1, 0x250), range(0x391, 0x3CA), range(0x1E00, 0x1F00), range(0x2010, 0x2070), range(0x2070, 0x20A0), range(0x2150, 0x2160), map(ord, _SIGNS))
    found = {chr(k): ascii_of(chr(k)) for block in blocks for k in block}
    return {c: x for c, x in found.items() if x is not None and x != c}


_ASCII = _table()
_ONE = {c: x for c, x in _ASCII.items() if len(x) == 1}
_SEVERAL = {c: x for c, x in _ASCII.items() if len(x) > 1}


def transliterate(t: Column) -> Column:
    """Latin and Greek letters, punctuation and signs as ASCII (a table by rule); other characters stay."""
    several = F.create_map(*(F.lit(x) for kv in _SEVERAL.items() for x in kv))

    def folded(x: Column) -> Column:
        return rewrite(F.translate(x, "".join(_ONE), "".join(_ONE.values())), "[" + "".join(_SEVERAL) + "]", lambda c: F.try_element_at(several, c))

    return let(t, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), folded(x)).otherwise(x))


def transliterate_wide(t: Column) -> Column:
    """Any character, by the same rules in an Arrow function; what has no ASCII form stays."""

    def fold(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([None if x is None else "".join(y if y.isascii() or (z := ascii_of(y)) is None else z for y in x) for x in c.to_pylist()], pa.string())

    return F.arrow_udf(fold, "string")(t)


# ---------------------------------------------------------------- descriptions
def collapse_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def hyphens(t: Column) -> Column:
    """Two hyphens, and an en dash, are one hyphen."""
    return F.translate(F.replace(t, F.lit("--"), F.lit("-")), "–", "-")


def common_errors(t: Column) -> Column:
    """White space, dashes, commas that end sentences, and the unit cm read as em."""
    ended = F.regexp_replace(hyphens(collapse_space(t)), r",(?=\s+[A-Z])", ".")
    return F.regexp_replace(ended, r"(?<![\p{L}\p{N}_])em(?![\p{L}\p{N}_])", "cm")


def expand_abbreviations(t: Column) -> Column:
    """Each abbreviation as a word of its own, in any case, with the full stop behind it; a first capital stays one. ``c`` and ``ca`` alone are ``ca.``."""
    full = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))

    def word(found: Column) -> Column:
        known = F.try_element_at(full, F.lower(F.rtrim(found, F.lit("."))))
        return F.when(F.substring(found, 1, 1) == F.upper(F.substring(found, 1, 1)), F.initcap(known)).otherwise(known)

    short = "|".join(sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
    return F.regexp_replace(rewrite(t, rf"(?i)\b(?:{short})\b\.?", word), r"(?<=\s)ca?(?=\s)", "ca.")


def fractions(t: Column) -> Column:
    """Each a/b becomes its quotient with one decimal (half even on the decimal value; n/0 is 0.0)."""

    def value(x: Column) -> Column:
        a, b = F.split(x, "/")[0].cast("double"), F.split(x, "/")[1].cast("double")
        return F.coalesce(F.bround(a / F.nullif(b, F.lit(0.0)), 1), F.lit(0.0)).cast("string")

    return rewrite(t, "[0-9]+/[0-9]+", value)


#: Where a blank is missing: between a letter and a digit or opening bracket (but in m3), between a digit or closing bracket
#: and a letter (but in 2n), and behind a comma or full stop that follows no digit. Each match is the character before the blank.
_CONJOINED = r"[a-z](?=[(0-9])(?!(?<=m)3)|[0-9)](?=[a-z])(?!(?<=2)n)|(?<=[^0-9])[,.](?=\S)"


def split_conjoined(t: Column) -> Column:
    return F.regexp_replace(t, _CONJOINED, "$0 ")


def normalise(t: Column) -> Column:
    """The description normaliser, in its fixed order."""
    for step in (fractions, expand_abbreviations, common_errors, transliterate, split_conjoined):
        t = step(t)
    return t


def rejoined(t: Column) -> Column:
    """Words divided at the end of a line are one again; blanks between a full stop and the line's end go."""
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\w)-\s+", ""), r"(?<=\.)[ \t]+(?=\n)", "")


def normalise_page(t: Column) -> Column:
    """The OCR page normaliser: ``var.`` misread by one letter or with a comma, divided words, lines within a paragraph, runs of blanks."""
    t = rejoined(F.regexp_replace(t, r"(?i)(?<=\s)[vy]a[vr][.,]\s?", "var. "))
    return F.regexp_replace(F.regexp_replace(t, r"(?<![.\n])\n+", " "), r"[^\S\n]+", " ")


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0))


def tokens(t: Column) -> Column:
    """White-space tokens, punctuation attached."""
    return F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda x: x != "")


def mentions(t: Column, vocabulary: list[str], min_terms: int = 5, min_chars: int = 100, min_ratio: float | None = None) -> Column:
    """Whether a text of enough characters has enough distinct words of the vocabulary (a literal of about a thousand words at most)."""
    n = F.size(F.array_intersect(tokens(t), F.array(*map(F.lit, vocabulary))))
    ok = (F.length(t) >= min_chars) & (n >= min_terms)
    return ok if min_ratio is None else ok & F.coalesce(n / F.nullif(F.size(tokens(t)), F.lit(0)) >= min_ratio, F.lit(False))


def sentences(t: Column) -> Column:
    """Splits after a semicolon, and after a full stop before a capital, or before a digit if the word before has three letters or more."""
    mark = "\u0001"
    t = F.regexp_replace(t, r";\s*", f";{mark}")
    t = F.regexp_replace(t, r"\.\s+(?=[A-Z])", f".{mark}")
    t = F.regexp_replace(t, r"(?<=[A-Za-z]{3})\.\s+(?=[0-9])", f".{mark}")
    return F.filter(F.split(t, mark), lambda x: F.trim(x) != "")


def paragraphs(t: Column) -> Column:
    return F.split(t, r"\n\s*\n", -1)


def is_figure(t: Column) -> Column:
    return t.rlike(r"^[0-9]+[a-zA-Z][.|\s]")


def is_title(t: Column) -> Column:
    return (F.length(t) > 1) & (F.size(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))) <= 1)


def capitalise(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


def slug(t: Column) -> Column:
    return F.lower(F.replace(t, F.lit(" "), F.lit("-")))


def is_well_formed(name: Column) -> Column:
    """A taxon's name begins with a capital."""
    return name.rlike(r"^\p{Lu}")


def is_binomial(t: Column) -> Column:
    return (F.trim(t) != "") & (F.size(F.split(F.trim(t), r"\s+")) == 2)


def higher_taxon(t: Column) -> Column:
    return F.regexp_extract(t, r"^(.*?)\s(?:var\.|subsp\.)", 1)


def template_unit(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"\[(\w+)\]", 1), F.lit(""))


def padded(number: Column, width: int) -> Column:
    """Zero-filled, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def archive_key(page: Column, item: Column, order: Column) -> Column:
    """prefix/item/item-page-order of an OCR archive."""
    name = padded(item, 6)
    return F.concat_ws("/", F.substring(name, 1, 3), name, F.concat_ws("-", name, padded(page, 8), padded(order, 4)))
