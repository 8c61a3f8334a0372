"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read the bits.

All of it is built-in column functions. ``ledger`` adds one struct column: the measurements, and ``bits`` with bit k set
where rule k fails. A policy is a named, versioned set of rules: a text is kept where ``bits & mask = 0``.
Words are runs of characters other than x20 and x09-x0D.

Defined cases: null and empty texts have no words, so they fail the length rule; repeated rows are judged alike; an empty
table gives an empty one; a column that has the output's name is replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule k (in this order) -> SQL condition of failure over the measurements. Order and meaning are fixed: bits are stored.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "10 * n_upper > 3 * word_chars",
    "repeated_lines": "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(RULES))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def starts(ordered: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            before = F.try_element_at(ordered, F.nullif(i, F.lit(0)))["h"]
            after = F.try_element_at(ordered, i + 2)["h"]
            return F.when((F.coalesce(before == e["h"], F.lit(False))) | F.coalesce(after == e["h"], F.lit(False)), e["i"])

        return F.array_sort(F.filter(F.transform(ordered, twice), lambda x: x.isNotNull()))

    def cover(at: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
        return F.aggregate(at, first, lambda s, i: F.struct((s["n"] + F.lit(WINDOW) - F.greatest(s["stop"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("stop")), lambda s: s["n"])

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, lambda p: cover(starts(p))))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, counted))


def measurements(text: Column) -> Column:
    """struct of longs: n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol))

    def of(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        return F.struct(
            *(
                v.cast("long").alias(k)
                for k, v in {
                    "n_words": F.size(words),
                    "word_chars": F.length(F.array_join(words, "")),
                    "n_symbols": F.length(text) - F.length(bare),
                    "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
                    "n_lines": F.size(lines),
                    "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                    "n_repeat_words": _repeat_words(words),
                }.items()
            )
        )

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return _let(F.struct(words.alias("words"), lines.alias("lines")), of)


def ledger(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with the struct ``out``: the measurements and ``bits``.

    The bits are computed inside one expression that names the measurements once, so a filter pushed below it does too.
    """
    names = [c for c in docs.columns if c != out]
    measured = docs.select(*map(column, names), measurements(column(text).cast("string")).alias(out))
    fields = ", ".join(f"'{k}', m.{k}" for k in measured.schema[out].dataType.names)
    bits = " + ".join(f"if({_of(rule)}, {1 << k}, 0)" for k, rule in enumerate(RULES.values()))
    quoted = "`" + out.replace("`", "``") + "`"
    return measured.withColumn(out, F.expr(f"element_at(transform(array({quoted}), m -> named_struct({fields}, 'bits', {bits})), 1)"))


def _of(rule: str) -> str:
    import re

    return re.sub(r"\b(n_\w+|word_chars)\b", r"m.\1", rule)


def passes(policy: Policy, out: str = "quality") -> Column:
    return column(out)["bits"].bitwiseAND(F.lit(policy.mask)) == 0


def ablations(judged: DataFrame, policy: Policy = STANDARD, out: str = "quality") -> DataFrame:
    """For each rule of the policy: rows it fails, and rows that only it rejects; from the stored bits alone."""
    combos = judged.groupBy(column(out)["bits"].bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).alias("bit")) for r in policy.rules)))
    each = combos.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.bit_or(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits"))).alias("seen_with"),
    )


def quality_filter(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the columns of ``docs``."""
    return ledger(docs, text, "__quality").filter(passes(policy, "__quality")).select(*map(column, docs.columns))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~passes(BASE)).alias("base_failed"),
        passes(STANDARD).alias("kept"),
    )


_WS = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS ls
  FROM documents
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM a
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM a, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, unnest(range(0, 8)) AS v(k) GROUP BY doc_id
), m AS (
  SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({RULES["few_words"]} OR {RULES["repeated_windows"]}) AS base_failed,
       NOT ({" OR ".join(f"({r})" for r in RULES.values())}) AS kept
FROM m
"""
