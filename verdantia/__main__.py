"""``python -m verdantia traits``: taxa and descriptions in, traits out.

The descriptions are a table (taxon, source, text, and maybe source_id). ``--parts``: JSON or YAML, part -> list of synonyms.
``--traits``: a table (type, group, part, term, character, trait). ``--template``: JSON or YAML, column -> field or list of fields
(or nothing: the field has the column's name), for each group or for all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import frames as O
from .plans import traits as P
from .sources import files, sinks


def part_terms(parts: dict[str, list[str] | None]) -> dict[str, str]:
    """term -> part: each part's own name, its synonyms, or without synonyms its plural; a synonym stands for its part."""
    terms = {}
    for part, synonyms in parts.items():
        terms.setdefault(part, part)
        if not synonyms:
            terms.setdefault(part + "s", part)
    return terms | {s: part for part, synonyms in parts.items() for s in synonyms or ()}


def main(argv: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="verdantia")
    traits = parser.add_subparsers(dest="command", required=True).add_parser("traits")
    taxa = traits.add_mutually_exclusive_group(required=True)
    taxa.add_argument("--taxa", nargs="+")
    taxa.add_argument("--file")
    traits.add_argument("--group", choices=O.GROUPS)
    traits.add_argument("--limit", type=int)
    for name in ("descriptions", "parts", "out"):
        traits.add_argument(f"--{name}", required=True)
    traits.add_argument("--traits")
    traits.add_argument("--template")
    traits.add_argument("--units", action="store_true", help="write units behind the numbers")
    traits.add_argument("--name-column")
    traits.add_argument("--group-column")
    traits.add_argument("--force", action="store_true")
    given = parser.parse_args(argv)
    if given.taxa and not given.group:
        parser.error("--taxa needs --group")

    spark = SparkSession.builder.appName("verdantia").getOrCreate()
    wanted = files.inline_taxa(spark, given.taxa, given.group) if given.taxa else O.worklist(files.read_table(spark, given.file), given.name_column, given.group_column)
    if given.file and given.group:
        wanted = wanted.filter(wanted.taxonomic_group == given.group)
    if given.limit:
        wanted = O.limit_per_group(wanted, "taxonomic_group", "taxon", given.limit)
    terms = part_terms(files.read_settings(given.parts))
    described = files.read_table(spark, given.descriptions).join(wanted.select("taxon").distinct(), "taxon", "left_semi")
    dictionary = files.read_table(spark, given.traits) if given.traits else None
    observed = P.observations(described, terms, dictionary, group=given.group)
    path = f"{given.out}/{sinks.output_name(given.taxa or [given.file, given.group or ''])}"
    if given.template:
        template = files.read_settings(given.template)
        if given.group and isinstance(template.get(given.group), dict):
            template = template[given.group]
        by = lambda *keys: P.by_template(observed, template, keys, units=given.units)
        sinks.write_by_source(by("taxon"), by("taxon", "source", *(c for c in ("source_id",) if c in observed.columns)), path, force=given.force)
    else:
        sinks.write(P.summary(observed), path, force=given.force)
    return path


if __name__ == "__main__":
    print(main())
