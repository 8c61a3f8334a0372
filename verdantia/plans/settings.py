"""Settings of a run, and the steps of the normaliser by name.

``Settings`` is a value: a changed one is another value, and only the named fields may be changed.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column

from ..functions import text as T

CHANGEABLE = ("text_source",)


@dataclass(frozen=True)
class Settings:
    text_source: str = "archive"  # archive or api: where the text of scanned pages comes from
    archive: str | None = None
    sources: tuple[str, ...] = ("bhl", "efloras", "ecoflora")
    unit: str = "cm"
    debug: bool = False

    @classmethod
    def of_environment(cls, environ: dict[str, str] | None = None, prefix: str = "VERDANTIA_") -> Settings:
        """From variables like ``VERDANTIA_SOURCES=bhl,efloras``; what is not set keeps its default."""
        given, out = os.environ if environ is None else environ, {}
        for f in fields(cls):
            if (value := given.get(prefix + f.name.upper())) is not None:
                out[f.name] = tuple(x.strip().lower() for x in value.split(",") if x.strip()) if f.name == "sources" else value.lower() in ("1", "true", "yes") if f.name == "debug" else value
        return cls(**out)

    def get(self, name: str):
        if name not in {f.name for f in fields(self)}:
            raise KeyError(name)
        return getattr(self, name)

    def with_(self, name: str, value) -> Settings:
        if name not in CHANGEABLE:
            raise KeyError(f"{name} cannot be changed")
        return replace(self, **{name: value})


@dataclass
class Steps:
    """Named column functions in order; a new one of a known name takes its place."""

    steps: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def put(self, name: str, step: Callable[[Column], Column], after: str | None = None) -> Steps:
        if name in self.steps or after is None:
            self.steps[name] = step
            return self
        if after not in self.steps:
            raise KeyError(after)
        out: dict = {}
        for k, v in self.steps.items():
            out[k] = v
            if k == after:
                out[name] = step
        self.steps = out
        return self

    def __call__(self, c: Column) -> Column:
        for step in self.steps.values():
            c = step(c)
        return c


def normaliser() -> Steps:
    """The description normaliser's steps, to be extended."""
    return Steps({"fractions": T.fractions, "abbreviations": T.expand_abbreviations, "errors": T.common_errors, "ascii": T.transliterate, "conjoined": T.split_conjoined})
