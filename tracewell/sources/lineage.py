"""Results that carry how they were made: a table and the list of its steps."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import cache, sinks


@dataclass(frozen=True)
class Result:
    """A table with attributes; ``proc`` in them lists ``{name, params}`` of every step, oldest first."""

    df: DataFrame
    attrs: dict = field(default_factory=dict)

    @property
    def steps(self) -> list[dict]:
        return self.attrs.get("proc", [])

    def then(self, name: str, fn: Callable[..., DataFrame], store: bool = True, **params) -> Result:
        """The step's result; its attributes are a copy, with the step added if ``store``."""
        attrs = copy.deepcopy(self.attrs)
        if store:
            attrs["proc"] = [*attrs.get("proc", []), {"name": name, "params": cache.normalise(params)}]
        return Result(fn(self.df, **params), attrs)

    def save(self, path: str) -> None:
        sinks.save(self.df, path, self.attrs)


def load(spark: SparkSession, path: str) -> Result:
    return Result(sinks.load(spark, path), sinks.load_meta(spark, path))
