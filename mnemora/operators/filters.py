"""Conjunctive memory filters as one predicate, so that what Parquet can prune is pushed to the scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MemoryFilter:
    """Every condition that is set must hold.

    Time bounds are inclusive on milliseconds; the least importance is inclusive, the most exclusive; all the
    topics and entities must be present; a custom value matches as a substring, of a list any. The URI
    prefix holds for null URIs only with keep_null_uri.
    """

    user_id: str | None = None
    agent_id: str | None = None
    layer: str | None = None
    created_after: dt.datetime | None = None
    created_before: dt.datetime | None = None
    updated_after: dt.datetime | None = None
    updated_before: dt.datetime | None = None
    topics: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    min_importance: float | None = None
    max_importance: float | None = None
    uri_prefix: str | None = None
    keep_null_uri: bool = False
    custom: dict[str, str | tuple[str, ...]] = field(default_factory=dict)

    def column(self) -> Column:
        tests: list[Column] = []
        for name in ("user_id", "agent_id", "layer"):
            if (v := getattr(self, name)) is not None:
                tests.append(F.col(name) == v)
        for name in ("created", "updated"):
            at = F.col(f"{name}_at")  # bare, so that the bounds reach the scan; they are cut to milliseconds instead
            if (v := getattr(self, f"{name}_after")) is not None:
                least = v.replace(microsecond=v.microsecond // 1000 * 1000)
                tests.append(at >= F.lit(least if least == v else least + dt.timedelta(milliseconds=1)))
            if (v := getattr(self, f"{name}_before")) is not None:
                tests.append(at < F.lit(v.replace(microsecond=v.microsecond // 1000 * 1000) + dt.timedelta(milliseconds=1)))
        tests += [F.array_contains("topics", t) for t in self.topics]
        tests += [F.array_contains("entities", e) for e in self.entities]
        if self.min_importance is not None:
            tests.append(F.col("importance_score") >= self.min_importance)
        if self.max_importance is not None:
            tests.append(F.col("importance_score") < self.max_importance)
        if self.uri_prefix is not None:
            starts = F.col("uri").startswith(self.uri_prefix)
            tests.append(starts | F.col("uri").isNull() if self.keep_null_uri else starts)
        for key, value in self.custom.items():
            held = F.try_element_at("custom", F.lit(key))
            some = value if isinstance(value, tuple) else (value,)
            tests.append(F.coalesce(reduce(lambda a, b: a | b, [held.contains(v) for v in some]), F.lit(False)))
        return reduce(lambda a, b: a & b, tests, F.lit(True))
