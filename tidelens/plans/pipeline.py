"""Named stages from DataFrame to DataFrame, composed in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..operators import filters, ordered, reduce

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def time_filter(ts: str, start: Any = None, end: Any = None) -> Stage:
    whole = filters.time_between(ts, start, end)
    return "time_filter", lambda df: df if whole is None else df.where(whole)


def project(columns: list[str]) -> Stage:
    return "project", lambda df: filters.project(df, columns)


def sort(column: str, descending: bool = False) -> Stage:
    return "sort", lambda df: ordered.sort_stage(df, column, descending)


def by_time(ts: str, column: str, how: str = "mean") -> Stage:
    return "by_time", lambda df: reduce.aggregate_by_time(df, ts, column, how)


def reduction(ts: str, columns: list[str], strategy: str, **options: Any) -> Stage:
    return strategy, lambda df: reduce.reduce_series(df, ts, columns, strategy, **options)


@dataclass
class Pipeline:
    stages: list[Stage] = field(default_factory=list)

    def then(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            df = df.transform(stage)
        return df

    def explain(self) -> str:
        return " -> ".join(name for name, _ in self.stages)

    def __len__(self) -> int:
        return len(self.stages)
