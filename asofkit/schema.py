"""Declared table contracts and the projection that applies them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A table or its contract doesn't hold what it declares."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    source: str
    type: str
    required: bool = True
    group: str = ""


@dataclass(frozen=True)
class TableSpec:
    table: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()
    encoding: str = "utf-8"
    drop: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise SchemaError(f"{self.table}: columns declared twice: {twice}")
        if lost := sorted(set(self.key) - set(names)):
            raise SchemaError(f"{self.table}: key columns not declared: {lost}")

    @property
    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for c in self.columns:
            out.setdefault(c.group, []).append(c.name)
        return out


@dataclass(frozen=True)
class StageReport:
    unknown: tuple[str, ...]  # incoming columns that the contract doesn't name: a warning
    absent: tuple[str, ...]  # optional columns that came as typed nulls


def stage(raw: DataFrame, spec: TableSpec, **literals: str) -> tuple[DataFrame, StageReport]:
    """Rename, cast leniently and order the columns by the contract; literals come first.

    A value that can't be cast is null. A missing required column raises SchemaError, a missing
    optional one is a typed null, and an unknown one is reported unless ``drop`` lists it.
    """
    have = set(raw.columns)
    if lost := sorted(c.source for c in spec.columns if c.required and c.source not in have):
        raise SchemaError(f"{spec.table}: required columns are missing: {lost}")

    def made(c: ColumnSpec) -> Column:
        if c.source not in have:
            return F.lit(None).cast(c.type).alias(c.name)
        return F.col(f"`{c.source}`").try_cast(c.type).alias(c.name)

    named = {c.source for c in spec.columns} | spec.drop
    report = StageReport(tuple(sorted(have - named)), tuple(c.name for c in spec.columns if c.source not in have))
    return raw.select(*[F.lit(v).alias(k) for k, v in literals.items()], *map(made, spec.columns)), report
