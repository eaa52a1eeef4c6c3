"""Quality gates: all gates of a table are counted without windows, and samples taken of failing ones only.

Gates on single rows are one aggregation. Gates on groups are counted by grouping sets of one pass, with
partial sums before the shuffle, so a group that holds most rows costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 5


@dataclass(frozen=True)
class Keyed:
    """A gate on groups: aggregates of the rows of a key, and when they make the group a violating one.

    With ``distinct`` the key has that column too, and ``kinds`` is the number of its values in a group.
    """

    by: tuple[str, ...]
    broken: Column
    made: dict[str, Column] = field(default_factory=dict)
    distinct: str | None = None

    @property
    def fine(self) -> tuple[str, ...]:
        return (*self.by, self.distinct) if self.distinct and self.distinct not in self.by else self.by


@dataclass(frozen=True)
class Gate:
    """A predicate that is true for violating rows, or a condition on groups, whose rows all violate it then."""

    name: str
    predicate: Column | None
    columns: tuple[str, ...]
    severity: str = "block"
    keyed: Keyed | None = None


@dataclass(frozen=True)
class Violation:
    gate: str
    severity: str
    rows: int
    detail: str = ""
    sample: list = field(default_factory=list)


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def unique_key(*key: str) -> Gate:
    return Gate(f"unique_key({','.join(key)})", None, key, keyed=Keyed(key, F.col("_n") > 1))


def not_null(*columns: str) -> Gate:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return Gate(f"not_null({','.join(columns)})", out, columns)


def in_range(column: str, low=None, high=None) -> Gate:
    c, out = F.col(column), F.lit(False)
    if low is not None:
        out = out | (c < low)
    if high is not None:
        out = out | (c > high)
    return Gate(f"in_range({column},{low},{high})", _false(out), (column,))


def non_negative(column: str) -> Gate:
    return in_range(column, low=0)


def enum_values(column: str, allowed: Sequence) -> Gate:
    return Gate(f"enum_values({column})", _false(~F.col(column).isin(*allowed)), (column,))


def within(column: str, start: str, end: str) -> Gate:
    return Gate(f"within({column},{start},{end})", _false((F.col(column) < F.col(start)) | (F.col(column) > F.col(end))), (column, start, end))


def different(a: str, b: str) -> Gate:
    return Gate(f"different({a},{b})", _false(F.col(a) == F.col(b)), (a, b))


def implies_zero(zero: str, positive: str) -> Gate:
    """Rows with 0 of one column and more than 0 of another."""
    return Gate(f"implies_zero({zero},{positive})", _false((F.col(zero) == 0) & (F.col(positive) > 0)), (zero, positive))


def formula(name: str, column: str, expected: Column, uses: Sequence[str], severity: str = "warn") -> Gate:
    return Gate(name, _false(F.col(column) != expected), (column, *uses), severity)


def constant_within(column: str, *group: str) -> Gate:
    """One value a group, or none for all its rows."""
    made = {"low": F.min(column), "high": F.max(column), "held": F.count(column)}
    broken = _false((F.col("low") != F.col("high")) | ((F.col("held") > 0) & (F.col("held") < F.col("_n"))))
    return Gate(f"constant_within({column})", None, (column, *group), keyed=Keyed(group, broken, made))


def exactly_distinct(column: str, n: int, *group: str) -> Gate:
    return Gate(f"exactly_distinct({column},{n})", None, (column, *group), keyed=Keyed(group, F.col("kinds") != n, distinct=column))


def _groups(df: DataFrame, keyed: Sequence[Keyed]) -> list[DataFrame]:
    """For each gate its groups with _n, their rows, and _broken."""
    names = list(dict.fromkeys(c for k in keyed for c in k.fine))
    sets = list(dict.fromkeys(k.fine for k in keyed))
    made = {f"_{i}_{m}": c for i, k in enumerate(keyed) for m, c in k.made.items()}
    grouped = df.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *[F.col(f"`{c}`") for c in names])
    grouped = grouped.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n"), *[c.alias(m) for m, c in made.items()])
    out = []
    for i, k in enumerate(keyed):
        number = sum(1 << (len(names) - 1 - j) for j, c in enumerate(names) if c not in k.fine)  # a bit for each column left out
        mine = grouped.where(F.col("_set") == number)
        if k.distinct:
            mine = mine.groupBy(*k.by).agg(F.sum("_n").alias("_n"), F.count(k.distinct).alias("kinds"))
        else:
            mine = mine.select(*k.by, "_n", *[F.col(f"_{i}_{m}").alias(m) for m in k.made])
        out.append(mine.withColumn("_broken", k.broken))
    return out


def _counts(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """gate (its place) and violations."""
    single = [(i, g) for i, g in enumerate(gates) if not g.keyed]
    grouped = [(i, g) for i, g in enumerate(gates) if g.keyed]
    parts = []
    if single:
        row = df.agg(*[F.count_if(g.predicate).alias(f"_g{i}") for i, g in single])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("gate"), F.col(f"_g{i}").alias("violations")) for i, _ in single]))))
    if grouped:
        for (i, _), groups in zip(grouped, _groups(df, [g.keyed for _, g in grouped])):
            parts.append(groups.agg(F.coalesce(F.sum(F.when(F.col("_broken"), F.col("_n"))), F.lit(0)).alias("violations")).select(F.lit(i).alias("gate"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sample(df: DataFrame, g: Gate, n: int) -> list:
    """The first violating rows; of a gate on groups, rows of its first violating groups."""
    rows = df.where(g.predicate) if g.predicate is not None else None
    if rows is None:
        broken = _groups(df, [g.keyed])[0].where("_broken").select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(g.keyed.by)])
        first = broken.orderBy(*broken.columns).limit(n)  # at most n groups
        match = F.lit(True)
        for i, c in enumerate(g.keyed.by):
            match = match & df[c].eqNullSafe(first[f"_{i}"])
        rows = df.join(F.broadcast(first), match, "left_semi")
    return [r.asDict() for r in rows.select(*g.columns).orderBy(*g.columns).limit(n).collect()]


def run_gates(df: DataFrame | None, gates: Sequence[Gate], sample: int = SAMPLE) -> list[Violation]:
    """All violations; every gate runs. An absent table has none, an absent column is one (0 rows)."""
    if df is None:
        return []
    out, present = [], []
    for g in gates:
        lost = [c for c in g.columns if c not in df.columns]
        if lost:
            out.append(Violation(g.name, g.severity, 0, f"columns are absent: {lost}"))
        else:
            present.append(g)
    if not present:
        return out
    counts = {r["gate"]: r["violations"] for r in _counts(df, present).collect()}  # a row a gate
    for i, g in enumerate(present):
        if counts[i]:
            out.append(Violation(g.name, g.severity, counts[i], sample=_sample(df, g, sample)))
    return out


def report(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """gate, severity and violating rows of every gate."""
    names = F.array(*[F.struct(F.lit(g.name).alias("gate"), F.lit(g.severity).alias("severity")) for g in gates])
    return _counts(df, gates).select(F.get(names, "gate").alias("g"), "violations").select("g.gate", "g.severity", "violations")


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Rows whose reference is not null and not in the parent."""
    known = parent.select(F.col(parent_column).alias("_p")).distinct()
    return child.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_p"), "left_anti")
