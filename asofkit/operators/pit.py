"""Point-in-time operators: nothing at or after a row's own block or time reaches its history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .ranges import Cut, plus

WINDOWS = (3, 5, 10)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def block_frames(key: Sequence[str], block: str, order: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """The rows of a key in block order, and a block's own rows.

    Both have the same sort, and the first's partitioning serves the second, so all windows over
    them need one shuffle.
    """
    return Window.partitionBy(*key).orderBy(block, *order), Window.partitionBy(*key, block).orderBy(*order)


def rate(total: Column, minutes: Column, per: float = 90.0) -> Column:
    """total / minutes * per, null without minutes."""
    return F.when(minutes > 0, total / minutes * per)


def trailing(
    df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], stats: Sequence[str], minutes: str,
    windows: Sequence[int] = WINDOWS, masks: Mapping[str, str] | None = None, to_date: bool = True, range_rows: int | None = None,
) -> DataFrame:
    """Sums and rates over the last N rows of each key strictly before the row's block.

    A frame holds the last N rows, whatever they contain; null values are skipped in a sum, and a
    frame without values gives null. The rate divides by the minutes of all rows of the frame. A
    statistic in ``masks`` counts only rows whose mask column is true, in sum and minutes alike,
    and its ``masked_count`` is the number of the frame's other rows. Rows of one block share a
    history and never see each other: the frame is taken at a block's first row and handed to the
    others. ``to_date`` adds the frame of all earlier rows. Columns: {stat}_sum_last_{N},
    {stat}_per90_last_{N}, {stat}_masked_last_{N}, and the same with to_date.
    """
    masks = masks or {}
    cut = Cut(df, key, block, range_rows)
    base = cut.with_last(max(windows, default=0), [block, *order])
    kept = {s: (lambda c, m=masks.get(s): F.when(F.col(m), c) if m else c) for s in stats}
    hidden = {s: ~F.coalesce(F.col(m), F.lit(False)) for s, m in masks.items()}
    earlier = {}
    if to_date and cut.large:
        for s in stats:
            earlier[f"_{s}_sum"] = (F.sum(kept[s](_c(s))), F.sum)
            earlier[f"_{s}_minutes"] = (F.sum(kept[s](_c(minutes))), F.sum)
            if s in masks:
                earlier[f"_{s}_masked"] = (F.count_if(hidden[s]), F.sum)
        base = cut.carry(base, earlier)
    rows, own = block_frames(cut.by, block, order)
    frames = {f"last_{n}": rows.rowsBetween(-n, -1) for n in windows}
    if to_date:
        frames["to_date"] = rows.rowsBetween(Window.unboundedPreceding, -1)
    made: dict[str, Column] = {}
    for name, frame in frames.items():
        for s in stats:
            # Rows before a range are in its frames of a number of rows, and in the totals carried into it.
            alone = (lambda c: F.when(~F.col("_halo"), c)) if name == "to_date" and earlier else (lambda c: c)
            add = (lambda c, what, s=s: plus(c, F.col(f"_{s}_{what}"))) if name == "to_date" and earlier else (lambda c, what: c)
            total, m = (add(F.sum(alone(kept[s](_c(x)))).over(frame), what) for x, what in ((s, "sum"), (minutes, "minutes")))
            made[f"{s}_sum_{name}"] = total
            made[f"{s}_per90_{name}"] = rate(total, m)
            if s in masks:
                made[f"{s}_masked_{name}"] = add(F.count_if(alone(hidden[s])).over(frame), "masked")
    out = base.withColumns(made).withColumns({c: F.first(c).over(own) for c in made})
    return cut.done(out.where("not _halo"), *made)


def previous_season(df: DataFrame, key: Sequence[str], season: str, stats: Sequence[str], minutes: str, masks: Mapping[str, str] | None = None) -> DataFrame:
    """Each row with the sums and rates of its key over the whole season before.

    ``key`` should be stable across seasons; a number that is given anew each season would bring
    another entity's history.
    """
    masks = masks or {}
    made = []
    for s in stats:
        keep = (lambda c: F.when(F.col(masks[s]), c)) if s in masks else (lambda c: c)  # noqa: B023, E731
        total, m = F.sum(keep(_c(s))), F.sum(keep(_c(minutes)))
        made += [total.alias(f"{s}_sum_last_season"), rate(total, m).alias(f"{s}_per90_last_season")]
        if s in masks:
            made.append(F.count_if(~F.coalesce(F.col(masks[s]), F.lit(False))).alias(f"{s}_masked_last_season"))
    past = df.groupBy(*key, season).agg(*made).withColumn(season, F.col(season) + 1)
    out = df.join(past, [*key, season], "left")
    return out.withColumns({f"{s}_masked_last_season": F.coalesce(f"{s}_masked_last_season", F.lit(0)) for s in masks if s in stats})


def trailing_mean(df: DataFrame, key: Sequence[str], block: str, order: Sequence[str], value: str, window: int = 5, out: str = "prediction", range_rows: int | None = None) -> DataFrame:
    """Mean of the last ``window`` values that are not null, from rows strictly before the block.

    Unlike in ``trailing``, nulls go before the window is taken. No earlier value gives null.
    """
    some = F.col(value).isNotNull()
    cut = Cut(df, key, block, range_rows)
    base = cut.with_last(window, [block, *order], some)
    valued = Window.partitionBy(*cut.by, some).orderBy(block, *order).rowsBetween(-(window - 1), 0)
    rows, own = block_frames(cut.by, block, order)
    upto = F.when(some, F.avg(value).over(valued))
    before = F.last("_upto", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    made = base.withColumn("_upto", upto).withColumn(out, before).withColumn(out, F.first(out).over(own))
    return cut.done(made.where("not _halo"), out)


def carry_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str, section: str | None = None, range_rows: int | None = None) -> DataFrame:
    """Each row with the latest value of its key, its own included, that isn't null; ``section`` numbers these values from 1."""
    cut = Cut(df, key, order[0], range_rows)
    frame = Window.partitionBy(*cut.by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows, last, number = cut.rows, F.last(value, ignorenulls=True).over(frame), F.count(value).over(frame)
    if cut.large:
        some = F.col(value).isNotNull()
        found = F.max_by(F.when(some, F.struct(value)), F.when(some, F.struct(*order)))
        rows = cut.carry(rows, {"_held": (found, lambda n: F.last(n, ignorenulls=True)), "_before": (F.count(value), F.sum)})
        last, number = F.coalesce(last, F.col("_held")[value]), plus(number, F.col("_before"))
    made = {out: last} | ({section: number} if section else {})
    return cut.done(rows.withColumns(made), *made)


def asof_strict(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], tie: Sequence[str] = (), range_rows: int | None = None) -> DataFrame:
    """Each left row with the values of its key's latest right row strictly before it.

    Both sides are sorted together once, left before right at equal times, so there is no range
    join. Null values on the latest row stay null. ``tie`` orders right rows of one time.
    """
    found = F.struct(*values)
    # Right rows come after left ones of the same time, so only strictly earlier ones precede.
    l_rows = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"))
    r_rows = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), found.alias("_right"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)])
    ties = [f"_tie{i}" for i in range(len(tie))]
    cut = Cut(l_rows.unionByName(r_rows, allowMissingColumns=True), ["_k"], "_t", range_rows)
    ordered = Window.partitionBy(*cut.by).orderBy("_t", "_side", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows, before = cut.rows, F.last("_right", ignorenulls=True).over(ordered)
    if cut.large:
        latest_right = F.max_by("_right", F.when(F.col("_side") == 1, F.struct("_t", *ties)))
        rows, before = cut.carry(rows, {"_held": (latest_right, lambda n: F.last(n, ignorenulls=True))}), F.coalesce(before, F.col("_held"))
    both = rows.withColumn("_found", before)
    return both.where("_side = 0").select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def range_counts(fixtures: DataFrame, others: DataFrame | None, key: str, time: str, days: Sequence[int], other_date: str = "date") -> DataFrame:
    """For each fixture, how many of its key's fixtures fall in the days before it.

    Fixtures count by their time in [t - N days, t), those of a second calendar by date in
    [date(t - N days), date(t)); the two bounds are kept apart. Adds count_{N}.
    """
    epoch, day = F.unix_seconds(F.col(time)), F.unix_date(F.to_date(time))
    base = fixtures.select(F.struct(*fixtures.columns).alias("_row"), F.col(key).alias("_k"), epoch.alias("_e"), day.alias("_d"), F.lit(0).alias("_o"))
    if others is not None:
        base = base.unionByName(
            others.select(F.lit(None).alias("_row"), F.col(key).alias("_k"), F.lit(None).cast("long").alias("_e"), F.unix_date(F.col(other_date)).alias("_d"), F.lit(1).alias("_o"))
        )
    by_time, by_day = Window.partitionBy("_k").orderBy("_e"), Window.partitionBy("_k").orderBy("_d")
    made = {}
    for n in days:
        c = F.count_if(F.col("_o") == 0).over(by_time.rangeBetween(-n * 86400, -1))
        if others is not None:
            c = c + F.count_if(F.col("_o") == 1).over(by_day.rangeBetween(-n, -1))
        made[f"count_{n}"] = c
    return base.withColumns(made).where("_o = 0").select("_row.*", *made)


def horizon(fixtures: DataFrame, time: str, event: str, as_of: str, n: int) -> DataFrame:
    """The fixtures at or after ``as_of`` in the first ``n`` events by their first such time; null events count as none."""
    ahead = fixtures.where((F.col(time) >= F.lit(as_of).cast("timestamp")) & F.col(event).isNotNull())
    first = ahead.groupBy(event).agg(F.min(time).alias("_t")).orderBy("_t", event).limit(n)
    return ahead.join(F.broadcast(first.select(event)), event, "left_semi")  # n rows


def resolve_three(players: DataFrame, exact: DataFrame, facts: DataFrame, key: str, team: str, time: str, as_of: str) -> DataFrame:
    """The team of each player: of the exact fact, else of the latest one before ``as_of``, else as registered.

    A null team falls through. Adds {team} and level (1, 2, 3, or 0 for none).
    """
    one = exact.groupBy(key).agg(F.max(team).alias("_1"))
    before = facts.where((F.col(time) < F.lit(as_of).cast("timestamp")) & F.col(team).isNotNull())
    two = before.groupBy(key).agg(F.max_by(team, F.struct(time, team)).alias("_2"))
    joined = players.withColumnRenamed(team, "_3").join(one, key, "left").join(two, key, "left")
    level = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3).otherwise(0)
    return joined.select(*[c for c in players.columns if c != team], F.coalesce("_1", "_2", "_3").alias(team), level.alias("level"))


def deadlines(df: DataFrame, event: Sequence[str], time: str, lead: str = "1 hour") -> DataFrame:
    """First and last time of each event, and the deadline that leads the first; null events and times are left out."""
    rows = df.where(F.col(time).isNotNull()).dropna(subset=list(event))
    return rows.groupBy(*event).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time")).withColumn("deadline", F.col("first_time") - F.expr(f"INTERVAL {lead}"))


def overlaps(windows: DataFrame, start: str, end: str, within: Sequence[str] = (), range_rows: int | None = None) -> DataFrame:
    """The windows that start at or before the latest end of any earlier one of their group."""
    cut = Cut(windows, within, start, range_rows)
    rows, found = cut.rows, F.max(end).over(Window.partitionBy(*cut.by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    if cut.large:
        rows, found = cut.carry(rows, {"_held": (F.max(end), F.max)}), F.greatest(found, F.col("_held"))
    return cut.done(rows.withColumn("latest_end", found), "latest_end").where(F.col(start) <= F.col("latest_end"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row, by one partial aggregation."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")
