"""Matching entities across sources, and the crosswalks that record the matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.text import either_subsequence, full_club, tokens


def canonical(df: DataFrame, code: str, name: str, season: str) -> DataFrame:
    """One row a code: first and last season, latest name, all names in order of appearance, and their number."""
    first = df.where(F.col(name).isNotNull()).groupBy(code, name).agg(F.min(season).alias("_s"))
    names = first.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", name))), lambda x: x[name]).alias("name_variants"))
    spans = df.groupBy(code).agg(F.min(season).alias("first_season"), F.max(season).alias("last_season"), F.max_by(name, F.struct(season, name)).alias("name"))
    return spans.join(names, code, "left").withColumn("n_names", F.coalesce(F.size("name_variants"), F.lit(0)))


def odd_variants(crosswalk: DataFrame, folded: str) -> DataFrame:
    """Rows whose latest name shares no token with some earlier one; ``folded`` holds the folded variants in order."""
    last = tokens(F.element_at(folded, -1))
    return crosswalk.where(F.exists(folded, lambda v: ~F.arrays_overlap(tokens(v), last)))


def _spread(df: DataFrame, key: str, i: str) -> DataFrame:
    """The least and greatest id of each key, which tell whether it has one id, however many rows share it."""
    return df.groupBy(key).agg(F.min(i).alias("_lo"), F.max(i).alias("_hi"))


def _unique(pairs: DataFrame, left: str, right: str, passed: int) -> DataFrame:
    """Left ids with exactly one distinct candidate, from candidates' least and greatest ids."""
    ends = pairs.groupBy(left).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return ends.where("_lo = _hi").select(left, F.col("_lo").alias(right), F.lit(passed).alias("match_pass"))


def _contained(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left_id, _lo and _hi for the names one of which has the other's tokens in order.

    Different token lists are compared once, whatever number of rows has them. The contained list's
    rarest token is in the other one too, so a list is looked up by that token alone.
    """
    lists = right.groupBy("_t").agg(F.min(right_id).alias("_lo"), F.max(right_id).alias("_hi")).withColumnRenamed("_t", "_b")
    asked = left.select(F.col("_t").alias("_a")).distinct()

    def met(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        each = lambda d, c: d.select("*", F.explode(F.array_distinct(c)).alias("_k"))
        within = each(long, t)
        often = within.groupBy("_k").agg(F.count("*").alias("_f"))
        kept = [F.col(c) for c in short.columns if c != s]
        rare = F.min_by("_k", F.struct("_f", "_k")).alias("_k")
        # A list with a token that no other has can't be contained.
        some = each(short, s).join(often, "_k").groupBy(s, *kept).agg(rare, F.count("*").alias("_n")).where(F.col("_n") == F.size(F.array_distinct(s))).drop("_n")
        return some.join(within, "_k").select("_a", "_b", "_lo", "_hi")

    pairs = met(asked, "_a", lists, "_b").unionByName(met(lists, "_b", asked, "_a")).where(either_subsequence(F.col("_a"), F.col("_b")))
    ends = pairs.groupBy("_a").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return left.join(ends, F.col("_t") == F.col("_a")).select(left_id, "_lo", "_hi")


def match_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, passes: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """left_id, right_id and match_pass for the names that match uniquely, pass by pass.

    Pass 1 compares whole folded names, 2 the last token and the first letter, 3 the sorted
    tokens, each an equality join on a derived key; 4 looks for one name's tokens in order within
    the other, among pairs that share the contained name's rarest token, so it needs no product of
    all pairs. Candidates are aggregated by key or token list before they meet the left names.
    A later pass sees only what earlier ones left unmatched on the left; several candidates of
    one pass are no match and go on.
    """

    def keyed(df: DataFrame, i: str) -> DataFrame:
        t = tokens(F.col(name))
        return df.select(F.col(i), F.col(name).alias("_name"), t.alias("_t")).where(F.size("_t") > 0)

    keys: dict[int, Column] = {
        1: F.col("_name"),
        2: F.concat_ws("|", F.element_at("_t", -1), F.substring(F.element_at("_t", 1), 1, 1)),
        3: F.array_join(F.array_sort("_t"), " "),
    }
    todo, others = keyed(left, left_id), keyed(right, right_id)
    found = None
    for p in passes:
        if p < 4:
            pairs = todo.select(left_id, keys[p].alias("_k")).join(_spread(others.select(right_id, keys[p].alias("_k")), "_k", right_id), "_k")
        else:
            pairs = _contained(todo, others, left_id, right_id)
        got = _unique(pairs, left_id, right_id, p)
        found = got if found is None else found.unionByName(got)
        todo = todo.join(got.select(left_id), left_id, "left_anti")
    return found


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str) -> DataFrame:
    """left_id and right_id where exactly one right name shares a token."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(tokens(F.col(name)))).alias("_w"))
    pairs = words(left, left_id).join(_spread(words(right, right_id), "_w", right_id), "_w")
    return _unique(pairs, left_id, right_id, 0).drop("match_pass")


def first_resolved(matches: DataFrame, key: str, match: str, season: str) -> DataFrame:
    """The match of each key's earliest season that has one."""
    return matches.where(F.col(match).isNotNull()).groupBy(key).agg(F.min_by(match, F.struct(season, match)).alias(match), F.min(season).alias(season))


def merge_keeping(existing: DataFrame, draft: DataFrame, key: str) -> DataFrame:
    """All existing rows, and those drafted ones whose key is new."""
    return existing.unionByName(draft.join(existing.select(key), key, "left_anti"))


def unmapped(facts: DataFrame, crosswalk: DataFrame, key: str, weight: str) -> DataFrame:
    """Keys with a positive weight that the crosswalk doesn't have."""
    return facts.where(F.col(weight) > 0).join(crosswalk.select(key), key, "left_anti").groupBy(key).agg(F.sum(weight).alias(weight))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of which either side occurs with another partner too."""
    w = lambda c, o: F.size(F.collect_set(o).over(Window.partitionBy(c)))
    return df.withColumns({"_a": w(a, b), "_b": w(b, a)}).where("_a > 1 or _b > 1").drop("_a", "_b")


def unmapped_names(names: DataFrame, crosswalk: DataFrame, name: str, aliases: str) -> DataFrame:
    """The different names that no row of the crosswalk has among its aliases (an array column)."""
    known = crosswalk.select(F.explode(aliases).alias(name)).distinct()
    return names.where(F.col(name).isNotNull()).select(name).distinct().join(known, name, "left_anti")


def mapped_names(names: DataFrame, crosswalk: DataFrame, name: str, aliases: str) -> DataFrame:
    """The different names that are in both: a row of the crosswalk has them among its aliases."""
    known = crosswalk.select(F.explode(aliases).alias(name)).distinct()
    return names.where(F.col(name).isNotNull()).select(name).distinct().join(known, name, "left_semi")


def collect_names(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """source and name of all different names in the given columns of each source's table."""
    out = None
    for source, (df, columns) in tables.items():
        names = df.select(F.lit(source).alias("source"), F.explode(F.array(*[F.col(c) for c in columns])).alias("name")).where("name is not null")
        out = names if out is None else out.unionByName(names)
    return out.distinct()


def team_crosswalk(teams: DataFrame) -> DataFrame:
    """season, team_id, team_code and team_name of every season; a code with two names in one season, or a team with two codes, raises when it is read.

    teams: season, team_id, code, name; a row without a name takes the latest name of its code.
    """
    rows = teams.select("season", "team_id", F.col("code").alias("team_code"), F.col("name").alias("team_name")).distinct()
    latest = rows.where(F.col("team_name").isNotNull()).groupBy("team_code").agg(F.max_by("team_name", F.struct("season", "team_name")).alias("_latest"))
    of = lambda *k: rows.groupBy(*k)
    codes = of("season", "team_id").agg(F.min("team_code").alias("team_code"), (F.min("team_code") != F.max("team_code")).alias("_two"))
    names = of("season", "team_code").agg(F.min("team_name").alias("_name"), (F.min("team_name") != F.max("team_name")).alias("_names"))
    out = codes.join(names, ["season", "team_code"], "left").join(latest, "team_code", "left")
    bad = F.raise_error(F.concat(F.lit("more than one name or code for team "), F.col("team_id").cast("string"), F.lit(" of "), F.col("season"))).cast("string")
    wrong = F.coalesce(F.col("_two"), F.lit(False)) | F.coalesce(F.col("_names"), F.lit(False))
    return out.select("season", "team_id", "team_code", F.when(wrong, bad).otherwise(F.coalesce("_name", "_latest")).alias("team_name"))


def draft_external_names(teams: DataFrame, names: DataFrame, sources: Sequence[str]) -> DataFrame:
    """team_code, team_name and for each source the array of its names that share a word with this club alone.

    teams: team_code, team_name (one row a code). names: source, name. Short forms count as full names.
    """
    ours = teams.select("team_code", full_club(F.col("team_name")).alias("_full"))
    theirs = names.select("source", F.col("name").alias("_alias"), full_club(F.col("name")).alias("_full"))
    found = token_overlap(theirs.select(F.struct("source", "_alias").alias("_id"), "_full"), ours, "_id", "team_code", "_full")
    per = [F.array_sort(F.collect_set(F.when(F.col("_id.source") == s, F.col("_id._alias")))).alias(s) for s in sources]
    drafted = found.groupBy("team_code").agg(*per)
    none = F.array().cast("array<string>")
    return teams.select("team_code", "team_name").join(drafted, "team_code", "left").select("team_code", "team_name", *[F.coalesce(s, none).alias(s) for s in sources])


def refresh_external_names(existing: DataFrame, draft: DataFrame, sources: Sequence[str]) -> DataFrame:
    """The existing rows, their empty cells filled from the draft, and the draft's new codes; no filled cell changes."""
    d = draft.select("team_code", F.col("team_name").alias("_n"), *[F.col(s).alias(f"_{s}") for s in sources])
    both = existing.join(d, "team_code", "full")
    return both.select("team_code", F.coalesce("team_name", "_n").alias("team_name"), *[F.when(F.size(F.coalesce(s, F.array().cast("array<string>"))) > 0, F.col(s)).otherwise(F.coalesce(f"_{s}", s)).alias(s) for s in sources])
