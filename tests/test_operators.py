"""Golden cases and traps of the operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from asofkit.functions import scoring, text
from asofkit.operators import evaluate, explore, facts, gates, identity, models, pit
from asofkit.plans import build, registry
from asofkit.schema import ColumnSpec, SchemaError, TableSpec, stage

BASE = dict.fromkeys(("goals", "assists", "conceded", "saves", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "own_goals", "clearances", "tackles", "recoveries", "bonus"), 0)


def total(spark, rules="2025-26", **row):
    full = BASE | {"position": "MID", "minutes": 90} | row
    df = spark.createDataFrame([tuple(full.values())], list(full))
    items = scoring.terms(rules, {c: F.col(c) for c in full})
    return {k: int(v) for k, v in df.select(*[v.alias(k) for k, v in items.items()]).first().asDict().items()}


@pytest.mark.parametrize(("minutes", "points"), [(0, 0), (59, 1), (60, 2)])
def test_appearance(spark, minutes, points):
    assert total(spark, minutes=minutes)["appearance"] == points


@pytest.mark.parametrize(("position", "row", "points"), [("DEF", {"clearances": 9}, 0), ("DEF", {"clearances": 8, "tackles": 2}, 2), ("MID", {"clearances": 11}, 0), ("MID", {"clearances": 6, "recoveries": 6}, 2), ("GK", {"clearances": 40}, 0)])
def test_defensive_contribution(spark, position, row, points):
    assert total(spark, position=position, **row)["defensive_contribution"] == points
    assert total(spark, "legacy", position=position, **row)["defensive_contribution"] == 0


def test_saves_conceded_and_cards(spark):
    assert [total(spark, position="GK", saves=s)["saves"] for s in (3, 5, 6)] == [1, 1, 2]
    row = total(spark, position="DEF", conceded=4, red_cards=1)
    assert (row["goals_conceded"], row["red_cards"]) == (-2, -3)


def test_unknown_rules_and_position(spark):
    with pytest.raises(KeyError):
        scoring.ruleset("none")
    with pytest.raises(Exception, match="unknown position"):
        total(spark, position="COACH")


def test_trailing_goldens(spark):
    rows = [("p", i, i, g, 90.0) for i, g in enumerate([1, 0, 0, 2, 5])]
    df = spark.createDataFrame(rows, "k string, block int, f int, goals int, minutes double")
    out = {r["f"]: r for r in pit.trailing(df, ["k"], "block", ["f"], ["goals"], "minutes").collect()}
    assert out[4]["goals_sum_last_3"] == 2 and out[4]["goals_per90_last_3"] == pytest.approx(2 / 270 * 90)
    assert out[2]["goals_sum_last_3"] == 1 and out[0]["goals_sum_last_3"] is None


def test_rows_of_a_block_share_a_history(spark):
    df = spark.createDataFrame([("p", 1, 1, 3, 90.0), ("p", 2, 2, 4, 90.0), ("p", 2, 3, 9, 0.0)], "k string, block int, f int, g int, m double")
    out = {r["f"]: r["g_sum_to_date"] for r in pit.trailing(df, ["k"], "block", ["f"], ["g"], "m").collect()}
    assert out == {1: None, 2: 3, 3: 3}


def test_null_handling_differs_between_windows(spark):
    rows = [("p", i, i, v, 90.0) for i, v in enumerate([4.0, 6.0, None, None, None, None, None, 0.0])]
    df = spark.createDataFrame(rows, "k string, block int, f int, v double, m double")
    assert pit.trailing(df, ["k"], "block", ["f"], ["v"], "m", windows=(5,)).where("f = 7").first()["v_sum_last_5"] is None
    assert pit.trailing_mean(df, ["k"], "block", ["f"], "v").where("f = 7").first()["prediction"] == 5.0


def test_masked_rows_and_empty_history(spark):
    df = spark.createDataFrame([("p", 1, 1, 5, 90.0, False), ("p", 2, 2, 7, 45.0, True), ("p", 3, 3, 1, 90.0, True)], "k string, block int, f int, v int, m double, o boolean")
    out = {r["f"]: r for r in pit.trailing(df, ["k"], "block", ["f"], ["v"], "m", windows=(3,), masks={"v": "o"}).collect()}
    assert (out[3]["v_sum_last_3"], out[3]["v_per90_last_3"], out[3]["v_masked_last_3"]) == (7, 14.0, 1)
    assert (out[1]["v_sum_last_3"], out[1]["v_masked_last_3"]) == (None, 0)


def test_nothing_at_or_after_the_cut_off_leaks(spark):
    df = spark.range(400).selectExpr("id % 7 AS k", "cast(id / 7 AS int) AS block", "id AS f", "cast(hash(id) % 50 AS double) AS v", "90D AS m")
    whole = pit.trailing(df, ["k"], "block", ["f"], ["v"], "m").where("block = 30")
    cut = pit.trailing(df.where("block <= 30").withColumn("v", F.when(F.col("block") < 30, F.col("v")).otherwise(-999.0)), ["k"], "block", ["f"], ["v"], "m").where("block = 30")
    assert sorted(whole.drop("v").collect()) == sorted(cut.drop("v").collect())


def test_asof_is_strict_and_keeps_nulls(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 5)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 5, None)], "k string, at int, elo double")
    out = {r["id"]: (r["at"], r["elo"]) for r in pit.asof_strict(left, right, "k", "t", "at", ["at", "elo"]).collect()}
    assert out == {1: (4, 1.0), 2: (5, None), 3: (None, None)}


def test_range_counts_keep_their_bounds_apart(spark):
    t = lambda d, h=12: datetime(2024, 1, d, h)
    fixtures = spark.createDataFrame([("a", 1, t(1)), ("a", 2, t(8)), ("a", 3, t(8, 13))], "k string, id int, t timestamp")
    other = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 8))], "k string, date date")
    out = {r["id"]: r["count_7"] for r in pit.range_counts(fixtures, other, "k", "t", (7,)).collect()}
    assert out == {1: 0, 2: 1 + 1, 3: 1 + 1}


def test_resolution_and_overlaps(spark):
    players = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, None)], "p int, team string")
    history = spark.createDataFrame([(1, "h", datetime(2024, 1, 1)), (2, "h", datetime(2024, 1, 1)), (3, "late", datetime(2024, 3, 1))], "p int, team string, t timestamp")
    exact = spark.createDataFrame([(1, "x"), (2, None)], "p int, team string")
    out = {r["p"]: (r["team"], r["level"]) for r in pit.resolve_three(players, exact, history, "p", "team", "t", "2024-02-01").collect()}
    assert out == {1: ("x", 1), 2: ("h", 2), 3: ("r", 3), 4: (None, 0)}
    w = spark.createDataFrame([(1, 10), (2, 3), (5, 6), (11, 12)], "a int, b int")
    assert sorted(r["a"] for r in pit.overlaps(w, "a", "b").collect()) == [2, 5]


def test_staging_contract(spark):
    spec = TableSpec("t", (ColumnSpec("a", "x", "bigint"), ColumnSpec("b", "y", "double", required=False)), key=("a",))
    df, report = stage(spark.createDataFrame([("3.0", 1), ("7", 2)], "x string, z int"), spec)
    assert [tuple(r) for r in df.collect()] == [(None, None), (7, None)] and report.unknown == ("z",) and report.absent == ("b",)
    with pytest.raises(SchemaError):
        stage(spark.createDataFrame([(1,)], "q int"), spec)
    with pytest.raises(SchemaError):
        TableSpec("t", (ColumnSpec("a", "x", "int"), ColumnSpec("a", "y", "int")))
    with pytest.raises(SchemaError):
        TableSpec("t", (ColumnSpec("a", "x", "int"),), key=("b",))


def test_pair_of_more_than_two_raises(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "f int, o int")
    with pytest.raises(Exception, match="more than two"):
        facts.complete_pair(df, ["f"], "o", "t").collect()


def test_facts_edges(spark):
    d = spark.createDataFrame([(1, 5), (1, 7), (2, None)], "k int, gw int")
    assert sorted((r["k"], r["gw"]) for r in facts.keep_latest(d, ["k"], "gw").collect()) == [(1, 7), (2, None)]
    odds = spark.createDataFrame([(2.0, 4.0, 4.0), (0.0, 3.0, 3.0), (None, 2.0, 2.0)], "a double, b double, c double")
    assert [r["p"] for r in odds.select(facts.devig([F.col("a"), F.col("b"), F.col("c")])[0].alias("p")).collect()] == [0.5, None, None]
    v = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None)], "k int, c string")
    assert {r["k"]: r["tied"] for r in facts.vote(v, ["k"], "c").collect()} == {1: True, 2: False}


def test_gates_and_absent_columns(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, -1), (None, 5)], "k int, v int")
    found = {v.gate: v.rows for v in gates.run_gates(df, [gates.unique_key("k"), gates.non_negative("v"), gates.not_null("v"), gates.not_null("lost")])}
    assert found == {"not_null(lost)": 0, "unique_key(k)": 4, "in_range(v,0,None)": 1, "not_null(v)": 1}
    assert gates.run_gates(None, [gates.not_null("v")]) == []


def test_names(spark):
    assert [text.fold(n) for n in ("Nikola Bešić", "Ødegaard", "O&apos;Neil-Smith", None)] == ["nikola besic", "degaard", "oneil smith", None]
    df = spark.createDataFrame([("Brighton & Hove F.C.",), ("AFC",)], "n string")
    assert [r[0] for r in df.select(text.club(F.col("n"))).collect()] == ["brighton and hove", "afc"]
    d = spark.createDataFrame([("2025-08-16",), ("1/1/17",), ("16/8/2025",), ("x",)], "d string")
    assert [str(r[0]) for r in d.select(text.match_date(F.col("d"))).collect()] == ["2025-08-16", "2017-01-01", "2025-08-16", "None"]


def test_matched_ids(spark):
    kind = "d date, g int, h int"
    ours = spark.createDataFrame([(1, date(2025, 1, 1), 1, None), (1, date(2025, 1, 1), 1, None), (None, date(2025, 1, 1), None, None), (3, None, 1, None), (4, date(2025, 1, 2), 1, 2)], f"o int, {kind}")
    theirs = spark.createDataFrame([*[(i, date(2025, 1, 1), 1, None) for i in (5, 6, 6, 7, None)], (8, date(2025, 1, 1), None, None), (9, None, 1, None), (10, date(2025, 1, 3), 1, 2)], f"t int, {kind}")
    want = sorted(map(str, facts.match_scores(ours, theirs, "d", ["g", "h"]).select("o", "t").collect()))
    for tile in (1, 2, 256):
        assert sorted(map(str, facts.match_ids(ours, theirs, "d", ["g", "h"], "o", "t", tile).collect())) == want and len(want) == 11


def test_matched_ids_of_one_group_go_to_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ours = spark.range(300).selectExpr("id AS o", "DATE '2025-01-01' AS d", "CAST(NULL AS INT) AS g")
        theirs = spark.range(1600).selectExpr("id AS t", "DATE '2025-01-01' AS d", "CAST(NULL AS INT) AS g")
        pairs = facts.match_ids(ours, theirs, "d", ["g"], "o", "t", 5)
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == pairs.distinct().count() == 300 * 1600 and max(tasks) < 300 * 1600 // 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matched_ids_take_little_room(spark, tmp_path):
    orders = spark.range(9001).selectExpr("id * 37 AS o_orderkey", "id * 11 AS o_custkey", "TIMESTAMP '2025-01-01 00:00:00' AS o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    registry.QUERIES["null_safe_score_match"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    count = lambda k: orders.selectExpr(f"CASE WHEN {k} % 3 <> 0 THEN {k} % 10 END AS g").groupBy("g").count().collect()
    a, b = ({r["g"]: r["count"] for r in count(k)} for k in ("o_orderkey", "o_custkey"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == sum(a[g] * b.get(g, 0) for g in a)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n / 2


def test_matching_passes(spark):
    left = spark.createDataFrame([(1, "ana silva"), (2, "bruno costa dias"), (3, "rui pedro gomes"), (4, "joao felix"), (5, "luis")], "l int, name string")
    right = spark.createDataFrame([(11, "ana silva"), (12, "b dias"), (13, "gomes pedro rui"), (14, "joao maria felix sequeira"), (15, "luisa")], "r int, name string")
    out = {r["l"]: (r["r"], r["match_pass"]) for r in identity.match_names(left, right, "l", "r", "name").collect()}
    assert out == {1: (11, 1), 2: (12, 2), 3: (13, 3), 4: (14, 4)}


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, None), (2.0, 4.0, 3.0, None), (3.0, 6.1, 3.0, None)], "a double, b double, c double, d double")
    r = {(x["a"], x["b"]): x["r"] for x in explore.pearson_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert r[("a", "b")] == pytest.approx(0.99994, abs=1e-4) and r[("a", "c")] is None and r[("c", "d")] is None
    grown = spark.range(200).selectExpr("cast(id AS double) AS a", "id * 2D + id % 3 AS b", "cast(hash(id) % 100 AS double) AS c", "cast(null AS double) AS d")
    vif = {x["column"]: x["vif"] for x in explore.variance_inflation(grown, ["a", "b", "c", "d"]).collect()}
    assert vif["a"] > 100 and vif["c"] < 1.5 and "d" not in vif
    assert explore.classify(df.withColumn("obs_x", F.lit(True)), identity=["a"]) == {"a": "identity", "b": "numeric", "c": "numeric", "d": "numeric", "obs_x": "mask"}


def test_correlation_with_a_constant_over_partitions(spark):
    # 214 rows a partition: 7 / 214 * 214 isn't 7, so merged means of equal values differ.
    df = spark.range(0, 428, 1, 2).selectExpr("cast(id * id % 11 AS double) AS a", "7D AS e", "0.1D AS f", "cast(id % 3 AS int) AS g")
    assert [x["r"] for x in explore.pearson_pairs(df, ["a", "e", "f"]).collect()] == [None] * 3
    assert [tuple(x)[1:] for x in explore.target_correlation(df, ["e", "f"], "a").collect()] == [(428, None, None)] * 2
    by = df.groupBy("g").agg(explore.safe_corr(F.col("a"), F.col("e")).alias("r"), explore.safe_corr(F.col("a"), F.col("a") + 1).alias("s")).collect()
    assert [x["r"] for x in by] == [None] * 3 and [x["s"] for x in by] == [pytest.approx(1)] * 3


def test_metrics_leave_out_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, float("nan")), (None, 1.0)], "y double, p double")
    assert tuple(df.agg(*evaluate.metrics(F.col("y"), F.col("p"))).first()) == (1, 1.0, 1.0)
    same = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0)], "y double, p double")
    assert same.agg(evaluate.deviance(F.col("y"), F.col("p"))).first()[0] == pytest.approx(0, abs=1e-8)
    with pytest.raises(Exception, match="no split"):
        spark.range(1).select(evaluate.split_of(F.lit(1990))).collect()


def test_missing_contribution_counts_as_none(spark):
    row = {c: 0.0 for c in BASE} | {"minutes": 90.0, "contribution": None}
    df = spark.createDataFrame([("DEF", *row.values())], "position string, " + ", ".join(f"{c} double" for c in row))
    cols = {c: F.col(c) for c in df.columns}
    assert df.select(scoring.predicted_points("2025-26", cols)).first()[0] == 6.0
    assert df.select(scoring.predicted_points("2025-26", cols | {"goals": F.lit(None).cast("double")})).first()[0] is None


def test_ridge_recovers_weights(spark):
    df = spark.range(300).selectExpr("cast(id % 17 AS double) AS x", "CASE WHEN id % 5 <> 0 THEN cast(id % 11 AS double) END AS z", "id % 17 * 3D + 1 AS y")
    m = models.fit_ridge(df, ["x", "z"], "y", alpha=1e-6)
    worst = df.select(F.max(F.abs(m.predict() - F.col("y")))).first()[0]
    assert worst < 1e-3 and m.prepared.indicators == ["z"]
    assert models.fit_ridge(df.where("1 = 0"), ["x"], "y") is None


def player_rows(spark, n_events=4):
    stats = [
        (s, 100 * e + f, p, f"c{p}", 2 if p < 3 else 1, p < 3, f"{s[:4]}-0{e + 1}-01T15:00:00Z", e, "MID", 90, 1, p, 0, 1, 0, 0, 0, 0, 0, 0, 3, 5, p)
        for s in ("2023-24", "2024-25") for e in range(n_events) for f in (0,) for p in (1, 2, 3)
    ]
    names = "season string, fixture_id long, player_id long, player_code string, opponent_team long, was_home boolean, kickoff_time string, event long, position string, minutes long, starts long, goals_scored long, assists long, goals_conceded long, own_goals long, penalties_saved long, penalties_missed long, yellow_cards long, red_cards long, saves long, clearances_blocks_interceptions long, total_points_published long, bonus_published long"
    return spark.createDataFrame(stats, names)


def test_player_facts_and_training_matrix(spark):
    teams = spark.createDataFrame([(s, t, t * 10) for s in ("2023-24", "2024-25") for t in (1, 2)], "season string, team_id long, code long")
    player = build.player_facts(player_rows(spark), teams)
    assert len(player.columns) == 53 - 4 + 4 and player.where("team_id = opponent_team_id").count() == 0
    one = player.where("player_id = 1 and event = 0").orderBy("season").first()
    assert (one["team_id"], one["team_code"], one["opponent_team_code"], one["obs_defensive"], one["obs_expected"]) == (1, 10, 20, True, False)
    blank = spark.createDataFrame([], "season string, fixture_id long, team_id long, " + ", ".join(f"{c} double" for c in build.CONTEXT))
    m = build.training_matrix(player, blank)
    assert len(build.feature_names()) == 463 and len(m.columns) == 9 + 4 + 463 + 13
    row = m.where("player_id = 2 and season = '2024-25' and event = 2").first()
    assert (row["goals_scored_sum_last_3"], row["goals_scored_sum_last_season"], row["cbi_masked_last_3"], row["expected_goals_masked_last_3"]) == (4, 8, 0, 2)
    p = build.points(player, "2025-26").where("player_id = 2 and event = 0").first()
    assert p["total_points"] == 2 + 10 + 0 + 0 + 2


def test_team_facts(spark):
    fixtures = spark.createDataFrame([("2024-25", 1, 10, 20, datetime(2024, 9, 1, 15)), ("2024-25", 2, 20, 10, datetime(2024, 9, 6, 15))], "season string, fixture_id long, team_h long, team_a long, kickoff_time timestamp")
    ratings = spark.createDataFrame([(10, date(2024, 8, 31), 1500.0), (10, date(2024, 9, 1), 1600.0), (20, date(2024, 8, 1), 1400.0)], "team long, as_of_date date, elo double")
    odds = spark.createDataFrame([("2024-25", 10, 20, date(2024, 9, 6), 2.0, 4.0, 4.0)], "season string, home long, away long, match_date date, odds_h double, odds_d double, odds_a double")
    other = spark.createDataFrame([(10, date(2024, 9, 4))], "team long, date date")
    out = {(r["fixture_id"], r["team_id"]): r for r in build.team_facts(fixtures, ratings, odds, other).collect()}
    assert len(out) == 4 and out[(1, 10)]["elo_rating"] == 1500.0 and out[(2, 20)]["opponent_elo_rating"] == 1600.0
    assert out[(2, 10)]["fixture_count_prior_7_days"] == 2 and out[(2, 20)]["fixture_count_prior_7_days"] == 1
    assert out[(2, 10)]["odds_win_prob"] == 0.5 and out[(2, 20)]["odds_loss_prob"] == 0.5 and out[(1, 10)]["odds_win_prob"] is None


def test_matrix_of_pairs_and_ranks_and_sample(spark):
    rows = [(i % 7, float(i * i % 11), None if i % 3 == 0 else i % 5, 4) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b double, c int, d int")
    every = ["a", "b", "c", "d"]
    near = lambda x: {(r["a"], r["b"]): None if r["r"] is None else round(r["r"], 9) for r in x.collect()}
    assert near(explore.pearson_matrix(df, every)) == near(explore.pearson_pairs(df, every))
    got = sorted(tuple(-1.0 if v is None else v for v in r) for r in explore.ranked(df, every).collect())
    pdf = df.toPandas().rank(method="average").fillna(-1.0)
    assert got == sorted(map(tuple, pdf.to_numpy().tolist()))
    one, two = (sorted(map(str, explore.sample(d, 9, 3).collect())) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 9
    wide = df.select("*", *[(F.col("b") * (i % 4 + 1) + F.col("a") * i).alias(f"x{i}") for i in range(120)])
    assert explore.pearson_matrix(wide, wide.columns).count() == 124 * 123 // 2


def test_bucket_without_rows_counts_none(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, None), (9.0, 7.0)], "y double, p double")
    got = {r["bucket"]: (r["n"], r["mae"]) for r in evaluate.bucket_report(df, "y", "p").collect()}
    assert got == {"overall": (2, 1.5), "zeros": (1, 1.0), "blanks": (0, None), "tickers": (0, None), "haulers": (1, 2.0)}
