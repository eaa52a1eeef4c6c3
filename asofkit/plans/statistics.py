"""Queries of exploration, evaluation and the baseline models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.scoring import outcome_bucket
from asofkit.operators import evaluate, explore, models

from .registry import SQL, query, rows

NUMBERS = """SELECT l_orderkey AS id, l_quantity AS a, l_extendedprice AS b, CASE WHEN l_orderkey % 4 <> 0 THEN l_discount END AS c, CASE WHEN l_partkey % 3 <> 0 THEN l_tax + l_quantity / 100 END AS d,
 CAST(7 AS DOUBLE) AS e, l_returnflag <> 'N' AS obs_x FROM lineitem"""
COLUMNS = ("a", "b", "c", "d", "e")


def _per_column(item: str, columns=COLUMNS) -> str:
    return " UNION ALL ".join(item.replace("{c}", c) for c in columns)


def _round(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(f"WITH t AS ({NUMBERS}) " + _per_column("SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS share, round(avg(CAST({c} IS NULL AS INTEGER)) FILTER (obs_x), 6) AS share_observed, round(avg(CAST({c} IS NULL AS INTEGER)) FILTER (NOT obs_x), 6) AS share_unobserved FROM t"))
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.missing(rows(spark, sf_dir, NUMBERS), COLUMNS, "obs_x"))


_BY = f"SELECT *, CAST(id % 5 AS INTEGER) AS season FROM ({NUMBERS})"


@query(f"WITH t AS ({_BY}) " + _per_column("SELECT '{c}' AS \"column\", season, count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS share FROM t GROUP BY season"))
def missing_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.missing_by(rows(spark, sf_dir, _BY), COLUMNS, "season"))


@query(f"WITH t AS (SELECT *, CASE WHEN a <= 3 THEN 'blanks' WHEN a <= 8 THEN 'tickers' WHEN a > 8 THEN 'haulers' END AS band FROM ({NUMBERS})) " + _per_column("SELECT '{c}' AS \"column\", band, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM t GROUP BY band", ("b", "c", "d")))
def target_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.target_bands(rows(spark, sf_dir, NUMBERS), ("b", "c", "d"), outcome_bucket(F.col("a"))), 4)


@query(f"WITH t AS ({NUMBERS}) " + _per_column("SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(max(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS n_unique FROM t"))
def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.cardinality(rows(spark, sf_dir, NUMBERS), COLUMNS)


_M = "(SELECT avg({c}) FROM t)"


@query(f"WITH t AS ({NUMBERS}) " + _per_column(f"""SELECT '{{c}}' AS "column", count({{c}}) AS n, round(avg({{c}}), 4) AS mean, round(var_samp({{c}}), 2) AS variance, coalesce(var_samp({{c}}) < 1e-8, false) AS near_zero,
 round(CASE WHEN var_pop({{c}}) > 0 THEN avg(({{c}} - {_M}) ** 3) / var_pop({{c}}) ** 1.5 END, 6) AS skewness, round(CASE WHEN var_pop({{c}}) > 0 THEN avg(({{c}} - {_M}) ** 4) / var_pop({{c}}) ** 2 - 3 END, 6) AS kurtosis FROM t"""))
def variance_skew_kurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = explore.shape(rows(spark, sf_dir, NUMBERS), COLUMNS)
    return s.select("column", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), "near_zero", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query(f"WITH t AS ({NUMBERS}) " + _per_column("""SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (abs({c} - m) > 3 * s) AS z_outliers, count({c}) AS n
 FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM t)"""))
def outliers_iqr_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.outliers(rows(spark, sf_dir, NUMBERS), COLUMNS)


@query(f"WITH t AS ({NUMBERS}), s AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM t WHERE b IS NOT NULL) SELECT max(n) AS n, max(b) FILTER (i = floor(0.25 * (n - 1) + 0.5)) AS q25, max(b) FILTER (i = floor(0.75 * (n - 1) + 0.5)) AS q75 FROM s")
def nearest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.nearest_quantile(rows(spark, sf_dir, NUMBERS), "b", (0.25, 0.75))


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
_CORR = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) END"


@query(f"WITH t AS ({NUMBERS}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_CORR} AS r FROM (SELECT {a} AS x, {b} AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS))
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.pearson_pairs(rows(spark, sf_dir, NUMBERS), COLUMNS))


@query(f"SELECT a, b, r FROM ({SQL['pearson_pairs']}) WHERE abs(r) > 0.5")
def high_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.high_pairs(_round(explore.pearson_pairs(rows(spark, sf_dir, NUMBERS), COLUMNS)), 0.5)


def _rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}"


@query(f"WITH t AS (SELECT {', '.join(map(_rank, COLUMNS))} FROM ({NUMBERS})) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_CORR} AS r FROM (SELECT {a} AS x, {b} AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS))
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.spearman_pairs(rows(spark, sf_dir, NUMBERS), COLUMNS))


@query(f"WITH t AS ({NUMBERS}) " + _per_column(f"""SELECT '{{c}}' AS "column", count(*) AS n, {_CORR} AS pearson, {_CORR.replace('(x', '(rx').replace('(y', '(ry').replace(', y)', ', ry)')} AS spearman
 FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT {{c}} AS x, b AS y FROM t WHERE {{c}} IS NOT NULL AND b IS NOT NULL))""", ("a", "c", "d", "e")))
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.target_correlation(rows(spark, sf_dir, NUMBERS), ("a", "c", "d", "e"), "b"))


def _det(m: list[list[str]]) -> str:
    """SQL of a determinant, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {x} * {_det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j, x in enumerate(m[0])) + ")"


def _without(m: list[list[str]], i: int) -> list[list[str]]:
    return [r[:i] + r[i + 1 :] for k, r in enumerate(m) if k != i]


#: The columns with a variance. A diagonal element of an inverse is a quotient of determinants.
_VARY = COLUMNS[:4]
_R = [["1" if a == b else f"r{min(a, b)}{max(a, b)}" for b in _VARY] for a in _VARY]


@query(f"WITH r AS (SELECT {', '.join(f'corr({a}, {b}) AS r{a}{b}' for a, b in _PAIRS if b in _VARY)} FROM ({NUMBERS}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _VARY)}) "
       + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round({_det(_without(_R, i))} / {_det(_R)}, 6) AS vif FROM r" for i, c in enumerate(_VARY)))
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.variance_inflation(rows(spark, sf_dir, NUMBERS), COLUMNS))


@query(f"""WITH t AS (SELECT a AS x, b AS y FROM ({NUMBERS})), g AS (SELECT least(9, floor((x - (SELECT min(x) FROM t)) / (SELECT max(x) - min(x) FROM t) * 10)) AS i, least(9, floor((y - (SELECT min(y) FROM t)) / (SELECT max(y) - min(y) FROM t) * 10)) AS j FROM t),
c AS (SELECT i, j, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM c)
SELECT 'a' AS "column", round(sum(n / t * ln(n * t / (ni * nj))), 6) AS mi FROM m""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(explore.mutual_information(rows(spark, sf_dir, NUMBERS), ["a"], "b"))


@query(f"""WITH t AS ({NUMBERS}), e AS (SELECT min(b) AS l, (max(b) - min(b)) / 30 AS w FROM t) SELECT CAST(least(29, floor((b - l) / w)) AS INTEGER) AS bin, count(*) AS n FROM t, e GROUP BY ALL""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.histogram(rows(spark, sf_dir, NUMBERS), "b").select("bin", "n")


#: Realised totals and predictions of them, some missing.
SCORED = """SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderkey % 14 AS DOUBLE) - 2 AS y,
 CASE WHEN o_orderkey % 17 <> 0 THEN CAST((o_orderkey % 14 + o_custkey % 5) AS DOUBLE) / 1.5 END AS p FROM orders"""
_ERR = "count(p) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse"


@query(f"SELECT season, {_ERR} FROM ({SCORED}) GROUP BY season")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rows(spark, sf_dir, SCORED).groupBy("season").agg(*evaluate.metrics(F.col("y"), F.col("p"))))


@query(f"SELECT season, round(2 * avg(CASE WHEN y > 0 THEN y * ln(y / greatest(p, 1e-9)) ELSE 0 END - (y - greatest(p, 1e-9))), 6) AS deviance FROM (SELECT season, y + 2 AS y, p FROM ({SCORED})) WHERE p IS NOT NULL GROUP BY season")
def poisson_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rows(spark, sf_dir, SCORED).groupBy("season").agg(evaluate.deviance(F.col("y") + 2, F.col("p"))))


@query(f"""WITH t AS (SELECT *, CASE WHEN y <= 0 THEN 'zeros' WHEN y <= 3 THEN 'blanks' WHEN y <= 8 THEN 'tickers' ELSE 'haulers' END AS bucket FROM ({SCORED}))
SELECT 'overall' AS bucket, {_ERR} FROM t UNION ALL SELECT bucket, {_ERR} FROM t GROUP BY bucket""")
def bucket_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.bucket_report(rows(spark, sf_dir, SCORED), "y", "p"))


@query(f"""SELECT season, month, count(*) AS n, {_CORR.replace('(x', '(rx').replace('(y', '(ry').replace(', y)', ', ry)')} AS spearman FROM (SELECT season, month,
 rank() OVER (PARTITION BY season, month ORDER BY y) + (count(*) OVER (PARTITION BY season, month, y) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY season, month ORDER BY p) + (count(*) OVER (PARTITION BY season, month, p) - 1) / 2.0 AS ry
 FROM ({SCORED}) WHERE p IS NOT NULL) GROUP BY season, month""")
def spearman_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.rank_correlation(rows(spark, sf_dir, SCORED), ["season", "month"], "y", "p"))


@query(f"SELECT CASE WHEN season < 2000 THEN 'train' WHEN season = 2000 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM ({SCORED}) GROUP BY ALL")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = {**{y: "train" for y in range(1980, 2000)}, 2000: "validation", **{y: "test" for y in range(2001, 2030)}}
    return rows(spark, sf_dir, SCORED).groupBy(evaluate.split_of(F.col("season"), splits).alias("split")).agg(F.count("*").alias("n"))


MODELLED = "SELECT l_returnflag AS segment, l_orderkey AS id, l_linenumber AS line, l_quantity AS x1, CASE WHEN l_orderkey % 6 <> 0 THEN l_discount END AS x2, l_tax AS x3, l_extendedprice / 1000 AS y, CAST(floor(l_quantity / 20) AS DOUBLE) AS c FROM lineitem"


def _segments(d: DataFrame) -> list[str]:
    return sorted(r[0] for r in d.select("segment").distinct().collect())  # positions or the like: a few


#: Features as prepared: medians in place of nulls, an indicator, and standard scores z1 to z4; z0 is the constant.
_K = range(1, 5)
_PREPARED = f"""t AS ({MODELLED}), m AS (SELECT segment, quantile_cont(x2, 0.5) AS middle FROM t GROUP BY segment),
f AS (SELECT t.*, x1 AS f1, coalesce(x2, middle) AS f2, x3 AS f3, CAST(x2 IS NULL AS DOUBLE) AS f4 FROM t JOIN m USING (segment)),
s AS (SELECT segment, count(*) AS n, avg(y) AS my, avg(c) AS mc, {", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in _K)} FROM f GROUP BY segment),
z AS MATERIALIZED (SELECT f.*, n, my, mc, 1.0 AS z0, {", ".join(f"(f{i} - m{i}) / s{i} AS z{i}" for i in _K)} FROM f JOIN s USING (segment))"""


def _solved(m: str, v: str, k: range) -> str:
    """SQL of the solution of a system with the matrix m11, m12 and so on and the right side v1 and so on, by Cramer's rule."""
    a = [[f"{m}{min(i, j)}{max(i, j)}" for j in k] for i in k]
    with_v = lambda c: [[f"{v}{i}" if j == c else x for j, x in zip(k, r)] for i, r in zip(k, a)]
    return ", ".join(f"{_det(with_v(c))} / {_det(a)} AS w{c}" for c in k)


_RIDGE = f"""WITH {_PREPARED}, g AS (SELECT segment, {", ".join(f"sum(z{i} * z{j}) + {int(i == j)} AS m{i}{j}" for i in _K for j in _K if i <= j)}, {", ".join(f"sum(z{i} * (y - my)) AS v{i}" for i in _K)} FROM z GROUP BY segment),
w AS (SELECT segment, {_solved("m", "v", _K)} FROM g) SELECT id, line, round(my + {" + ".join(f"w{i} * z{i}" for i in _K)}, 4) AS prediction FROM z JOIN w USING (segment)"""


@query(_RIDGE)
def ridge_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, MODELLED)
    fitted = {s: models.fit_ridge(d.where(F.col("segment") == s), ["x1", "x2", "x3"], "y") for s in _segments(d)}
    return d.select("id", "line", F.round(models.by_segment(d, "segment", fitted), 4).alias("prediction"))


def _newton(steps: int) -> str:
    """Newton's steps from a constant prediction, for the likelihood with half the squared weights off for each row."""
    k = range(5)
    out = ["w0 AS (SELECT segment, ln(mc) AS w0, 0.0 AS w1, 0.0 AS w2, 0.0 AS w3, 0.0 AS w4 FROM s)"]
    eta = " + ".join(f"w{i} * z{i}" for i in k)
    for t in range(steps):
        m = ", ".join(f"sum(mu * z{i} * z{j}) + {'any_value(n)' if i == j > 0 else 0} AS m{i}{j}" for i in k for j in k if i <= j)
        v = ", ".join(f"sum((c - mu) * z{i}) - {f'any_value(n * w{i})' if i else 0} AS v{i}" for i in k)
        out.append(f"g{t} AS MATERIALIZED (SELECT segment, {m}, {v} FROM (SELECT *, exp({eta}) AS mu FROM z JOIN w{t} USING (segment)) GROUP BY segment)")
        out.append(f"d{t} AS (SELECT segment, {_solved('m', 'v', k)} FROM g{t})")
        out.append(f"w{t + 1} AS MATERIALIZED (SELECT w.segment, {', '.join(f'w.w{i} + d.w{i} AS w{i}' for i in k)} FROM w{t} w JOIN d{t} d USING (segment))")
    return ", ".join(out) + f" SELECT id, line, round(greatest(0, least(1, x1 * 2 / 90)) * exp({eta}), 4) AS prediction FROM z JOIN w{steps} USING (segment)"


@query(f"WITH {_PREPARED}, {_newton(8)}")
def poisson_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, MODELLED)
    fitted = {s: models.fit_poisson(d.where(F.col("segment") == s), ["x1", "x2", "x3"], "c") for s in _segments(d)}
    return d.select("id", "line", F.round(models.two_stage(F.col("x1") * 2, models.by_segment(d, "segment", fitted)), 4).alias("prediction"))
