"""Statistics of many columns against numpy, and every report over the whole feature matrix."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest

from asofkit import cli
from asofkit.operators import explore, wide
from asofkit.plans import build


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = {
        "normal": rng.normal(1e6, 2, n), "tail": np.exp(rng.normal(0, 8, n)) * rng.choice([-1, 1], n), "few": rng.integers(0, 3, n).astype(float),
        "same": np.full(n, 7.5), "none": np.full(n, np.nan), "holes": np.where(rng.random(n) < 0.4, np.nan, rng.normal(0, 1, n)), "zero": np.where(rng.random(n) < 0.9, rng.choice([0.0, -0.0], n), rng.normal(0, 1, n)),
        "one": np.r_[3.0, np.full(n - 1, np.nan)],
    }
    pdf = pd.DataFrame(x)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in x)).repartition(5).cache()
    return df, pdf


def test_moments_are_those_of_the_column(numbers):
    df, pdf = numbers
    got = {r["column"]: r for r in explore.shape(df, list(pdf)).collect()}
    for c in pdf:
        v = pdf[c].dropna().to_numpy()
        r = got[c]
        assert r["n"] == len(v)
        if len(v) > 2 and v.std() > 0:
            d = v - v.mean()
            want = (v.mean(), v.var(ddof=1), (d**3).mean() / v.std() ** 3, (d**4).mean() / v.std() ** 4 - 3)
            assert np.allclose((r["mean"], r["variance"], r["skewness"], r["kurtosis"]), want, rtol=1e-7, atol=1e-9)
        else:
            assert r["skewness"] is None and r["kurtosis"] is None
    assert got["same"]["near_zero"] and got["none"]["mean"] is None and got["one"]["variance"] is None


@pytest.mark.parametrize(("buckets", "few"), [(2048, 4096), (3, 2)])
def test_places_are_exact(numbers, monkeypatch, buckets, few):
    df, pdf = numbers
    monkeypatch.setattr(wide, "BUCKETS", buckets)
    monkeypatch.setattr(wide, "FEW", few)
    columns = [c for c in pdf if pdf[c].notna().any()]
    rng = random.Random(1)
    m = wide.moments(df, columns)
    places = [sorted({0, int(n) - 1, *(rng.randrange(int(n)) for _ in range(4))}) for n in m[0]]
    found = wide.values_at(df, columns, places, m[5:])
    for c, p, v in zip(columns, places, found):
        assert v == np.sort(pdf[c].dropna().to_numpy() + 0.0)[p].tolist(), c


def test_outliers_and_nearest_quantiles(numbers):
    df, pdf = numbers
    got = {r["column"]: r for r in explore.outliers(df, list(pdf)).collect()}
    for c in pdf:
        v = pdf[c].dropna()
        q1, q3 = (v.quantile(q) for q in (0.25, 0.75))
        assert got[c]["n"] == len(v) and got[c]["iqr_outliers"] == ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum()
        assert got[c]["z_outliers"] == ((v - v.mean()).abs() > 3 * v.std()).sum()
    r = explore.nearest_quantile(df, "holes", (0.5,)).first()
    v = np.sort(pdf["holes"].dropna())
    assert (r["n"], r["q50"]) == (len(v), v[math.floor(0.5 * (len(v) - 1) + 0.5)])
    assert explore.nearest_quantile(df, "none", (0.5,)).first()["q50"] is None


def test_ranks_with_and_without_tables(numbers, monkeypatch):
    df, pdf = numbers
    columns = ["tail", "few", "holes", "zero", "same", "none"]
    ranks = (pdf[columns] + 0.0).rank()
    sent = {(r["a"], r["b"]): r for r in explore.spearman_matrix(df, columns).collect()}
    monkeypatch.setattr(wide, "RANK_VALUES", 100)
    met = {(r["a"], r["b"]): r for r in explore.spearman_matrix(df, columns).collect()}
    for (a, b), r in sent.items():
        both = ranks[a].notna() & ranks[b].notna()
        want = ranks[a][both].corr(ranks[b][both]) if both.sum() > 1 else math.nan
        for x in (r, met[a, b]):
            assert (x["r"] is None and (math.isnan(want) or "same" in (a, b))) or x["r"] == pytest.approx(want, abs=1e-9)
        assert r["n"] == both.sum()


def test_missing_by_flag(spark):
    df = spark.createDataFrame([(1.0, "x", True), (None, None, True), (None, "y", False), (2.0, None, None)], "a double, b string, obs boolean")
    got = {r["column"]: tuple(r)[1:] for r in explore.missing(df, ["a", "b"], "obs").collect()}
    assert got == {"a": (4, 2, 0.5, 0.5, 0.5), "b": (4, 2, 0.5, 0.5, 0.5)}
    assert explore.missing(df.where("1 = 0"), ["a"]).first()["share"] is None


def test_every_report_over_all_features(spark, tmp_path, monkeypatch, capsys):
    """The exploratory command on the whole training matrix of 463 features."""
    rng = np.random.default_rng(5)
    features = build.feature_names()
    assert len(features) == 463
    n = 120
    pdf = pd.DataFrame({c: np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(2)) for c in features})
    pdf["label_total_points"] = rng.integers(0, 9, n)
    pdf["label_minutes"] = rng.integers(0, 91, n)
    pdf.insert(0, "season", "2019-20")
    pdf["event"], pdf["fixture_id"], pdf["player_id"] = np.arange(n) % 38, np.arange(n), np.arange(n)
    pdf["player_code"], pdf["position"] = "p", "MID"
    for m in build.MASKED:
        pdf[m] = rng.random(n) < 0.5
    spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` {'double' if c in features else 'string' if c in ('season', 'player_code', 'position') else 'boolean' if c in build.MASKED else 'long'}" for c in pdf)).write.parquet(f"{tmp_path}/training")
    began = time.perf_counter()
    assert cli.eda(spark, str(tmp_path)) == cli.SUCCESS
    seconds = time.perf_counter() - began
    text = capsys.readouterr().out
    for title in ("Missing", "Shape", "Outliers", "High Pearson pairs", "High Spearman pairs", "Mutual information with the target", "Correlation with the target"):
        assert f"## {title}\n" in text
    assert text.count(features[10]) >= 5
    print(f"{seconds:.0f} s")
    assert seconds < 400  # many times what it takes alone
