"""Leaf-wise boosting, forest bands, seasonal ARIMA and tenant models against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import boosting, mlforecast as ML
from bizlens.operators.arima import SeasonalARIMA
from bizlens.operators.boosting import boost


def plain_leafwise(x, y, edges, *, trees, leaves, rate, min_rows):
    """One split after the other, always the leaf with the largest gain; returns (predictions, splits per feature)."""
    bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    f = np.full(len(y), y.mean())
    used = np.zeros(x.shape[1], int)

    def best(rows, g):
        top = None
        scale = max(1e-300, sum(np.abs(np.bincount(bins[rows, 0], g[rows], 256)).sum() for _ in (0,)))
        for j in range(bins.shape[1]):
            for b in range(1, 256):
                left = rows[bins[rows, j] < b]
                right = rows[bins[rows, j] >= b]
                if len(left) < min_rows or len(right) < min_rows:
                    continue
                gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[rows].sum() ** 2 / len(rows)
                if top is None or gain > top[0] * (1 + 1e-9) + 1e-9 * scale:
                    top = (gain, j, b)
        return top if top and top[0] > 1e-9 * scale else None

    for _ in range(trees):
        g = y - f
        parts = [np.arange(len(y))]
        offers = {0: best(parts[0], g)}
        while len([p for p in parts if p is not None]) < leaves and any(offers.values()):
            k = max((o for o in offers if offers[o]), key=lambda o: (offers[o][0], -o))
            _, j, b = offers.pop(k)
            rows = parts[k]
            used[j] += 1
            parts[k] = None
            for side in (rows[bins[rows, j] < b], rows[bins[rows, j] >= b]):
                parts.append(side)
                offers[len(parts) - 1] = best(side, g)
        if len(parts) == 1:
            break
        for rows in parts:
            if rows is not None:
                f[rows] += rate * g[rows].mean()
    return f, used


def test_leafwise_boosting_equals_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 400
    x = np.column_stack([rng.integers(0, 30, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)]).astype(float)
    y = 3 * (x[:, 0] > 12) * x[:, 1] + x[:, 2] ** 2 + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)
    opts = {"trees": 6, "leaves": 7, "rate": 0.3, "min_rows": 15}
    monkeypatch.setattr(boosting, "PART_BLOCKS", 1)  # several tasks exchange their sums
    model = boost(df, ["a", "b", "c"], "y", bins=40, **opts)
    want, used = plain_leafwise(x, y, model.edges, **opts)
    assert np.allclose(model.predict(list(x.T)), want, rtol=1e-9, atol=1e-9)
    share = dict(model.importance())
    assert np.allclose([share[c] for c in "abc"], used / used.sum())
    assert [len(t.value) for t in model.trees] == [7] * 6
    got = model.transform(df).toPandas()
    assert np.allclose(np.sort(got["prediction"]), np.sort(want))
    assert ((got["y"] - got["prediction"]) ** 2).mean() < 0.5 * y.var()


def test_boosting_of_nothing_and_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 50, "a double, y double")
    assert boost(df, ["a"], "y", trees=3).predict([np.array([1.0])]).tolist() == [2.0]
    assert boost(df.limit(0), ["a"], "y", trees=3).trees == []


def month(year, i):
    return dt.datetime(year + i // 12, i % 12 + 1, 1)


def _series(spark, groups=("a", "b"), n=60, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k, g in enumerate(groups):
        season = 10 * np.sin(2 * np.pi * np.arange(n) / 12 + k)
        y = 100 + (1 + k) * np.arange(n) + season + rng.normal(scale=2, size=n)
        rows += [(g, month(2015, i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz, y double")


def test_forest_band_is_the_spread_of_its_trees(spark):
    s = _series(spark)
    rf = ML.random_forest(trees=8, depth=4)
    fitted = rf.fit(s, ["g"])
    bands = rf.predict_bands(fitted, 3, ["g"]).toPandas()
    assert len(bands) == 6 and (bands["lower_bound"] <= bands["forecast"]).all() and (bands["upper_bound"] > bands["lower_bound"]).any()
    # the same first step by Spark ML's own prediction, and the spread by its trees
    state = fitted.state.withColumn("next_ts", F.add_months(F.col("ts").cast("date"), 1).cast("timestamp_ntz"))
    feats = state.select("*", *[F.element_at("hist", -k).alias(f"y_lag_{k}") for k in (1, 2, 3)], *ML._month_features(F.col("next_ts")))
    base = fitted.model.transform(feats).select("g", "prediction", "features").collect()
    forest = fitted.model.stages[-1]
    for r in base:
        each = np.array([t.predict(r.features) for t in forest.trees])
        b = bands[(bands["g"] == r.g) & (bands["step"] == 1)].iloc[0]
        assert b["forecast"] == pytest.approx(r.prediction, rel=1e-9) == pytest.approx(each.mean(), rel=1e-9)
        assert b["upper_bound"] - b["forecast"] == pytest.approx(1.96 * each.std(), rel=1e-6, abs=1e-9)


def test_arima_bands_cover_simulated_futures(spark):
    """Series of the model itself: the 80 % band holds about 80 % of the true continuations."""
    rng = np.random.default_rng(11)
    n, h, s = 132, 6, 12
    rows, future = [], {}
    for k in range(120):
        e = rng.normal(size=n + h + 50)
        d = np.zeros(n + h + 50)
        for t in range(s + 1, len(d)):
            d[t] = 0.4 * d[t - 1] + 0.3 * d[t - s] - 0.12 * d[t - s - 1] + e[t] - 0.5 * e[t - 1]
        y = np.zeros(len(d))
        y[:s + 1] = 50 + rng.normal(size=s + 1)
        for t in range(s + 1, len(d)):
            y[t] = y[t - 1] + y[t - s] - y[t - s - 1] + d[t]
        y = y[50:]
        rows += [(k, month(2000, i), float(v)) for i, v in enumerate(y[:n])]
        future[k] = y[n:]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, y double")
    m = SeasonalARIMA(s)
    got = m.predict_bands(m.fit(df, ["k"]), h, ["k"]).collect()
    assert len(got) == 120 * h
    inside = [r.lower_bound <= future[r.k][r.step - 1] <= r.upper_bound for r in got]
    assert 0.70 <= np.mean(inside) <= 0.88
    width = {step: np.mean([r.upper_bound - r.lower_bound for r in got if r.step == step]) for step in range(1, h + 1)}
    assert all(width[k] < width[k + 1] for k in range(1, h))


def test_arima_of_short_series_repeats_the_season(spark):
    rows = [("s", month(2020, i), float(i % 12)) for i in range(20)] + \
        [("t", month(2020, 0), 7.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, y double")
    m = SeasonalARIMA(12)
    got = {(r.g, r.step): (r.forecast, r.lower_bound) for r in m.predict_bands(m.fit(df, ["g"]), 3, ["g"]).collect()}
    assert got == {("s", 1): (8.0, None), ("s", 2): (9.0, None), ("s", 3): (10.0, None), ("t", 1): (7.0, None), ("t", 2): (7.0, None),
                   ("t", 3): (7.0, None)}


def test_updated_tenant_models_equal_models_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{i % 3}", float(a), float(b), float(2 * a - b + i % 3 + e)) for i, (a, b, e) in
            enumerate(zip(rng.normal(size=300), rng.normal(size=300), rng.normal(scale=0.1, size=300)))]
    rows += [("t0", None, 1.0, 2.0), ("late", 1.0, 2.0, 3.0), (None, 1.0, 1.0, 1.0), (None, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "tenant string, a double, b double, y double")
    a, b = df.where("tenant <> 'late' AND a < 0.2"), df.where("NOT (tenant <> 'late' AND a < 0.2) OR tenant IS NULL OR a IS NULL")
    args = (["a", "b"], "y", "tenant")
    path = ML.update_tenant_models(a, *args)
    assert "late" not in {r.tenant for r in ML.tenant_models(spark, path, ["a", "b"]).collect()}
    ML.update_tenant_models(b, *args, path=path)
    two = {r.tenant: r for r in ML.tenant_models(spark, path, ["a", "b"]).collect()}
    one = {r.tenant: r for r in ML.tenant_models(spark, ML.update_tenant_models(df, *args), ["a", "b"]).collect()}
    assert set(two) == set(one) == {"t0", "t1", "t2", "late", None} and two["late"].n == 1
    pdf = pd.DataFrame(rows, columns=["tenant", "a", "b", "y"]).dropna()
    for t in ("t0", "t1", "t2"):
        p = pdf[pdf["tenant"] == t]
        want = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p["a"], p["b"]]), p["y"], rcond=None)[0]
        for m in (one[t], two[t]):
            assert m.n == len(p) and np.allclose([m.intercept, m.b_a, m.b_b], want, rtol=1e-8, atol=1e-8)
            assert m.r2 == pytest.approx(two[t].r2, rel=1e-9) and m.r2 > 0.95
