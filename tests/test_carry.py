"""The one-pass carry scan (D9, F4) against pandas."""

import numpy as np
import pandas as pd
import pytest

from bizlens.operators import clean, kpi
from bizlens.plans import carry, views

SF = "/root/testdata/sf0.001"


def frame(seed=3, n=900, groups=("a", None, "b", "c"), columns=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.choice(np.array(groups, dtype=object), n, p=[0.7, 0.1, 0.1, 0.1]), "k": rng.permutation(n)})
    for i in range(columns):
        x = rng.normal(size=n).round(3)
        x[rng.random(n) < (0.3 if i else 0.97)] = np.nan  # the first column has long gaps over many partitions
        pdf[f"x{i}"] = x
    pdf.loc[pdf["g"] == "c", "x1"] = np.nan
    return pdf


def spark_frame(spark, pdf):
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in pdf.itertuples(index=False)]
    kinds = ", ".join(f"{c} {'string' if c == 'g' else 'long' if c == 'k' else 'double'}" for c in pdf.columns)
    return spark.createDataFrame([tuple(r) for r in rows], kinds)


def test_interpolation_equals_pandas(spark):
    pdf = frame()
    got = clean.interpolate(spark_frame(spark, pdf).repartition(5), by=["g"], order_by=["k"], columns=["x0", "x1", "x2"]).toPandas()
    want = pdf.sort_values("k")
    for c in ("x0", "x1", "x2"):
        want[c] = want.groupby("g", dropna=False)[c].transform(lambda s: s.interpolate().ffill().bfill())
    a, b = got.sort_values("k").set_index("k"), want.set_index("k")
    for c in ("x0", "x1", "x2"):
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True, rtol=1e-12, atol=1e-12)


def test_one_group_over_all_partitions_and_no_group(spark):
    pdf = frame(seed=4).sort_values("k")
    df = spark_frame(spark, pdf)
    got = clean.interpolate(df, by=[], order_by=["k"], columns=["x0"]).toPandas().sort_values("k")["x0"]
    want = pdf["x0"].interpolate().ffill().bfill()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float))
    assert clean.interpolate(df.limit(0), by=["g"], order_by=["k"], columns=["x0"]).count() == 0


def test_plan_is_linear_in_the_columns(spark):
    def text(k):
        df = spark_frame(spark, frame(n=200, columns=k))
        near = carry.neighbours(df, ["g"], ["k"], [f"x{i}" for i in range(k)])
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join"), plan.count("LogicalRDD"), near.count()
    assert text(1) == text(12) == (0, 1, 200)  # the checkpointed rows are read once, nothing is joined


def test_lag_feature_equals_window(spark):
    bv = views.business_view(spark, SF)
    out = kpi.engineer_features(bv, views.BUSINESS_MAPPING, by=["region"], order_by=views.BV_ORDER)[0].toPandas()
    out = out.sort_values(views.BV_ORDER).reset_index(drop=True)
    want = out.groupby("region")["revenue"].shift(1)
    assert (out["_revenue_lag1"].fillna(-1) == want.fillna(-1)).all()


@pytest.mark.parametrize("inclusive", [True, False])
def test_distances_count_rows(spark, inclusive):
    df = spark.createDataFrame([("a", i, 1.0 * i if i in (3, 40) else None) for i in range(50)], "g string, k long, x double")
    rows = carry.neighbours(df.repartition(6), ["g"], ["k"], ["x"], inclusive=inclusive).collect()
    for r in rows:
        before = [p for p in (3, 40) if p < r.k or (inclusive and p == r.k)]
        after = [p for p in (3, 40) if p > r.k or (inclusive and p == r.k)]
        assert (r["__pv0"], r["__pg0"]) == ((float(before[-1]), r.k - before[-1]) if before else (None, None))
        assert (r["__nv0"], r["__ng0"]) == ((float(after[0]), after[0] - r.k) if after else (None, None))
