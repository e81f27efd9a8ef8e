"""Property checks: drift, isolation forest, ADF, ordering helpers, invariance, plans."""

import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import anomaly, drift, relate, stationarity
from bizlens.plans import catalog, order, views

SF = "/root/testdata/sf0.001"


def test_drift_identical_and_shifted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 2, 400)
    base = spark.createDataFrame(pd.DataFrame({"v": x}))
    same = drift.column_drift(base, base, ["v"]).first()
    assert same["ks_statistic"] == 0.0 and same["wasserstein_distance"] == 0.0
    assert same["ks_pvalue"] == 1.0 and not same["drift_detected"]
    shifted = spark.createDataFrame(pd.DataFrame({"v": x + 3.0}))
    d = drift.column_drift(base, shifted, ["v"]).first()
    assert d["wasserstein_distance"] == pytest.approx(3.0, rel=1e-9)
    assert d["drift_detected"] and d["ks_pvalue"] < 1e-6


def test_running_totals_across_partitions(spark):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 500), "x": np.tile(np.arange(500), 2), "c": 1})
    df = spark.createDataFrame(pdf).repartition(7)
    out = order.running_totals(df, ["g"], ["x"], ["c"], next_of="x", partitions=5).toPandas()
    out = out.sort_values(["g", "x"])
    assert (out["cum_c"].to_numpy() == out["x"].to_numpy() + 1).all()
    nxt = out["next_x"].to_numpy()
    assert np.isnan(nxt[499]) and nxt[0] == 1 and nxt[498] == 499


def test_global_row_number_contiguous(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(9)
    rn = order.global_row_number(df, ["k"], partitions=6).toPandas().sort_values("k")
    assert rn["rn"].tolist() == list(range(1, 1001))


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(7)
    normal = rng.normal(0, 1, (2000, 2))
    planted = np.array([[8, 8], [-9, 7], [10, -8], [-8, -9], [12, 0]])
    pdf = pd.DataFrame(np.vstack([normal, planted]), columns=["a", "b"])
    pdf["id"] = range(len(pdf))
    out = anomaly.isolation_forest(spark.createDataFrame(pdf), ["a", "b"], contamination=0.05).toPandas()
    top = out.sort_values("anomaly_score", ascending=False).head(4)["id"].tolist()
    assert set(top) == set(range(2000, 2004))  # extreme on both axes: the four highest scores
    assert out[out["id"] >= 2000]["is_outlier"].all()  # all five planted points are flagged
    assert 0.03 <= out["is_outlier"].mean() <= 0.07


def test_adf_random_walk_vs_noise(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(0, 1, 300))
    noise = rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"t": np.arange(300), "walk": walk, "noise": noise})
    res = {r["column"]: r for r in stationarity.stationarity(spark.createDataFrame(pdf), order_by=["t"]).collect()}
    assert not res["walk"]["is_stationary"]
    assert res["noise"]["is_stationary"] and res["noise"]["p_value"] < 0.01


def plain_adf(x, lags):
    dx = np.diff(x)

    def fit(lag, skip):
        y = dx[skip:]
        z = np.column_stack([x[skip:-1], *[dx[skip - k:len(dx) - k] for k in range(1, lag + 1)], np.ones(len(y))])
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        ssr = ((y - z @ beta) ** 2).sum()
        se = np.sqrt(ssr / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        return len(y) * np.log(ssr / len(y)) + 2 * z.shape[1], beta[0] / se, len(y)

    best = min(range(lags + 1), key=lambda k: fit(k, lags)[0])
    return fit(best, best)[1], best, fit(best, best)[2]


def test_adf_takes_whole_series(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: rng.normal(0, 1, n)
    ar = [0.0, 0.0]
    for e in noise(9000):
        ar.append(0.5 * ar[-1] + 0.3 * ar[-2] + e)
    series = {"walk": 1e6 + np.cumsum(noise(5000)), "ar": np.array(ar), "short": 5 + noise(30), None: np.cumsum(noise(1500)),
              "few": noise(19), "flat": np.ones(50)}
    pdf = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(x)), "v": x}) for k, x in series.items()])
    got = {r.k: r for r in stationarity.stationarity(spark.createDataFrame(pdf, "k string, t long, v double"), by=["k"],
                                                     order_by=["t"]).collect()}
    assert set(got) == {"walk", "ar", "short", None}
    for k, r in got.items():
        stat, lag, n = plain_adf(series[k], min(12, len(series[k]) // 4))
        assert (r.used_lag, r.observations) == (lag, n)
        assert r.adf_statistic == pytest.approx(stat, rel=1e-6)


def test_results_invariant_to_partitioning(spark):
    bv = views.business_view(spark, SF)
    base = sorted(relate.trends(bv, time_col="date", by=["region"], columns=["revenue"],
                                tie_break=["segment", "product", "customer"]).collect())
    again = sorted(relate.trends(bv.repartition(17), time_col="date", by=["region"], columns=["revenue"],
                                 tie_break=["segment", "product", "customer"]).collect())
    assert base == again


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trend_plan_has_no_single_partition_window(spark):
    bv = views.business_view(spark, SF)
    lines = _plan(relate.trends(bv, time_col="date", columns=["revenue"])).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only the per-partition row counts (one row per range partition) meet in one task
            assert "__pid" in lines[i + 1], line


def test_entitlement_uses_broadcast_rank_join(spark):
    plan = _plan(catalog.REGISTRY["B5"](spark, SF))
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan


def test_kpi_scan_prunes_columns(spark):
    df = catalog.REGISTRY["K5"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in text  # columns the query does not use are not read


def test_sources_roundtrip(spark, tmp_dir):
    from bizlens.sources import readers as IO
    path = os.path.join(tmp_dir, "data.txt")
    with open(path, "w") as f:
        f.write("date;revenue;region\n2024-01-01;10.5;A\n2024-01-02;11;B\n2024-01-03;(2);A\n")
    assert IO.sniff_separator(spark, path) == ";"
    df = IO.load(spark, path, infer=True)
    assert dict(df.dtypes)["date"] == "timestamp_ntz"
    jpath = os.path.join(tmp_dir, "records.json")
    with open(jpath, "w") as f:
        f.write('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert IO.load(spark, jpath).count() == 2
    with pytest.raises(IO.UnsupportedFormat):
        IO.load(spark, os.path.join(tmp_dir, "x.pdf"))
    opts = IO.jdbc_options("jdbc:postgresql://db/x", query="select 1", partition_column="id", lower_bound=0,
                           upper_bound=100, num_partitions=4)
    assert opts["numPartitions"] == "4" and opts["dbtable"].startswith("(select 1)")
    v = IO.validate(df, min_rows=5).first()
    assert not v["valid"] and v["rows_seen"] == 3


def test_office_documents(spark, tmp_dir):
    from bizlens.sources.office import read_office
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = (f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First paragraph</w:t></w:r></w:p>'
           f'<w:p></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(os.path.join(tmp_dir, "a.docx"), "w") as z:
        z.writestr("word/document.xml", doc)
    rows = read_office(spark, tmp_dir).orderBy("unit").collect()
    assert [r["text"] for r in rows] == ["First paragraph", "Second"]


def test_stream_windows_equal_batch(spark):
    from bizlens.streaming import kpis as WS
    got = WS.run_available(WS.windowed_kpis(WS.event_stream(spark, SF)), kind="test").collect()
    ev = spark.read.parquet(f"{SF}/events.parquet")
    max_ts = ev.agg(F.max("ts")).first()[0]
    batch = (ev.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("d") + F.expr("interval 2 days") <= F.lit(max_ts)).collect())
    assert sorted((r["window_start"], r["event_type"], r["events"]) for r in got) == \
        sorted((r["d"], r["event_type"], r["n"]) for r in batch)


def test_payment_state_machine(spark, tmp_dir):
    from bizlens.streaming import kpis as WS
    from bizlens.streaming import payments as WP
    ts = pd.Timestamp
    ev = pd.DataFrame([
        ("charge.completed", 1, "tx-1", "successful", ts("2024-01-01")),
        ("charge.completed", 1, "tx-1", "successful", ts("2024-01-01")),   # redelivered
        ("charge.completed", 2, "tx-2", "successful", ts("2024-01-10")),   # extends the term
        ("transfer.completed", 3, "tx-3", "successful", ts("2024-01-11")),  # other event type
        ("charge.completed", 4, "nope", "successful", ts("2024-01-12")),   # unknown reference
        ("charge.completed", 5, "tx-5", "failed", ts("2024-03-01")),       # past due
        ("charge.completed", 6, "tx-6", "successful", ts("2024-03-20")),   # moves the watermark
    ], columns=["event", "transaction_id", "tx_ref", "status", "event_time"])
    src = os.path.join(tmp_dir, "events")
    spark.createDataFrame(ev).coalesce(1).write.parquet(src)  # one file: one micro-batch, then the timer batch
    subs = spark.createDataFrame([("tx-1", 7, "Agency"), ("tx-2", 7, "Agency"), ("tx-5", 7, "Agency"),
                                  ("tx-6", 8, "Professional")], "tx_ref string, user_tenant_id int, plan string")
    schema = "event string, transaction_id long, tx_ref string, status string, event_time timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    with WP.rocksdb_state(spark):
        out = WS.run_available(WP.subscription_state(stream, subs), kind="pay").toPandas()
    s7 = out[out.subscription_id == 7].sort_values(["event_time", "status"])
    assert s7["status"].tolist()[:3] == ["active", "active", "past_due"]
    assert pd.Timestamp(s7["expiry"].iloc[1]) == ts("2024-03-01")  # 2024-01-01 + 30 + 30 days
    assert (out["transaction_id"] == 1).sum() == 1
    assert "expired" in s7["status"].tolist()  # five days past due -> Starter (event-time timer)


def test_exact_quantiles_and_moments_equal_numpy(spark):
    from bizlens.operators import profile
    h = views.view_holes(spark, SF)
    pdf = h.select("region", "revenue", "quantity").toPandas()
    for r in profile.numeric_stats(h, by=["region"], columns=["revenue", "quantity"]).collect():
        x = pdf[pdf["region"] == r.region][r.column].dropna()
        want = [x.mean(), x.std(), x.min(), *x.quantile([.25, .5, .75]), x.max(), x.skew()]
        got = [r["mean"], r["std"], r["min"], r["p25"], r["median"], r["p75"], r["max"], r["skewness"]]
        assert r["count"] == len(x) and got == pytest.approx(want, rel=1e-9)
    plan = profile.column_profile(h, by=["region"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_correlation_chunks_equal_single_aggregate(spark):
    bv = views.business_view(spark, SF)
    cols = ["quantity", "revenue", "expenses", "customer"]
    a = sorted(relate.correlation_pairs(bv, by=["region"], columns=cols).collect())
    b = sorted(relate.correlation_pairs(bv, by=["region"], columns=cols, chunk=2).collect())
    assert [r[:4] for r in a] == [r[:4] for r in b] and len(a) == 5 * 6
    assert [r.r for r in a] == pytest.approx([r.r for r in b], rel=1e-9)


def test_end_to_end_flows(spark):
    from bizlens.plans import flows
    from bizlens.plans.catalog import monthly_series
    bv = views.business_view(spark, SF)
    rec = flows.recommendation(bv, views.BUSINESS_MAPPING, by=["region"], order_by=views.BV_ORDER)
    assert rec["health"].count() == 5 and rec["action_plan"].count() == 5 and rec["horizons"].count() == 15
    pred = flows.prediction(monthly_series(spark, SF), horizon=6, by=["region"])
    assert pred["forecast"].count() == 30 and pred["summary"].count() == 5
    di = flows.data_intelligence(bv.drop("customer"), time_col="date", by=["region"])
    assert di["insights"].count() > 0 and di["recommendations"].count() > 0


def test_isolation_forest_by_group(spark):
    rng = np.random.default_rng(5)
    parts = [pd.DataFrame({"g": g, "a": rng.normal(m, 1, 200), "b": rng.normal(m, 1, 200)}) for g, m in (("x", 0), (None, 500))]
    parts[1].loc[7, "a"] = 0.0  # ordinary among all rows, not in its group
    parts.append(pd.DataFrame({"g": "same", "a": 1.0, "b": 2.0}, index=range(50)))
    parts.append(pd.DataFrame({"g": "few", "a": range(9), "b": range(9)}))
    pdf = pd.concat(parts).astype({"a": float, "b": float})
    # a small chunk spreads every group over several tasks
    out = anomaly.isolation_forest(spark.createDataFrame(pdf), ["a", "b"], by=["g"], chunk_rows=64).toPandas()
    assert len(out) == len(pdf)
    key = out["g"].fillna("none")
    assert out[key.isin(["same", "few"])]["anomaly_score"].isna().all()
    flagged = out[out["is_outlier"]].groupby(key).size()
    assert set(flagged.index) == {"x", "none"} and flagged.max() <= 10
    assert out[(key == "none") & (out["a"] == 0.0)]["is_outlier"].all()
