"""Streams over different splits, file layouts, copies in the isolation forest, pruned search, frequencies."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import anomaly, drift, series as S, similar as N
from bizlens.sources import readers as IO

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [1, 3, 30])
def test_payments_do_not_depend_on_the_split(spark, duck, files):
    from bizlens.plans.catalog import _w1
    from bizlens.plans.oracle import SQL
    from bizlens.session import utc_session
    from helpers import assert_same
    with utc_session(spark):
        assert_same(_w1(spark, SF, files=files), duck, SQL["W1"])


def test_drift_against_a_stored_baseline_equals_batch_drift(spark, tmp_dir):
    rng = np.random.default_rng(5)
    def frame(n, shift):
        rows = [("a" if i % 3 else None, float(x), float(i % 7)) for i, x in enumerate(rng.normal(shift, 1, n).round(2))]
        return spark.createDataFrame(rows, "g string, x double, y double")
    base, cur = frame(400, 0.0), frame(150, 0.4).unionByName(spark.createDataFrame([("new", 1.0, None)], "g string, x double, y double"))
    drift.store_baseline(base, ["x", "y"], f"{tmp_dir}/base", by=["g"])
    order = ["g", "column"]
    want = drift.column_drift(base, cur, ["x", "y"], by=["g"]).orderBy(*order).toPandas()
    got = drift.drift_from_baseline(f"{tmp_dir}/base", cur, ["x", "y"], by=["g"]).orderBy(*order).toPandas()[want.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    plan = drift.drift_from_baseline(f"{tmp_dir}/base", cur, ["x"], by=["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan


def _write(tmp_dir, name, text):
    path = f"{tmp_dir}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_separator_from_the_whole_file(spark, tmp_dir):
    preamble = "\n".join(f"note {k}, with a comma, and one more" for k in range(250))
    body = "\n".join(f'{k};"a,b,c";{k * 2}' for k in range(400))
    assert IO.sniff_separator(spark, _write(tmp_dir, "p.txt", preamble + "\n\n" + body)) == ";"
    assert IO.sniff_separator(spark, _write(tmp_dir, "t.txt", "a\tb\n1\t2\n")) == "\t"
    assert IO.sniff_separator(spark, _write(tmp_dir, "q.txt", '"x;y",1\n"z;w",2\n')) == ","
    assert IO.sniff_separator(spark, _write(tmp_dir, "n.txt", "one\ntwo\n")) == ","


@pytest.mark.parametrize("text", [
    '\n\n[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]\n', '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]',
    '[\n  {\n    "a": 1,\n    "b": "x"\n  },\n  {"a": 2, "b": "y"}\n]', '\n{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n'])
def test_json_layout_from_the_whole_file(spark, tmp_dir, text):
    df = IO.read_json(spark, _write(tmp_dir, "d.json", text))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_json_record_over_several_lines_and_braces_in_text(spark, tmp_dir):
    df = IO.read_json(spark, _write(tmp_dir, "o.json", '{\n  "a": {"b": [1, 2]},\n  "c": "}"\n}\n'))
    assert [r.c for r in df.collect()] == ["}"] and df.columns == ["a", "c"]
    lines = _write(tmp_dir, "l.json", '{"a": "{[", "b": "\\"}"}\n{"a": "]", "b": "{"}\n')
    assert IO.is_json_lines(spark, lines) and IO.read_json(spark, lines).count() == 2


def test_isolation_forest_with_a_third_of_equal_rows(spark):
    rng = np.random.default_rng(8)
    n = 6000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[: n // 3, ["a", "b"]] = [0.1, 0.2]
    pdf.loc[n - 3:, ["a", "b"]] = [[9.0, 9.0], [-9.0, 8.0], [8.0, -9.0]]
    df = spark.createDataFrame(pdf).withColumn("g", F.lit("x"))
    counted = df.select(F.lit("x").alias("__if_g"), F.col("a").alias("__if_x0"), F.col("b").alias("__if_x1")) \
        .groupBy("__if_g", "__if_x0", "__if_x1").agg(F.count(F.lit(1)).alias("__if_w")).withColumn("__if_n", F.lit(n))
    places = anomaly.tree_places(counted, ["__if_x0", "__if_x1"], trees=50, subsample=64, seed=1).toPandas()
    sizes = places.groupby("__if_tree").size()
    assert len(sizes) == 50 and (sizes == 64).all()
    copies = (places["__if_x0"] == 0.1).groupby(places["__if_tree"]).mean()
    assert abs(copies.mean() - 1 / 3) < 0.05  # in every tree by its weight
    out = anomaly.isolation_forest(df, ["a", "b"], by=["g"], trees=50, subsample=64).toPandas()
    assert len(out) == n and out["anomaly_score"].rank(ascending=False)[n - 3:].max() <= 6
    assert out[out["a"] == 0.1]["anomaly_score"].nunique() == 1 and not out[out["a"] == 0.1]["is_outlier"].any()


def test_pivot_search_is_exact_and_prunes_clusters(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16)) * 10
    x = [centers[i % 20] + rng.normal(size=16) * 0.3 for i in range(2000)] + [np.zeros(16)] * 2 + [centers[0]] * 3
    store = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    queries = store.where("vec_id % 100 = 0 OR vec_id = 2001").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in N.cosine_top_k(store, queries, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.similarity))
    m = np.array(x)
    norm = np.linalg.norm(m, axis=1)
    for qid, rows in got.items():
        rows.sort()
        if norm[qid] == 0:
            assert [v for _, v, _ in rows] == [0, 1, 2, 3, 4] and all(s is None for _, _, s in rows)
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(norm > 0, m @ m[qid] / (norm * norm[qid]), -np.inf)
        best = np.sort(sim)[::-1][:5]
        assert np.allclose([s for _, _, s in rows], best, atol=1e-9)
    assert len(got) == queries.count()
    pairs = N.scored_pairs(N.pivot_index(store, chunk_rows=40), queries, k=5).count()
    assert pairs < 0.25 * store.count() * queries.count()
    assert N.cosine_top_k(store.limit(0), queries).count() == 0


def _freq(spark, dates):
    return S.detect_frequency(spark.createDataFrame([(d,) for d in dates], "ts timestamp_ntz"))


@pytest.mark.parametrize("name", ["MS", "ME", "QS-OCT", "QS-NOV", "QE-DEC", "YS-MAR", "YE-DEC", "W-WED", "2W-MON", "D", "3D", "B",
                                  "2MS", "BMS", "BME", "WOM-3MON", "h", "6h", "30min"])
def test_frequency_names(spark, name):
    dates = pd.date_range("2019-03-04", periods=30, freq=name)
    assert pd.infer_freq(dates) == _freq(spark, [d.to_pydatetime() for d in dates]).first().inferred == name


def test_structure_reasons(spark):
    rows = [("2024-01-0" + str(k % 9 + 1), 1.0 * k) for k in range(10)]
    df = spark.createDataFrame(rows, "day string, sold double")
    r = S.detect_structure(df).first()
    assert (r.is_valid_time_series, r.date_column, r.target_column, r.frequency) == (True, "day", "sold", "D")
    assert S.detect_structure(df.select("day")).first().reason == S.NO_TARGET
    assert S.detect_structure(df.select("sold")).first().reason == S.NO_DATE
    bad = df.withColumn("date", F.when(F.col("sold") > 5, "n/a").otherwise(F.col("day")))
    r = S.detect_structure(bad).first()
    assert not r.is_valid_time_series and r.bad_share == 0.4 and "unparseable" in r.reason
    weekly = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * k), float(k)) for k in range(6)],
                                   "date timestamp_ntz, revenue double")
    assert S.detect_structure(weekly).first().frequency == "W-MON"
