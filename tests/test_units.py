"""Hand-worked values on tiny frames: scores, rules, bounds, names, parsing."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from bizlens.operators import forecast as M
from bizlens.operators import insight as J
from bizlens.operators import kpi, schema


def test_health_piecewise(spark):
    rows = [("a", 30.0, 25.0, 25.0, 2.0, 0.0, 100.0),   # every sub-score 100
            ("b", 15.0, 12.5, None, None, None, 50.0),  # margin 70, growth 75, quality 50
            ("c", -20.0, -15.0, -10.0, 0.5, 20.0, 80.0)]
    df = spark.createDataFrame(rows, "g string, net_profit_margin double, revenue_growth double, "
                                     "ebitda_margin double, current_ratio double, churn_rate double, q double")
    out = {r["g"]: r for r in kpi.health_score(df, quality="q", by=["g"]).collect()}
    assert out["a"]["health_score"] == 100.0 and out["a"]["status"] == "Excellent" and out["a"]["risk_level"] == "Low"
    # b: (70*.25 + 75*.20 + 50*.10) / .55 = 68.18..
    assert out["b"]["health_score"] == pytest.approx(round((70 * .25 + 75 * .2 + 50 * .1) / .55, 1))
    assert out["b"]["status"] == "Stable"
    # c: margin max(0, 40-40)=0, growth 0, ebitda 0, current 25, churn 0, quality 80
    expect = round((25 * .15 + 80 * .1) / 1.0, 1)
    assert out["c"]["health_score"] == pytest.approx(expect)
    assert out["c"]["risk_level"] == "Critical"


def test_kpis_without_dates_use_row_order(spark):
    df = spark.createDataFrame([(1, 100.0, 60.0), (2, 120.0, 70.0), (3, 150.0, 80.0)], "i int, rev double, exp double")
    k = kpi.compute_kpis(df, {"revenue": "rev", "expenses": "exp"}, order_by=["i"]).first()
    assert k["total_revenue"] == 370.0 and k["total_profit"] == 160.0
    assert k["revenue_growth"] == 50.0
    assert k["net_profit_margin"] == round(160 / 370 * 100, 2)


def test_dashboard_defaults(spark):
    df = spark.createDataFrame([(1000.0, 800.0, 200.0, 20.0, None, None, None, 10.0, None, None, None, None, None)],
                               "total_revenue double, total_expenses double, total_profit double, net_profit_margin double, "
                               "gross_margin double, ebitda_margin double, operating_margin double, revenue_growth double, "
                               "customer_growth double, churn_rate double, current_ratio double, debt_ratio double, "
                               "inventory_turnover double")
    d = kpi.build_dashboard(df).first()
    assert d["gross_margin"] == 45.0 and d["ebitda_margin"] == 23.0 and d["operating_margin"] == 21.0
    assert d["customer_growth"] == 6.5 and d["churn_rate"] == 4.0 and d["current_ratio"] == 1.5
    assert d["total_customers"] == 100.0 and d["customer_lifetime_value"] == 10.0 and d["roi"] == 25.0
    assert "gross_margin" in d["imputed"] and "total_customers" in d["imputed"]


def test_names():
    assert schema.standard_name(" Total Revenue ") == "total_revenue"
    assert schema.standard_name("Order-Date", "dash") == "order_date"
    assert schema.standard_name("Revenue ($)", "strict") == "revenue_"
    assert schema.unique_names(["revenue", "revenue", "revenue_2", "revenue"]) == \
        ["revenue", "revenue_3", "revenue_2", "revenue_4"]
    m = schema.canonical_mapping(["Order Date", "Gross Sales", "Total Cost", "Ad Spend", "Cash on hand", "Region"])
    assert m["date"] == "order_date" and m["revenue"] == "gross_sales" and m["expenses"] == "total_cost"
    assert m["marketing_spend"] == "ad_spend" and m["cash_balance"] == "cash_on_hand" and m["region"] == "region"
    assert schema.priority_score("monthly_revenue") == 100
    assert schema.priority_score("marketing_spend") == 100
    assert schema.priority_score("customer_id") == -100
    assert schema.priority_score("carrier") == 0 and schema.priority_score("carrier", substring=True) == 100


def test_accounting_numbers(spark):
    df = spark.createDataFrame([("(1,234.50)",), ("$1,000",), ("12%",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(schema.accounting_number("s")).collect()]
    assert got == [-1234.5, 1000.0, 12.0, None, None]


def test_type_inference_two_phase(spark):
    rows = [("2024-01-0%d" % (i % 9 + 1), str(i), "x%d" % (i % 3)) for i in range(20)] + [("bad", "n/a", "y")] * 3
    df = spark.createDataFrame(rows, "d string, n string, c string")
    typed = schema.infer_types(df)
    assert dict(typed.dtypes) == {"d": "timestamp_ntz", "n": "double", "c": "string"}


def test_intervals_and_scenarios(spark):
    fc = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 100.0)], "k string, step int, forecast double")
    hist = spark.createDataFrame([("s", dt.datetime(2024, m, 1), 90.0 + m) for m in range(1, 7)], "k string, ts timestamp_ntz, y double")
    res = spark.createDataFrame([("s", r) for r in (1.0, -1.0, 1.0, -1.0)], "k string, residual double")
    iv = {r["step"]: r for r in M.intervals(fc, hist, by=["k"], resid=res).collect()}
    assert iv[1]["lower_bound"] == round(100 - 1.96, 2) and iv[2]["upper_bound"] == round(100 + 1.96 * math.sqrt(2), 2)
    sc = {r["step"]: r for r in M.scenarios(M.intervals(fc, hist, by=["k"], resid=res), hist, by=["k"]).collect()}
    ys = [90.0 + m for m in range(1, 7)]
    mu = sum(ys) / 6
    v = math.sqrt(sum((y - mu) ** 2 for y in ys) / 6) / mu
    assert sc[1]["conservative"] == round(min(100 * (1 - (0.08 + 0.01 * v)), 100 - 1.96), 2)
    assert sc[2]["optimistic"] == round(max(100 * (1 + (0.08 + 0.02 * v)), 100 + 1.96 * math.sqrt(2)), 2)


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", 10.0, 8.0), ("a", 0.0, 1.0), ("a", 20.0, 22.0)], "k string, y double, forecast double")
    m = M.metrics(pairs, by=["k"]).first()
    assert m["MAPE"] == round((0.2 + 0.1) / 2, 4)
    assert m["MAE"] == round(5 / 3, 2) and m["MAX_ERROR"] == 2.0
    assert m["RMSE"] == round(math.sqrt(9 / 3), 2)


def test_rules_fire_on_thresholds(spark):
    kp = spark.createDataFrame([("x", 1.0, 20.0, 2.0, 5.0, 10.0)],
                               "g string, current_ratio double, net_profit_margin double, marketing_roi double, "
                               "churn_rate double, revenue_growth double")
    fired = {r["category"] for r in J.apply_rules(kp, by=["g"]).collect()}
    assert fired == {"Liquidity & Working Capital", "Marketing Efficiency", "Customer Retention"}
    plan = J.action_plan(J.apply_rules(kp, by=["g"]), kp, by=["g"]).first()
    assert plan["long_term_12_months"] == [J.PLAN_DEFAULTS["12 Months"]]
    assert len(plan["medium_term_90_days"]) == 2


def test_near_duplicate_merge(spark):
    rows = [("correlation", "a strongly influences b (corr=0.90)", ["a", "b"], 0.9, 0.7, 1.0, 0.8, 1),
            ("feature_importance", "a is a key driver of performance", ["a"], 0.9, 0.8, 1.0, 0.89, 2),
            ("feature_importance", "b is a key driver of performance", ["b"], 0.95, 0.8, 1.0, 0.915, 3)]
    df = spark.createDataFrame(rows, "type string, insight string, features array<string>, strength double, "
                                     "business_impact double, confidence double, score double, rank int")
    u = J.deduplicate_exact(df)
    merged = J.merge_similar(u).orderBy("rank").collect()
    # the two "key driver" texts share > 3 words: the better one replaces the first
    assert [r["insight"] for r in merged] == ["b is a key driver of performance", "a strongly influences b (corr=0.90)"]


def test_series_columns_by_name_then_by_values(spark):
    from bizlens.operators.schema import resolve_series_columns as found
    rows = [("2024-01-0%d" % k, "x%d" % k, k, float(k), 7.0) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "at_ string, name string, n long, cash double, same double")
    assert found(df) == ("at_", "cash")
    assert found(df.toDF("at_", "name", "n", "other", "same")) == ("at_", "n")
    assert found(df.toDF("Period", "name", "Cash-Flow", "PROFIT", "same")) == ("Period", "PROFIT")
    assert found(df.select("name", "same")) == (None, None)
    assert found(df.limit(0)) == (None, None)
