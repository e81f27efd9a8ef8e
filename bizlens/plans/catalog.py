"""Registered queries: one callable per operator ID, (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (through the views in ``views``) so
its work grows with the data. ``bizlens.plans.oracle`` holds the DuckDB SQL
for the same IDs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.operators import kpi, profile
from bizlens.plans import views as V
from bizlens.session import cut_lineage, keep_rows, shuffle_tasks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _r(df: DataFrame, places: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (float agreement with the oracle)."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _sized(spark, sf_dir):
    """Joins of the views with as many tasks as their lines ask for (counted from the footers)."""
    return shuffle_tasks(spark, V.table(spark, sf_dir, "lineitem").count())


def _kept(spark, sf_dir, view) -> DataFrame:
    with _sized(spark, sf_dir):
        return keep_rows(view(spark, sf_dir))


# ---------------------------------------------------------------------------
# Minimum slice: business view -> features -> KPIs -> health by region
# ---------------------------------------------------------------------------

def region_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: quality profile + KPIs + health score per region.

    The business view is read and joined once: its distinct rows with
    multiplicities (the one full shuffle, needed anyway for the exact
    duplicate count) feed both the quality score and the weighted KPIs.
    """
    bv = V.business_view(spark, sf_dir)
    mapping = V.BUSINESS_MAPPING
    counted = profile.distinct_counts(bv)
    quality = profile.quality_score(bv, mapping, by=["region"], counted=counted).select("region", "data_quality_score")
    fe, m = kpi.synthesize_profit(counted, mapping)
    k = kpi.compute_kpis(fe, m, by=["region"], order_by=V.BV_ORDER, weight="_n")
    with _sized(spark, sf_dir):
        k = cut_lineage(k.join(quality, "region"))  # a row a region
    return kpi.health_score(k, by=["region"],
                            keep=["total_revenue", "total_profit", "net_profit_margin", "revenue_growth"])


@register("H1")
def q_h1(spark, sf_dir):
    return region_health(spark, sf_dir)


@register("K1")
def q_k1(spark, sf_dir):
    fv = V.finance_view(spark, sf_dir)
    fe, m = kpi.synthesize_profit(fv, V.FINANCE_MAPPING)
    return kpi.compute_kpis(fe, m, by=["region"], order_by=V.BV_ORDER)


# ---------------------------------------------------------------------------
# Schema and type inference (C)
# ---------------------------------------------------------------------------

from bizlens.operators import clean as D  # noqa: E402
from bizlens.operators import relate as R  # noqa: E402
from bizlens.operators import schema as C  # noqa: E402

_TEXT_COLS = ["date_txt", "iso_txt", "region", "revenue_txt", "quantity_txt", "rate_txt"]


@register("C4")
def q_c4(spark, sf_dir):
    return C.numeric_conversion(V.view_text(spark, sf_dir), _TEXT_COLS)


@register("C5")
def q_c5(spark, sf_dir):
    return C.datetime_conversion(V.view_text(spark, sf_dir), _TEXT_COLS)


@register("C6")
def q_c6(spark, sf_dir):
    return C.is_datetime_like(V.view_text(spark, sf_dir), _TEXT_COLS)


@register("C7")
def q_c7(spark, sf_dir):
    return C.chart_date_format(V.view_text(spark, sf_dir), _TEXT_COLS)


@register("C9")
def q_c9(spark, sf_dir):
    return C.type_partition(V.business_view(spark, sf_dir))


@register("C11")
def q_c11(spark, sf_dir):
    t = V.view_text(spark, sf_dir)
    return t.select("customer", "product", "iso_txt", "revenue_txt",
                    F.round(C.accounting_number("revenue_txt"), 2).alias("revenue"),
                    C.accounting_number("rate_txt").alias("rate"))


# ---------------------------------------------------------------------------
# Cleaning (D)
# ---------------------------------------------------------------------------

_HOLE_COLS = ["date", "region", "segment", "product", "customer", "revenue", "expenses", "quantity"]


def _holes(spark, sf_dir):
    return V.view_holes(spark, sf_dir).select(*_HOLE_COLS)


@register("D1")
def q_d1(spark, sf_dir):
    return D.drop_duplicates(V.view_dups(spark, sf_dir))


@register("D2")
def q_d2(spark, sf_dir):
    # the counts and the result both read the rows
    return D.drop_empty_columns(_kept(spark, sf_dir, V.view_holes))


@register("D3")
def q_d3(spark, sf_dir):
    h = V.view_holes(spark, sf_dir).select("customer", "product", "revenue", "expenses", "quantity")
    return D.drop_empty_rows(h, subset=["revenue", "expenses", "quantity"])


@register("D4")
def q_d4(spark, sf_dir):
    return D.drop_incomplete_rows(_holes(spark, sf_dir))


@register("D5")
def q_d5(spark, sf_dir):
    return _r(D.fill_numeric(_holes(spark, sf_dir), by=["region"], columns=["revenue", "expenses", "quantity"]), 6)


@register("D6")
def q_d6(spark, sf_dir):
    return D.fill_categorical(_holes(spark, sf_dir), by=["region"], columns=["segment"])


@register("D7")
def q_d7(spark, sf_dir):
    return D.fill_datetime(_holes(spark, sf_dir), by=["region"], order_by=V.BV_ORDER, columns=["date"])


@register("D8")
def q_d8(spark, sf_dir):
    ex = V.view_extreme(spark, sf_dir)
    inf = D.count_infinities(ex, by=["region"], columns=["revenue"])
    rep = D.replace_infinities(ex, columns=["revenue"])
    nulls = rep.groupBy("region").agg(
        F.sum(F.when(F.col("revenue").isNull(), 1).otherwise(0)).cast("long").alias("null_after"),
        F.sum(F.when(F.isnan("revenue"), 1).otherwise(0)).cast("long").alias("nan_after"))
    return inf.join(nulls, "region")


@register("D9")
def q_d9(spark, sf_dir):
    out = D.interpolate(_holes(spark, sf_dir), by=["product"], order_by=V.BV_ORDER,
                        columns=["revenue", "expenses", "quantity"])
    return _r(out, 6)


@register("D10")
def q_d10(spark, sf_dir):
    docs = table_(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return D.normalize_text(docs, ["text", "lang", "source"])


@register("D11")
def q_d11(spark, sf_dir):
    bv = V.business_view(spark, sf_dir).select("date", "region", "product", "revenue", "expenses", "quantity")
    return _r(D.merge_duplicate_dates(bv, "date", by=["region"], order_by=["date", "region", "product", "revenue",
                                                                             "expenses", "quantity"]), 4)


@register("D12")
def q_d12(spark, sf_dir):
    t = V.view_text(spark, sf_dir).select("date_txt", "customer", "product", "quantity_txt")
    return D.drop_bad_rows(t, "date_txt", "quantity_txt", date_format="yyyy-MM-dd")


@register("D14")
def q_d14(spark, sf_dir):
    return D.quality_report(V.view_holes(spark, sf_dir), by=["region"])


def table_(spark, sf_dir, name):
    return V.table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# Profiling (P)
# ---------------------------------------------------------------------------

@register("P1")
def q_p1(spark, sf_dir):
    return profile.table_profile(V.view_holes(spark, sf_dir), by=["region"])


@register("P2")
def q_p2(spark, sf_dir):
    return profile.column_profile(V.view_holes(spark, sf_dir), by=["region"])


@register("P3")
def q_p3(spark, sf_dir):
    return _r(profile.numeric_stats(V.view_holes(spark, sf_dir), by=["region"]), 4)


@register("P4")
def q_p4(spark, sf_dir):
    return profile.datetime_range(V.view_holes(spark, sf_dir), by=["region"])


@register("P5")
def q_p5(spark, sf_dir):
    return _r(profile.describe(V.business_view(spark, sf_dir), by=["region"]), 4)


@register("P6")
def q_p6(spark, sf_dir):
    return profile.distributions(V.business_view(spark, sf_dir), by=["region"])


@register("P7")
def q_p7(spark, sf_dir):
    return profile.top_values(V.business_view(spark, sf_dir), ["segment", "product"], by=["region"], k=10)


@register("P8")
def q_p8(spark, sf_dir):
    return profile.missing_values(V.view_holes(spark, sf_dir), by=["region"])


@register("P9")
def q_p9(spark, sf_dir):
    return profile.duplicate_rows(V.view_dups(spark, sf_dir), by=["region"])


@register("P10")
def q_p10(spark, sf_dir):
    return profile.quality_score(V.view_holes(spark, sf_dir), V.BUSINESS_MAPPING, by=["region"])


@register("P12")
def q_p12(spark, sf_dir):
    return profile.descriptive_stats(V.view_holes(spark, sf_dir), by=["region"])


# ---------------------------------------------------------------------------
# Correlation, drivers, trends (R, T)
# ---------------------------------------------------------------------------

_RCOLS = ["quantity", "revenue", "expenses"]


@register("R1")
def q_r1(spark, sf_dir):
    return R.correlation_matrix(V.business_view(spark, sf_dir), by=["region"], columns=_RCOLS, places=4)


@register("R2")
def q_r2(spark, sf_dir):
    return _r(R.ranked_pairs(V.business_view(spark, sf_dir), by=["region"], columns=_RCOLS), 4)


@register("R3")
def q_r3(spark, sf_dir):
    return R.feature_importance(V.business_view(spark, sf_dir), "revenue", by=["region"],
                                columns=["quantity", "revenue", "expenses", "customer"])


@register("R4")
def q_r4(spark, sf_dir):
    return R.driver_analysis(V.business_view(spark, sf_dir), "revenue", by=["region"],
                             columns=["quantity", "revenue", "expenses", "customer"])


@register("R6")
def q_r6(spark, sf_dir):
    return R.recommended_kpi(V.business_view(spark, sf_dir), by=["region"])


@register("R7")
def q_r7(spark, sf_dir):
    return _r(R.regression_line(V.business_view(spark, sf_dir), "quantity", "revenue", by=["region"]), 4)


@register("T1")
def q_t1(spark, sf_dir):
    return R.trends(V.business_view(spark, sf_dir), time_col="date", by=["region"], columns=_RCOLS,
                    tie_break=["segment", "product", "customer"])


@register("T3")
def q_t3(spark, sf_dir):
    return _r(R.kpi_by_segment(V.business_view(spark, sf_dir), "revenue", "segment"), 4)


@register("T4")
def q_t4(spark, sf_dir):
    return _r(R.kpi_over_time(V.business_view(spark, sf_dir), "revenue", "date", by=["region"]), 4)


@register("T5")
def q_t5(spark, sf_dir):
    return _r(R.monthly_rollup(V.business_view(spark, sf_dir), "date", by=["region"], columns=_RCOLS), 2)


@register("T6")
def q_t6(spark, sf_dir):
    return _r(R.top_by_sum(V.business_view(spark, sf_dir), "product", "revenue", by=["region"], k=5), 2)


# ---------------------------------------------------------------------------
# Features (F)
# ---------------------------------------------------------------------------

@register("F1")
def q_f1(spark, sf_dir):
    h = _holes(spark, sf_dir)
    out, m = kpi.synthesize_profit(h, {"revenue": "revenue", "expenses": "expenses"})
    return out.select("customer", "product", "date", "revenue", "expenses", F.round(m["profit"], 6).alias("profit"))


def _features(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    return kpi.engineer_features(bv, V.BUSINESS_MAPPING, by=["region"], order_by=V.BV_ORDER)[0]


@register("F2")
def q_f2(spark, sf_dir):
    return _features(spark, sf_dir).select("customer", "product", "date", "revenue",
                                           F.round("_profit_margin_pct", 6).alias("profit_margin_pct"))


@register("F3")
def q_f3(spark, sf_dir):
    return _features(spark, sf_dir).select("customer", "product", "date", F.col("_year").alias("year"),
                                           F.col("_month").alias("month"), F.col("_year_month").alias("year_month"))


@register("F4")
def q_f4(spark, sf_dir):
    return _features(spark, sf_dir).select("region", "customer", "product", "date", "revenue",
                                           F.col("_revenue_lag1").alias("revenue_lag1"),
                                           F.round("_revenue_growth_pct", 6).alias("revenue_growth_pct"))


# ---------------------------------------------------------------------------
# KPI variants, dashboard, anomalies (K, A)
# ---------------------------------------------------------------------------

from bizlens.operators import anomaly as A  # noqa: E402
from bizlens.operators import forecast as M  # noqa: E402
from bizlens.operators import series as S  # noqa: E402


def _finance_kpis(spark, sf_dir, fv=None):
    stored = fv is not None  # given rows are those of ``_kept``
    fv = fv if fv is not None else V.finance_view(spark, sf_dir)
    fe, m = kpi.synthesize_profit(fv, V.FINANCE_MAPPING)
    return kpi.compute_kpis(fe, m, by=["region"], order_by=V.BV_ORDER, stored=stored)


@register("K1_balance")
def q_k1_balance(spark, sf_dir):
    # gross profit, churned over active customers, acquisition cost, debt over equity
    m = {**V.FINANCE_MAPPING, "gross_profit": "gross_profit", "active_customers": "active", "churned_customers": "churned",
         "cac": "cost_per_customer", "equity": "equity"}
    return _balance_kpis(spark, sf_dir, {k: v for k, v in m.items() if k != "churn_rate"})


@register("K1_cogs")
def q_k1_cogs(spark, sf_dir):
    # cost of goods in place of gross profit, a given debt to equity, no way to a cost per customer
    m = {**V.FINANCE_MAPPING, "cogs": "cogs", "active_customers": "active", "churned_customers": "churned",
         "debt_to_equity": "leverage"}
    return _balance_kpis(spark, sf_dir, {k: v for k, v in m.items() if k not in ("churn_rate", "new_customers")})


def _balance_kpis(spark, sf_dir, mapping):
    fe, m = kpi.synthesize_profit(V.balance_view(spark, sf_dir), mapping)
    return kpi.compute_kpis(fe, m, by=["region"], order_by=V.BV_ORDER)


@register("K5")
def q_k5(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    k = kpi.compute_kpis(bv, V.BUSINESS_MAPPING, by=["product"], order_by=V.BV_ORDER)
    return k.select("product", "total_revenue", "revenue_growth")


@register("K6")
def q_k6(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    k = kpi.compute_kpis(bv, {"date": "date", "revenue": "revenue", "active_customers": "quantity"},
                         by=["segment"], order_by=V.BV_ORDER)
    return k.select("segment", "customer_growth")


@register("K15")
def q_k15(spark, sf_dir):
    fv = V.finance_view(spark, sf_dir)
    k = _finance_kpis(spark, sf_dir)
    cust = fv.groupBy("region").agg(F.count_distinct("customer").alias("total_customers"))
    return kpi.build_dashboard(k, by=["region"], customers=cust)


@register("K1_rollup")
def q_k1_rollup(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    g = bv.rollup("region", "segment").agg(F.sum("revenue").alias("rev"), F.sum("expenses").alias("exp"),
                                           F.count(F.lit(1)).alias("rows"))
    return g.select("region", "segment", "rows", F.round("rev", 2).alias("total_revenue"),
                    F.round("exp", 2).alias("total_expenses"), F.round(F.col("rev") - F.col("exp"), 2).alias("total_profit"),
                    F.when(F.col("rev") > 0, F.round((F.col("rev") - F.col("exp")) / F.col("rev") * 100.0, 2))
                    .otherwise(0.0).alias("net_profit_margin"))


def _daily(spark, sf_dir, bv=None):
    bv = bv if bv is not None else V.business_view(spark, sf_dir)
    # a row a region and day, read several times: worked out once
    with _sized(spark, sf_dir):
        return cut_lineage(bv.groupBy("region", "date").agg(F.sum("revenue").alias("revenue"), F.sum("expenses").alias("expenses")))


@register("A1")
def q_a1(spark, sf_dir):
    return A.zscore_outliers(_daily(spark, sf_dir), {"revenue": "revenue", "expenses": "expenses"},
                             by=["region"], date="date")


@register("A4")
def q_a4(spark, sf_dir):
    return A.kpi_alerts(_finance_kpis(spark, sf_dir), by=["region"])


@register("A5")
def q_a5(spark, sf_dir):
    return A.opportunities(_finance_kpis(spark, sf_dir), by=["region"], has_marketing=True)


@register("A3")
def q_a3(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("profit", F.col("revenue") - F.col("expenses"))
    out = A.isolation_forest(d, ["revenue", "expenses", "profit"], by=["region"])
    return out.select("region", "date", F.round("anomaly_score", 4).alias("anomaly_score"), "is_outlier")


# ---------------------------------------------------------------------------
# Series and forecasting (V, M)
# ---------------------------------------------------------------------------

def monthly_series(spark, sf_dir):
    """Zero-filled monthly revenue per region as (region, ts, y)."""
    bv = V.business_view(spark, sf_dir)
    m = R.monthly_rollup(bv, "date", by=["region"], columns=["revenue", "expenses"])
    # Cents: the series every forecaster sees is exact in any engine. A row a region and month,
    # read by every fit, split and metric: worked out once.
    with _sized(spark, sf_dir):
        return cut_lineage(m.select("region", F.col("month").cast("timestamp_ntz").alias("ts"), F.round("revenue", 2).alias("y")))


_H = 6
_CANDIDATES = [M.LinearTrend(), M.SeasonalNaive(12), M.HistoricalMean()]


@register("V2")
def q_v2(spark, sf_dir):
    s = S.to_series(V.business_view(spark, sf_dir), "date", "revenue", by=["region"], period="month")
    return S.detect_frequency(s, by=["region"])


def _lattices(spark, sf_dir):
    """(kind, ts): dates of the given orders on different lattices."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    span = o.agg(F.min("d").alias("a"), F.max("d").alias("z"))
    days = span.select("a", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("t"))
    w = F.weekday("t")

    def of(kind, ts, rows, distinct=True):
        out = rows.select(F.lit(kind).alias("kind"), ts.cast("timestamp_ntz").alias("ts"))
        return out.distinct() if distinct else out

    parts = [of("month_start", F.date_trunc("month", "d"), o), of("month_end", F.last_day("d"), o),
             of("quarter", F.date_trunc("quarter", "d"), o), of("year", F.date_trunc("year", "d"), o),
             of("week", F.date_trunc("week", "d"), o), of("day", F.col("t"), days), of("business", F.col("t"), days.where(w < 5)),
             of("third_monday", F.col("t"), days.where((w == 0) & F.dayofmonth("t").between(15, 21))),
             of("two_weeks", F.col("t"), days.where(F.datediff("t", "a") % 14 == 0)),
             of("half_day", F.col("t"), days.select(F.explode(F.array("t", F.expr("t + interval 12 hours"))).alias("t"))),
             of("irregular", F.col("d"), o.where("k % 97 = 0")), of("repeated", F.col("d"), o.where("k % 50 = 0"), False),
             of("two_dates", F.col("t"), span.select(F.explode(F.array("a", "z")).alias("t")))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("V2_exact")
def q_v2_exact(spark, sf_dir):
    return S.detect_frequency(_lattices(spark, sf_dir), by=["kind"])


@register("V9")
def q_v9(spark, sf_dir):
    return S.horizon_dates(monthly_series(spark, sf_dir), by=["region"])


@register("V3")
def q_v3(spark, sf_dir):
    return _r(S.calendar_features(monthly_series(spark, sf_dir)), 6)


@register("V5")
def q_v5(spark, sf_dir):
    return _r(S.lag_features(monthly_series(spark, sf_dir), by=["region"]), 4)


@register("V7")
def q_v7(spark, sf_dir):
    return _r(S.lag_features(monthly_series(spark, sf_dir), by=["region"], fill="bfill"), 4)


@register("V8")
def q_v8(spark, sf_dir):
    return S.future_dates(monthly_series(spark, sf_dir), 12, by=["region"], freq="MS")


def _monthly(spark, sf_dir, bv=None):
    bv = bv if bv is not None else V.business_view(spark, sf_dir)
    # a row a region and month, read for the fit and again for its residuals
    with _sized(spark, sf_dir):
        return cut_lineage(R.monthly_rollup(bv, "date", by=["region"], columns=["revenue", "expenses"]))


@register("M1")
def q_m1(spark, sf_dir):
    p = M.linear_trend_forecast(_monthly(spark, sf_dir), by=["region"], periods=12)
    return p.drop("revenue_slope", "std_error")


@register("M2")
def q_m2(spark, sf_dir):
    return M.horizon_summary(M.linear_trend_forecast(_monthly(spark, sf_dir), by=["region"]), by=["region"])


@register("M3")
def q_m3(spark, sf_dir):
    p = M.linear_trend_forecast(_monthly(spark, sf_dir), by=["region"]).filter(F.col("step") == 1)
    return p.select("region", F.round("revenue_slope", 4).alias("revenue_slope"),
                    M.trend_label(F.col("revenue_slope")).alias("trend"))


@register("M9")
def q_m9(spark, sf_dir):
    return M.holdout_split(monthly_series(spark, sf_dir), _H, by=["region"]).select(
        "region", "ts", "t", "n", "test_size", "role")


@register("M12")
def q_m12(spark, sf_dir):
    return M.rolling_origin_folds(monthly_series(spark, sf_dir), _H, by=["region"]).drop("y")


@register("M13")
def q_m13(spark, sf_dir):
    bt = M.backtest(monthly_series(spark, sf_dir), [M.LinearTrend()], _H, by=["region"])
    return M.metrics(bt, by=["region", "model"])


@register("M14")
def q_m14(spark, sf_dir):
    bt = M.backtest(monthly_series(spark, sf_dir), [M.LinearTrend()], _H, by=["region"])
    # y is in cents; forecasts can land on half cents, so report them to 0.1
    out = M.residuals(bt).select("region", "ts", "y", "forecast", "residual")
    return out.select("region", "ts", F.round("y", 2).alias("y"), F.round("forecast", 1).alias("forecast"),
                      F.round("residual", 1).alias("residual"))


@register("M10")
def q_m10(spark, sf_dir):
    return M.select_best_model(monthly_series(spark, sf_dir), _CANDIDATES, _H, by=["region"])


@register("M7_naive")
def q_m7_naive(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    sn = M.SeasonalNaive(12)
    return _r(sn.predict(sn.fit(s, ["region"]), 12, ["region"]), 4)


def _final_forecast(spark, sf_dir, horizon=12):
    s = monthly_series(spark, sf_dir)
    lt = M.LinearTrend()
    pred = lt.predict(lt.fit(s, ["region"]), horizon, ["region"])
    pred = M.attach_dates(pred, s, horizon, by=["region"], freq="MS")
    bt = M.residuals(M.backtest(s, [lt], _H, by=["region"]))
    return s, pred, bt


@register("M15")
def q_m15(spark, sf_dir):
    s, pred, bt = _final_forecast(spark, sf_dir)
    return _r(M.intervals(pred, s, by=["region"], resid=bt), 2)


def _scenarios(spark, sf_dir):
    s, pred, bt = _final_forecast(spark, sf_dir)
    return s, bt, M.scenarios(M.intervals(pred, s, by=["region"], resid=bt), s, by=["region"])


@register("M16")
def q_m16(spark, sf_dir):
    return _scenarios(spark, sf_dir)[2]


def _mape(bt):
    return M.metrics(bt, by=["region"]).select("region", "MAPE")


@register("M18")
def q_m18(spark, sf_dir):
    s, bt, sc = _scenarios(spark, sf_dir)
    return M.forecast_summary(sc, s, _mape(bt), by=["region"])


@register("M20")
def q_m20(spark, sf_dir):
    s, bt, sc = _scenarios(spark, sf_dir)
    return M.assess_risks(sc, _mape(bt), by=["region"])


@register("M21")
def q_m21(spark, sf_dir):
    s, bt, sc = _scenarios(spark, sf_dir)
    return M.generate_actions(M.forecast_summary(sc, s, _mape(bt), by=["region"]), sc, by=["region"])


@register("M22")
def q_m22(spark, sf_dir):
    s, bt, sc = _scenarios(spark, sf_dir)
    return _r(M.chart_series(s, sc, by=["region"]), 2)


# ---------------------------------------------------------------------------
# Drift, entitlement joins, similarity (G, B, N)
# ---------------------------------------------------------------------------

from bizlens.operators import drift as G  # noqa: E402
from bizlens.operators import entitle as B  # noqa: E402
from bizlens.operators import similar as N  # noqa: E402
from bizlens.plans import tenancy as TN  # noqa: E402

DRIFT_SPLIT = "2024-01-16 00:00:00"


def _event_sides(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select(
        "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    cut = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    return ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)


def _drift(spark, sf_dir):
    base, cur = _event_sides(spark, sf_dir)
    return G.column_drift(base, cur, ["value", "k"], by=["event_type"])


@register("G1")
def q_g1(spark, sf_dir):
    return _r(_drift(spark, sf_dir), 6)


@register("G2")
def q_g2(spark, sf_dir):
    return G.drift_summary(_drift(spark, sf_dir), by=["event_type"])


@register("G3")
def q_g3(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    cut = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return _r(G.seasonality_shift(bv.filter(F.col("date") < cut), bv.filter(F.col("date") >= cut),
                                  "date", "revenue"), 4)


def _ten(spark, sf_dir):
    return TN.users(spark, sf_dir), TN.tenants(spark, sf_dir), TN.user_tenant(spark, sf_dir)


@register("B1")
def q_b1(spark, sf_dir):
    u, t, ut = _ten(spark, sf_dir)
    return B.tenant_memberships(t, ut)


@register("B2")
def q_b2(spark, sf_dir):
    u, t, ut = _ten(spark, sf_dir)
    return B.user_tenants(u, ut, t)


@register("B3")
def q_b3(spark, sf_dir):
    u, t, ut = _ten(spark, sf_dir)
    return B.tenant_members(t, ut, u)


@register("B4")
def q_b4(spark, sf_dir):
    u, t, ut = _ten(spark, sf_dir)
    return B.effective_plan(u, ut, as_of=TN.AS_OF)


@register("B5")
def q_b5(spark, sf_dir):
    u, t, ut = _ten(spark, sf_dir)
    return B.entitlements(B.effective_plan(u, ut, as_of=TN.AS_OF), TN.plans(spark), TN.features(spark))


@register("B6")
def q_b6(spark, sf_dir):
    return B.latest_subscription(TN.subscriptions(spark, sf_dir))


@register("B7")
def q_b7(spark, sf_dir):
    return B.price_subscriptions(TN.subscriptions(spark, sf_dir), B.plan_prices(TN.plans(spark)))


@register("N1")
def q_n1(spark, sf_dir):
    emb = V.table(spark, sf_dir, "embeddings")
    queries = N.centroids(emb, "label").withColumnRenamed("label", "query_id")
    return _r(N.cosine_top_k(emb, queries, k=5), 6)


@register("N2")
def q_n2(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    bench = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text",
                                                        F.lit("benchmark").alias("source"))
    return N.upsert_by_text(docs, bench)


# ---------------------------------------------------------------------------
# Insights, rules and narrative rows (J)
# ---------------------------------------------------------------------------

from bizlens.operators import insight as J  # noqa: E402


def _insight_inputs(spark, sf_dir, bv=None):
    bv = bv if bv is not None else _kept(spark, sf_dir, V.business_view)  # five passes read them
    pairs = R.ranked_pairs(bv, by=["region"], columns=_RCOLS)
    imp = R.feature_importance(bv, "revenue", by=["region"], columns=["quantity", "revenue", "expenses", "customer"])
    order = F.create_map(*[x for i, c in enumerate(_RCOLS) for x in (F.lit(c), F.lit(i))])
    tr = R.trends(bv, time_col="date", by=["region"], columns=_RCOLS, tie_break=["segment", "product", "customer"]) \
        .withColumn("column_order", order[F.col("column")])
    miss = profile.missing_values(bv, by=["region"]).groupBy("region").agg(F.sum("missing").alias("missing"))
    dups = profile.duplicate_rows(bv, by=["region"]).select("region", F.col("duplicate_rows").alias("duplicates"))
    # a few rows a region, each read several times below: worked out once
    return tuple(cut_lineage(df) for df in (pairs, imp, tr, miss.join(dups, "region")))


def _j1(spark, sf_dir):
    pairs, imp, tr, qual = _insight_inputs(spark, sf_dir)
    return J.rank_insights(pairs, imp, tr, qual, by=["region"])


@register("J1")
def q_j1(spark, sf_dir):
    return _j1(spark, sf_dir)


@register("J2")
def q_j2(spark, sf_dir):
    return J.deduplicate_exact(_j1(spark, sf_dir), by=["region"])


@register("J3")
def q_j3(spark, sf_dir):
    return J.merge_similar(J.deduplicate_exact(_j1(spark, sf_dir), by=["region"]), by=["region"])


def _reasons(spark, sf_dir, bv=None):
    pairs, imp, tr, qual = _insight_inputs(spark, sf_dir, bv)
    ins = J.merge_similar(J.deduplicate_exact(J.rank_insights(pairs, imp, tr, qual, by=["region"]), by=["region"]),
                          by=["region"])
    return pairs, imp, tr, J.reasoning(ins, pairs, imp, tr, qual, by=["region"], kpi="revenue")


@register("J4")
def q_j4(spark, sf_dir):
    return _reasons(spark, sf_dir)[3]


@register("J5")
def q_j5(spark, sf_dir):
    pairs, imp, tr, rs = _reasons(spark, sf_dir)
    return J.recommendations(pairs, imp, tr, rs, by=["region"], kpi="revenue")


def _rules(spark, sf_dir, fv=None):
    # the finance view has the rows and columns of the business view and more: it is joined once,
    # and its KPIs (a row a region) are worked out once
    fv = fv if fv is not None else _kept(spark, sf_dir, V.finance_view)
    k = cut_lineage(_finance_kpis(spark, sf_dir, fv))
    cust = fv.groupBy("region").agg(F.count_distinct("customer").alias("total_customers"))
    dash = kpi.build_dashboard(k, by=["region"], customers=cust).join(k.select("region", "marketing_roi"), "region")
    dash = cut_lineage(dash)  # a row a region
    an = A.zscore_outliers(_daily(spark, sf_dir, fv), {"revenue": "revenue", "expenses": "expenses"},
                           by=["region"], date="date")
    an = an.select("region", "metric", F.date_format("date", "yyyy-MM-dd").alias("period"),
                   F.struct("date", "metric").alias("anomaly_order"))
    return dash, J.apply_rules(dash, an, by=["region"])


@register("J6")
def q_j6(spark, sf_dir):
    return _rules(spark, sf_dir)[1].select("region", "ordinal", "_sub", "category", "finding", "action", "impact",
                                           "time_horizon")


@register("J7")
def q_j7(spark, sf_dir):
    dash, rules = _rules(spark, sf_dir)
    return J.action_plan(rules, dash, by=["region"])


@register("J8")
def q_j8(spark, sf_dir):
    bv = _kept(spark, sf_dir, V.finance_view)
    dash, _ = _rules(spark, sf_dir, bv)
    drivers = R.driver_analysis(bv, "revenue", by=["region"], columns=["quantity", "revenue", "expenses", "customer"])
    proj = M.linear_trend_forecast(_monthly(spark, sf_dir, bv), by=["region"])
    last = proj.groupBy("region").agg(F.max_by("projected_revenue", "step").alias("last_projection"),
                                      F.max("period").alias("last_period"),
                                      M.trend_label(F.first("revenue_slope")).alias("trend"))
    return J.observations(dash, drivers, last, by=["region"])


@register("J9_summary")
def q_j9_summary(spark, sf_dir):
    from bizlens.operators import context as CX
    bv = _kept(spark, sf_dir, V.business_view)
    pairs, imp, tr, reasons = _reasons(spark, sf_dir, bv)
    context = CX.business_context(bv, C.type_partition(bv), R.ranked_pairs(bv, columns=_RCOLS))
    rows = bv.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    return J.executive_summary(context, rows, pairs, tr, reasons, columns=len(bv.columns), by=["region"])


@register("J9")
def q_j9(spark, sf_dir):
    return J.health_narrative(region_health(spark, sf_dir), by=["region"])


# ---------------------------------------------------------------------------
# Spark ML and Arrow operators
# ---------------------------------------------------------------------------

from bizlens.operators import mlforecast as ML  # noqa: E402
from bizlens.operators.arima import SeasonalARIMA  # noqa: E402
from bizlens.operators.boosting import LeafwiseBoosting  # noqa: E402
from bizlens.operators import stationarity as ST  # noqa: E402


@register("D15")
def q_d15(spark, sf_dir):
    return _r(ST.stationarity(_daily(spark, sf_dir), order_by=["date"], by=["region"]), 6)


@register("M5")
def q_m5(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    rf = ML.random_forest()
    return _r(rf.predict_bands(rf.fit(s, ["region"]), 12, ["region"]), 2)


@register("M6")
def q_m6(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    gb = ML.gradient_boosting()
    return _r(gb.predict(gb.fit(s, ["region"]), 12, ["region"]), 2)


@register("M7")
def q_m7(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    ar = SeasonalARIMA(12)
    return _r(ar.predict_bands(ar.fit(s, ["region"]), 12, ["region"]), 0)


@register("M6_leafwise")
def q_m6_leafwise(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    gb = LeafwiseBoosting()
    return _r(gb.predict(gb.fit(s, ["region"]), 12, ["region"]), 2)


@register("M8")
def q_m8(spark, sf_dir):
    s = monthly_series(spark, sf_dir)
    return _r(ML.feature_importance(ML.random_forest().fit(s, ["region"])), 4)


@register("M10_ml")
def q_m10_ml(spark, sf_dir):
    return M.select_best_model(monthly_series(spark, sf_dir), [ML.random_forest(), ML.gradient_boosting()], _H,
                               by=["region"])


@register("M11")
def q_m11(spark, sf_dir):
    cands = [M.LinearTrend(), M.SeasonalNaive(12), M.HistoricalMean(), SeasonalARIMA(12)]
    return M.select_best_model(monthly_series(spark, sf_dir), cands, _H, by=["region"])


@register("M17")
def q_m17(spark, sf_dir):
    s = ML.multi_target_series(V.business_view(spark, sf_dir), "date", ["revenue", "expenses"], by=["region"])
    return M.select_best_model(s, _CANDIDATES, _H, by=["region", "target"])


@register("M23")
def q_m23(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("dow", F.dayofweek("date").cast("double")) \
        .withColumn("month_no", F.month("date").cast("double"))
    model, path = ML.train_tenant_model(d, ["expenses", "dow", "month_no"], "revenue", "region")
    pred = ML.load_tenant_model(path).transform(d)
    return pred.groupBy("region").agg(F.count(F.lit(1)).alias("rows"),
                                      F.round(F.avg("prediction"), 2).alias("mean_prediction"),
                                      F.round(F.avg(F.abs(F.col("prediction") - F.col("revenue"))), 2).alias("mae"))


@register("M23_update")
def q_m23_update(spark, sf_dir):
    # trained on the days before the cut, then updated with the others
    d = _daily(spark, sf_dir).withColumn("dow", F.dayofweek("date").cast("double")) \
        .withColumn("month_no", F.month("date").cast("double"))
    old = F.col("date") < F.lit("1998-06-01").cast("timestamp_ntz")
    args = ["expenses", "dow", "month_no"], "revenue", "region"
    path = ML.update_tenant_models(d.where(old), *args)
    ML.update_tenant_models(d.where(~old), *args, path=path)
    m = ML.tenant_models(spark, path, args[0])
    places = {"intercept": 1, "b_expenses": 4, "b_dow": 1, "b_month_no": 1, "r2": 5}
    return m.select("tenant", "n", *[F.round(c, p).alias(c) for c, p in places.items()])


# ---------------------------------------------------------------------------
# Sources and sinks (S)
# ---------------------------------------------------------------------------

import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from bizlens.session import checkpoint_dir as _ckpt  # noqa: E402
from bizlens.sources import readers as IO  # noqa: E402


def _scratch(spark, kind):
    return _os.path.join(_ckpt(spark), "io", f"{kind}-{_uuid.uuid4().hex}")


@register("S5")
def q_s5(spark, sf_dir):
    li = IO.load(spark, f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("S8")
def q_s8(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bench = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return IO.union_all([docs, bench])


@register("S9")
def q_s9(spark, sf_dir):
    return IO.validate(V.table(spark, sf_dir, "lineitem"), min_rows=5, min_columns=2)


@register("S11")
def q_s11(spark, sf_dir):
    return IO.preview(V.business_view(spark, sf_dir), 10, order_by=V.BV_ORDER)


def _csv_roundtrip(spark, sf_dir, sep):
    bv = V.business_view(spark, sf_dir).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "region", "segment", "product", "customer",
        F.round("revenue", 2).alias("revenue"), F.round("expenses", 2).alias("expenses"), "quantity")
    path = _scratch(spark, "csv")
    with _sized(spark, sf_dir):
        bv.write.option("header", True).option("sep", sep).csv(path)
    return path


def _typed_summary(df):
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("revenue"), 2).alias("revenue"),
                                    F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("S2")
def q_s2(spark, sf_dir):
    path = _csv_roundtrip(spark, sf_dir, ",")
    return _typed_summary(IO.read_csv(spark, path, infer=True))


@register("S3")
def q_s3(spark, sf_dir):
    path = _csv_roundtrip(spark, sf_dir, ";")
    return _typed_summary(IO.read_delimited(spark, path, infer=True))


@register("S4")
def q_s4(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    path = _scratch(spark, "json")
    IO.write_results(bv, path, fmt="json")
    return _typed_summary(IO.read_json(spark, path).withColumn("date", F.col("date").cast("timestamp_ntz")))


@register("S10")
def q_s10(spark, sf_dir):
    k = _finance_kpis(spark, sf_dir)
    path = _scratch(spark, "sink")
    IO.write_results(IO.to_json_records(k), path, fmt="parquet")
    return spark.read.parquet(path)


@register("S10_fields")
def q_s10_fields(spark, sf_dir):
    # the written JSON records, parsed again
    k = _finance_kpis(spark, sf_dir)
    path = _scratch(spark, "sink")
    IO.write_results(IO.to_json_records(k), path, fmt="parquet")
    return spark.read.parquet(path).select(F.from_json("json", k.schema).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# Streaming (W)
# ---------------------------------------------------------------------------

from bizlens.session import utc_session  # noqa: E402
from bizlens.streaming import kpis as WS  # noqa: E402
from bizlens.streaming import payments as WP  # noqa: E402


# Streams are built inside ``utc_session``: Spark binds the session zone into
# timestamp casts when a DataFrame is analysed, and the watermarked event time
# must be the UTC reading of the stored wall-clock times. Sinks hold
# ``timestamp_ntz``, so the returned tables do not depend on the zone.

@register("W2")
def q_w2(spark, sf_dir):
    with utc_session(spark):
        out = WS.run_available(WS.windowed_kpis(WS.event_stream(spark, sf_dir)), kind="kpis")
    return _r(out, 4)


@register("W3")
def q_w3(spark, sf_dir):
    with utc_session(spark):
        base = V.table(spark, sf_dir, "events")
        return WS.run_available(WS.stream_anomalies(WS.event_stream(spark, sf_dir), base), kind="anomalies")


@register("W4")
def q_w4(spark, sf_dir):
    with utc_session(spark):
        base, _ = _event_sides(spark, sf_dir)
        ev = WS.event_stream(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
        out = WS.drift_per_batch(ev, base.withColumn("ts", F.col("ts").cast("timestamp")), ["value", "k"],
                                 by=["event_type"])
    return _r(out, 6)


@register("W1")
def q_w1(spark, sf_dir):
    with utc_session(spark):
        return _w1(spark, sf_dir)


def _w1(spark, sf_dir, files: int = 3):
    # payment events derived from orders land as a few files, in parts of 500,000 orders; each file is a micro-batch
    src = _scratch(spark, "payments")
    parts = max(1, -(-V.table(spark, sf_dir, "orders").count() // (files * 500_000)))
    WP.write_in_files(WP.payment_events(spark, sf_dir), src, files * parts)
    schema = "event string, transaction_id long, tx_ref string, status string, event_time timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(src)
    subs = TN.subscriptions(spark, sf_dir)
    with WP.rocksdb_state(spark):
        out = WS.run_available(WP.subscription_state(stream, subs), kind="subscriptions")
    return out.select("subscription_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "transaction_id",
                      "status", "plan", F.col("expiry").cast("timestamp_ntz").alias("expiry"))


# ---------------------------------------------------------------------------
# Names, schema, context
# ---------------------------------------------------------------------------

@register("C1")
def q_c1(spark, sf_dir):
    fv = V.finance_view(spark, sf_dir)
    messy = fv.toDF(*[f"  {c.title().replace('_', ' ')}- " for c in fv.columns])
    return C.standardize_columns(messy, style="strict")


@register("C2")
def q_c2(spark, sf_dir):
    bv = V.business_view(spark, sf_dir)
    dup = bv.select("date", "revenue", "expenses", F.col("quantity").alias("revenue"))
    return C.standardize_columns(dup)


@register("C3")
def q_c3(spark, sf_dir):
    return C.detect_schema(V.finance_view(spark, sf_dir))


@register("C10")
def q_c10(spark, sf_dir):
    fv = V.finance_view(spark, sf_dir)
    std, mapping = C.map_canonical(fv)
    return std.select(*[F.col(c).alias(f) for f, c in mapping.items()])


@register("C12")
def q_c12(spark, sf_dir):
    fv = V.finance_view(spark, sf_dir)
    d, t = C.resolve_series_columns(fv, "Date", "REVENUE")
    return S.to_series(fv, d, t, by=["region"], period="month")


@register("C12_values")
def q_c12_values(spark, sf_dir):
    """No name settles the date or the target: both are found by their values."""
    fv = V.finance_view(spark, sf_dir).select(
        "region", F.col("customer").alias("code"), F.col("date").cast("string").alias("booked"),
        F.col("revenue").alias("cash_in"))
    d, t = C.resolve_series_columns(fv)
    return S.to_series(fv, d, t, by=["region"], period="month")


@register("C13")
def q_c13(spark, sf_dir):
    return C.priority_table(spark, V.finance_view(spark, sf_dir).columns)


@register("C14")
def q_c14(spark, sf_dir):
    from bizlens.operators import context as CX
    bv = V.business_view(spark, sf_dir)
    return CX.business_context(bv, C.type_partition(bv), R.ranked_pairs(bv, columns=_RCOLS),
                               importance=R.feature_importance(bv, "revenue", columns=_RCOLS))


@register("V1")
def q_v1(spark, sf_dir):
    bv = keep_rows(V.business_view(spark, sf_dir))  # each case reads them, some twice
    text = V.text_of(bv)
    cases = {"mixed": text.select("date_txt", "region", "customer"), "named": bv,
             "by_values": text.select("region", "iso_txt", "customer"), "none": text.select("region", "customer")}
    parts = [S.detect_structure(df).select(F.lit(name).alias("case_name"), "*") for name, df in cases.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("T2")
def q_t2(spark, sf_dir):
    view = V.business_view(spark, sf_dir)
    return R.best_category(profile.column_profile(view), view.columns)


@register("R5")
def q_r5(spark, sf_dir):
    pairs = R.ranked_pairs(V.business_view(spark, sf_dir), by=["region"], columns=_RCOLS)
    return _r(R.best_correlation(pairs, kpi="revenue", by=["region"]), 4)


@register("D13")
def q_d13(spark, sf_dir):
    t = V.view_text(spark, sf_dir).select("date_txt", "iso_txt", "region", "segment", "product", "quantity_txt")
    return D.clean(t, by=["region"], order_by=["iso_txt", "product", "quantity_txt"], text_columns=["segment"])


@register("K14")
def q_k14(spark, sf_dir):
    # every nation gets a KPI row; nations without orders get the empty-input defaults
    fv = V.finance_view(spark, sf_dir)
    nat = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), "n_nationkey")
    cust = V.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    withn = fv.join(cust, fv.customer == cust.c_custkey).join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"))
    fe, m = kpi.synthesize_profit(withn, V.FINANCE_MAPPING)
    k = kpi.compute_kpis(fe, m, by=["nation"], order_by=V.BV_ORDER)
    return kpi.with_empty_defaults(k, nat, by=["nation"]).select("nation", "total_revenue", "total_profit",
                                                                 "net_profit_margin", "revenue_growth", "empty_input")


@register("C8")
def q_c8(spark, sf_dir):
    return C.can_parse_datetime(V.view_text(spark, sf_dir), _TEXT_COLS)


@register("M12_cv")
def q_m12_cv(spark, sf_dir):
    """M10 with rolling-origin validation instead of one holdout."""
    return M.select_best_model(monthly_series(spark, sf_dir), _CANDIDATES, _H, by=["region"], validation="rolling")
