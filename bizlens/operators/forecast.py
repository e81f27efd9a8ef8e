"""Forecasting and evaluation.

Series are long frames ``(by..., ts, y)`` - period aggregates, one small
sorted partition per series. Every step is grouped over the series keys, so
thousands of series (companies x regions x targets) run in the same jobs:

* forecasters implement ``fit(train, by) -> model frame`` and
  ``predict(model, horizon, by) -> (by..., step, forecast)`` (M4);
* backtests use a holdout (M9) or rolling-origin folds (M12), metrics are
  one conditional aggregate per (series, model) (M13), and the winner is a
  ``row_number`` over (MAPE, candidate order) (M10);
* intervals, scenarios, summaries, risks and actions are projections and
  small aggregates over the forecast rows (M15-M22).

Spark ML forecasters (M5, M6) train ONE global model over all series with
the series key as an indexed feature, and roll forward recursively.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import q

# Z for the confidence levels; scenario drift factor.
Z_SCORES = {0.80: 1.282, 0.90: 1.645, 0.95: 1.960, 0.99: 2.576}
SCENARIO_FACTOR = 0.08


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _win(by: Sequence[str]):
    return Window.partitionBy(*_b(by))


def with_index(series: DataFrame, *, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Row position t = 0..n-1 inside each series and its length n."""
    w = _win(by).orderBy(F.col(q(ts)))
    return series.withColumn("t", (F.row_number().over(w) - 1).cast("long")) \
        .withColumn("n", F.count(F.lit(1)).over(_win(by)))


# ----------------------------------------------------------------------------
# M1-M3 linear trend on monthly sums
# ----------------------------------------------------------------------------

def linear_trend_forecast(monthly: DataFrame, *, by: Sequence[str] = (), month: str = "month",
                          revenue: str = "revenue", expenses: str | None = "expenses",
                          periods: int = 12) -> DataFrame:
    """M1: least squares on the month number; at least 12 months ahead.

    ``monthly`` has every month present (``relate.monthly_rollup``). Returns
    (by..., step, period 'yyyy-MM', projected_revenue, projected_expenses,
    projected_profit, revenue_slope, std_error); revenue and expenses are
    floored at 0, profit is the difference before flooring.
    """
    h = max(periods, 12)
    x = with_index(monthly, by=by, ts=month)
    r = F.col(q(revenue))
    aggs = [F.count(F.lit(1)).alias("n"), F.max(F.col(q(month))).alias("_last"),
            F.regr_slope(r, F.col("t").cast("double")).alias("b_rev"),
            F.regr_intercept(r, F.col("t").cast("double")).alias("a_rev")]
    if expenses:
        e = F.col(q(expenses))
        aggs += [F.regr_slope(e, F.col("t").cast("double")).alias("b_exp"),
                 F.regr_intercept(e, F.col("t").cast("double")).alias("a_exp"),
                 F.sum(e).alias("s_exp")]
    fit = x.groupBy(*_b(by)).agg(*aggs).filter(F.col("n") >= 2)
    resid = x.join(fit.select(*_b(by), "a_rev", "b_rev"), list(by)) if by else x.crossJoin(fit.select("a_rev", "b_rev"))
    sig = resid.groupBy(*_b(by)).agg(
        F.coalesce(F.stddev_pop(r - (F.col("a_rev") + F.col("b_rev") * F.col("t"))), F.lit(0.0)).alias("std_error"))
    fit = fit.join(sig, list(by)) if by else fit.crossJoin(sig)
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    tf = (F.col("n") + F.col("step") - 1).cast("double")
    pr = F.col("a_rev") + F.col("b_rev") * tf
    cols = [*_b(by), "step",
            F.date_format(F.add_months(F.col("_last").cast("date"), F.col("step")), "yyyy-MM").alias("period"),
            F.round(F.greatest(pr, F.lit(0.0)), 2).alias("projected_revenue")]
    if expenses:
        pe = F.col("a_exp") + F.col("b_exp") * tf
        use = F.col("s_exp") > 0
        cols += [F.when(use, F.round(F.greatest(pe, F.lit(0.0)), 2)).alias("projected_expenses"),
                 F.when(use, F.round(pr - pe, 2)).alias("projected_profit")]
    cols += [F.col("b_rev").alias("revenue_slope"), "std_error"]
    return steps.select(*cols)


def horizon_summary(projection: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """M2: next month / quarter / year sums with +-1.96 sigma sqrt(h) bounds, floor 0."""
    g = projection.groupBy(*_b(by)).agg(
        *[F.sum(F.when(F.col("step") <= k, F.col("projected_revenue"))).alias(f"rev{k}") for k in (1, 3, 12)],
        *[F.sum(F.when(F.col("step") <= k, F.coalesce(F.col("projected_profit"), F.lit(0.0)))).alias(f"prof{k}")
          for k in (1, 3, 12)],
        F.first("std_error").alias("std_error"))
    rows = []
    for name, k in (("next_month", 1), ("next_quarter", 3), ("next_year", 12)):
        rev = F.round(F.col(f"rev{k}"), 2)
        m = 1.96 * F.col("std_error") * (k ** 0.5)
        rows.append(F.struct(F.lit(name).alias("horizon"), F.lit(k).alias("months"), rev.alias("revenue"),
                             F.round(F.col(f"prof{k}"), 2).alias("profit"),
                             F.round(F.greatest(F.lit(0.0), rev - m), 2).alias("lower_bound_revenue"),
                             F.round(rev + m, 2).alias("upper_bound_revenue")))
    return g.select(*_b(by), F.inline(F.array(*rows)))


def trend_label(slope: Column) -> Column:
    """M3: slope < -50 downward, > 50 upward, else stable."""
    return (F.when(slope < -50, "Downward Trajectory").when(slope > 50, "Upward Acceleration")
            .otherwise("Stable / Horizontal"))


# ----------------------------------------------------------------------------
# M4 forecaster interface and SQL-expressible forecasters
# ----------------------------------------------------------------------------

@dataclass
class Forecaster:
    """M4: ``fit(train, by) -> model frame``; ``predict(model, horizon, by)``."""
    name: str

    def fit(self, train: DataFrame, by: Sequence[str]) -> DataFrame:
        raise NotImplementedError

    def predict(self, model: DataFrame, horizon: int, by: Sequence[str]) -> DataFrame:
        """(by..., step, forecast) for step 1..horizon."""
        raise NotImplementedError

    @staticmethod
    def _steps(model: DataFrame, horizon: int) -> DataFrame:
        return model.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))


class LinearTrend(Forecaster):
    """Least squares on the row position."""

    def __init__(self):
        super().__init__("linear_trend")

    def fit(self, train, by):
        x = with_index(train, by=by)
        t = F.col("t").cast("double")
        return x.groupBy(*_b(by)).agg(F.count(F.lit(1)).alias("n"),
                                      F.coalesce(F.regr_slope("y", t), F.lit(0.0)).alias("b"),
                                      F.coalesce(F.regr_intercept("y", t), F.avg("y")).alias("a"))

    def predict(self, model, horizon, by):
        s = self._steps(model, horizon)
        return s.select(*_b(by), "step", (F.col("a") + F.col("b") * (F.col("n") + F.col("step") - 1)).alias("forecast"))


class SeasonalNaive(Forecaster):
    """Repeats the last season: forecast(h) = y[n - s + ((h - 1) mod s)]."""

    def __init__(self, season: int = 12):
        super().__init__(f"seasonal_naive_{season}")
        self.season = season

    def fit(self, train, by):
        x = with_index(train, by=by)
        s = self.season
        last = x.filter(F.col("t") >= F.col("n") - s)
        return last.groupBy(*_b(by)).agg(
            F.count(F.lit(1)).alias("m"),
            F.sort_array(F.collect_list(F.struct("t", "y"))).alias("season"))  # <= s values per series

    def predict(self, model, horizon, by):
        s = self._steps(model, horizon)
        idx = (F.col("step") - 1) % F.col("m")
        return s.select(*_b(by), "step", F.element_at(F.col("season"), (idx + 1).cast("int"))["y"].alias("forecast"))


class HistoricalMean(Forecaster):
    def __init__(self):
        super().__init__("historical_mean")

    def fit(self, train, by):
        return train.groupBy(*_b(by)).agg(F.avg("y").alias("mu"))

    def predict(self, model, horizon, by):
        return self._steps(model, horizon).select(*_b(by), "step", F.col("mu").alias("forecast"))


# ----------------------------------------------------------------------------
# M9 holdout, M12 rolling origin, M13 metrics, M14 residuals, M10 selection
# ----------------------------------------------------------------------------

def holdout_split(series: DataFrame, horizon: int, *, by: Sequence[str] = ()) -> DataFrame:
    """M9: last min(max(1, h), max(1, int(n/4))) rows are the test set."""
    x = with_index(series, by=by)
    size = F.least(F.lit(max(1, int(horizon))), F.greatest(F.lit(1), F.floor(F.col("n") * 0.25).cast("long")))
    return x.withColumn("test_size", size).withColumn(
        "role", F.when(F.col("t") >= F.col("n") - F.col("test_size"), "test").otherwise("train"))


def rolling_origin_folds(series: DataFrame, horizon: int, *, by: Sequence[str] = (), n_splits: int = 3,
                         min_train: int = 12) -> DataFrame:
    """Expanding-window folds (fold, split, test_end) per series, then each row's
    role in each fold: rows with position < split train, split <= position < test_end test."""
    x = with_index(series, by=by)
    n = F.col("n")
    h = F.lit(horizon)
    start0 = n - n_splits * horizon
    start = F.when(start0 < min_train, F.lit(min_train)).otherwise(start0)
    step = (F.greatest(F.lit(1), F.floor((n - start - h) / max(1, n_splits - 1)).cast("long"))
            if n_splits > 1 else h)
    small = n < (min_train + horizon)
    folds = F.when(small, F.array(F.struct(F.lit(0).alias("fold"),
                                           F.greatest(F.lit(1), n - h).cast("long").alias("split"),
                                           n.cast("long").alias("test_end"))))
    regular = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda i: F.struct(
        i.alias("fold"), (start + i * step).cast("long").alias("split"),
        F.least(start + i * step + h, n).cast("long").alias("test_end"))),
        lambda f: (f["split"] < n) & (f["split"] >= min_train))
    # The reference stops at the first invalid fold; folds are increasing, so filtering is the same.
    x = x.withColumn("_folds", folds.otherwise(regular))
    out = x.select("*", F.explode("_folds").alias("_f"))
    pos = F.col("t")
    role = F.when(pos < F.col("_f.split"), "train").when(pos < F.col("_f.test_end"), "test")
    return out.select(*_b(by), "ts", "y", F.col("_f.fold").alias("fold"), F.col("_f.split").alias("split"),
                      F.col("_f.test_end").alias("test_end"), role.alias("role")).filter(F.col("role").isNotNull())


def metrics(pairs: DataFrame, *, by: Sequence[str] = (), y: str = "y", yhat: str = "forecast") -> DataFrame:
    """MAPE (y != 0), RMSE, MAE, sMAPE, R2 (0 if constant), max error; one aggregate per group."""
    a, p = F.col(q(y)), F.col(q(yhat))
    r = a - p
    den = (F.abs(a) + F.abs(p)) / 2.0
    g = pairs.groupBy(*_b(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(a != 0, F.abs(r / a))).alias("_mape"),
        F.sqrt(F.avg(r * r)).alias("_rmse"), F.avg(F.abs(r)).alias("_mae"),
        F.avg(F.when(den != 0, F.abs(r) / den)).alias("_smape"),
        F.sum(r * r).alias("_ssr"), (F.var_pop(a) * F.count(a)).alias("_sst"),
        F.max(F.abs(r)).alias("_maxe"))
    return g.select(*_b(by), "n",
                    F.round(F.coalesce(F.col("_mape"), F.lit(0.0)), 4).alias("MAPE"),
                    F.round("_rmse", 2).alias("RMSE"), F.round("_mae", 2).alias("MAE"),
                    F.round(F.coalesce(F.col("_smape"), F.lit(0.0)), 4).alias("sMAPE"),
                    F.round(F.when(F.col("_sst") > 0, 1.0 - F.col("_ssr") / F.col("_sst")).otherwise(0.0), 4).alias("R2"),
                    F.round("_maxe", 2).alias("MAX_ERROR"))


def residuals(pairs: DataFrame, *, y: str = "y", yhat: str = "forecast") -> DataFrame:
    """Actual - predicted."""
    return pairs.withColumn("residual", F.col(q(y)) - F.col(q(yhat)))


def backtest(series: DataFrame, candidates: Sequence[Forecaster], horizon: int, *,
             by: Sequence[str] = ()) -> DataFrame:
    """Holdout predictions of every candidate: (by..., model, ordinal, ts, y, forecast)."""
    split = holdout_split(series, horizon, by=by)
    train = split.filter(F.col("role") == "train").select(*_b(by), "ts", "y")
    test = split.filter(F.col("role") == "test").select(
        *_b(by), "ts", "y", (F.col("t") - (F.col("n") - F.col("test_size")) + 1).alias("step"))
    out = None
    for i, m in enumerate(candidates):
        fit = m.fit(train, by)
        pred = m.predict(fit, horizon, by)
        j = test.join(pred, [*by, "step"]).select(
            *_b(by), F.lit(m.name).alias("model"), F.lit(i).alias("ordinal"), "ts", "y", "forecast")
        out = j if out is None else out.unionByName(j)
    return out


def rolling_backtest(series: DataFrame, candidates: Sequence[Forecaster], horizon: int, *,
                     by: Sequence[str] = (), n_splits: int = 3, min_train: int = 12) -> DataFrame:
    """M12 applied: predictions of every candidate on every rolling-origin fold,
    (by..., fold, model, ordinal, ts, y, forecast); all series of a fold fit together."""
    folds = rolling_origin_folds(series, horizon, by=by, n_splits=n_splits, min_train=min_train)
    out = None
    for f in range(n_splits):
        fold = folds.filter(F.col("fold") == f)
        train = fold.filter(F.col("role") == "train").select(*_b(by), "ts", "y")
        w = _win(by).orderBy("ts")
        test = fold.filter(F.col("role") == "test").select(*_b(by), "ts", "y").withColumn(
            "step", F.row_number().over(w))
        for i, m in enumerate(candidates):
            pred = m.predict(m.fit(train, by), horizon, by)
            j = test.join(pred, [*by, "step"]).select(*_b(by), F.lit(f).alias("fold"), F.lit(m.name).alias("model"),
                                                      F.lit(i).alias("ordinal"), "ts", "y", "forecast")
            out = j if out is None else out.unionByName(j)
    return out


def select_best_model(series: DataFrame, candidates: Sequence[Forecaster], horizon: int, *,
                      by: Sequence[str] = (), validation: str = "holdout") -> DataFrame:
    """Metrics per (series, model); lowest MAPE wins, first on ties.

    ``validation='holdout'`` (the reference's path) scores the last test
    window; ``'rolling'`` averages the metrics of the rolling-origin folds
    (the cross-validation the reference builds but never calls). A candidate
    that yields no finite prediction scores MAPE = inf, as in the
    reference's failure path. Returns every candidate with ``is_best``.
    """
    finite_pred = F.col("forecast").isNotNull() & ~F.isnan("forecast")
    if validation == "rolling":
        bt = rolling_backtest(series, candidates, horizon, by=by).filter(finite_pred)
        per_fold = metrics(bt, by=[*by, "model", "ordinal", "fold"])
        mt = per_fold.groupBy(*_b(by), "model", "ordinal").agg(
            F.sum("n").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("MAPE", "RMSE", "MAE", "sMAPE", "R2",
                                                                              "MAX_ERROR")])
    else:
        bt = backtest(series, candidates, horizon, by=by).filter(finite_pred)
        mt = metrics(bt, by=[*by, "model", "ordinal"])
    names = series.sparkSession.createDataFrame([(m.name, i) for i, m in enumerate(candidates)],
                                                "model string, ordinal int")
    keys = series.select(*_b(by)).distinct() if by else None
    grid = keys.crossJoin(F.broadcast(names)) if keys is not None else names  # candidates list is tiny
    full = grid.join(mt, [*by, "model", "ordinal"], "left").withColumn(
        "MAPE", F.coalesce(F.col("MAPE"), F.lit(float("inf"))))
    w = _win(by).orderBy(F.col("MAPE"), F.col("ordinal"))
    return full.withColumn("is_best", F.row_number().over(w) == 1)


# ----------------------------------------------------------------------------
# M15-M22 intervals, scenarios, summaries
# ----------------------------------------------------------------------------

def intervals(forecast: DataFrame, history: DataFrame, *, by: Sequence[str] = (),
              resid: DataFrame | None = None, confidence: float = 0.95) -> DataFrame:
    """Z * sigma * sqrt(step); sigma = population std of residuals (> 2 of
    them) else 10 % of the history's std; lower floored at 0 when the history
    is non-negative."""
    z = Z_SCORES.get(confidence, 1.960)
    hs = history.groupBy(*_b(by)).agg(F.stddev_pop("y").alias("_hsd"), F.count("y").alias("_hn"),
                                      F.min("y").alias("_hmin"))
    st = hs
    if resid is not None:
        rs = resid.groupBy(*_b(by)).agg(F.stddev_pop("residual").alias("_rsd"), F.count("residual").alias("_rn"))
        st = st.join(rs, list(by), "left") if by else st.crossJoin(rs)
    else:
        st = st.withColumn("_rsd", F.lit(None).cast("double")).withColumn("_rn", F.lit(0))
    sigma = F.when(F.col("_rn") > 2, F.col("_rsd")).when(F.col("_hn") > 0, F.col("_hsd") * 0.10).otherwise(1.0)
    j = forecast.join(st, list(by), "left") if by else forecast.crossJoin(st)
    m = F.lit(z) * sigma * F.sqrt(F.col("step").cast("double"))
    lower = F.round(F.col("forecast") - m, 2)
    return j.select(*[F.col(q(c)) for c in forecast.columns],
                    F.when(F.col("_hmin") >= 0, F.greatest(lower, F.lit(0.0))).otherwise(lower).alias("lower_bound"),
                    F.round(F.col("forecast") + m, 2).alias("upper_bound"))


def scenarios(forecast: DataFrame, history: DataFrame, *, by: Sequence[str] = (),
              factor: float = SCENARIO_FACTOR) -> DataFrame:
    """Volatility v = std/mean of the history (0.05 if undefined);
    conservative = min(f (1 - (0.08 + 0.01 v t)), lower), optimistic mirrored."""
    hs = history.groupBy(*_b(by)).agg(F.stddev_pop("y").alias("_sd"), F.avg("y").alias("_mu"), F.count("y").alias("_n"))
    v = F.when((F.col("_n") > 1) & (F.col("_mu") != 0), F.col("_sd") / F.col("_mu")).otherwise(0.05)
    j = forecast.join(hs, list(by), "left") if by else forecast.crossJoin(hs)
    t = F.col("step")
    down = 1.0 - (factor + 0.01 * v * t)
    up = 1.0 + (factor + 0.01 * v * t)
    base = [c for c in forecast.columns if c != "forecast"]
    return j.select(*[F.col(q(c)) for c in base], F.round("forecast", 2).alias("forecast"),
                    F.round(F.least(F.col("forecast") * down, F.col("lower_bound")), 2).alias("conservative"),
                    F.round(F.greatest(F.col("forecast") * up, F.col("upper_bound")), 2).alias("optimistic"))


def forecast_summary(forecast: DataFrame, history: DataFrame, mape: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """M18 + M19: baseline, totals, growth vs last value, labels, best period."""
    last = history.groupBy(*_b(by)).agg(F.max_by("y", "ts").alias("_last"))
    f = forecast.groupBy(*_b(by)).agg(F.sum("forecast").alias("_tot"), F.avg("forecast").alias("_avg"),
                                      F.max_by("ts", "forecast").alias("best_period"),
                                      F.count(F.lit(1)).alias("horizon"))
    j = f.join(last, list(by)).join(mape, list(by), "left") if by else f.crossJoin(last).crossJoin(mape)
    growth = F.when(F.col("_last") > 0, (F.col("_avg") - F.col("_last")) / F.col("_last") * 100.0).otherwise(0.0)
    m = F.coalesce(F.col("MAPE"), F.lit(0.0))
    return j.select(*_b(by), F.round("_last", 2).alias("current_period_baseline"),
                    F.round("_tot", 2).alias("projected_horizon_total"),
                    F.round("_avg", 2).alias("projected_period_average"),
                    F.round(growth, 2).alias("growth_rate_pct"),
                    F.when(growth > 2, "UPWARD GROWTH").when(growth < -2, "DOWNWARD SLUMP").otherwise("STABLE / FLAT")
                    .alias("trend_direction"),
                    F.when(m < 0.05, "High (MAPE < 5%)").when(m < 0.15, "Moderate (MAPE < 15%)")
                    .otherwise("Low confidence").alias("forecast_confidence"),
                    "best_period", "horizon")


def assess_risks(scen: DataFrame, mape: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One row per risk flag: high variance, downside gap, negative drift, else low risk."""
    g = scen.groupBy(*_b(by)).agg(F.sum("forecast").alias("_f"), F.sum("conservative").alias("_c"),
                                  F.min_by("forecast", "step").alias("_first"), F.max_by("forecast", "step").alias("_lastf"),
                                  F.count(F.lit(1)).alias("_h"))
    j = g.join(mape, list(by), "left") if by else g.crossJoin(mape)
    gap = F.when(F.col("_f") > 0, (F.col("_f") - F.col("_c")) / F.col("_f") * 100.0).otherwise(0.0)
    flags = F.array(F.when(F.coalesce(F.col("MAPE"), F.lit(0.0)) > 0.15, F.lit("high_forecast_variance")),
                    F.when(gap > 10.0, F.lit("downside_exposure")),
                    F.when((F.col("_h") > 1) & (F.col("_lastf") < F.col("_first")), F.lit("negative_horizon_drift")))
    present = F.filter(flags, lambda x: x.isNotNull())
    risks = F.when(F.size(present) > 0, present).otherwise(F.array(F.lit("low_operational_risk")))
    return j.select(*_b(by), F.posexplode(risks).alias("ordinal", "risk"), F.round(gap, 1).alias("downside_gap_pct"))


def generate_actions(summary: DataFrame, scen: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Growth-driven action, the conservative floor, and monitoring."""
    mc = scen.groupBy(*_b(by)).agg(F.min("conservative").alias("min_conservative"))
    j = summary.join(mc, list(by)) if by else summary.crossJoin(mc)
    g = F.col("growth_rate_pct")
    acts = F.array(F.when(g > 5, F.lit("capital_commitment")).when(g < -2, F.lit("cost_realignment")),
                   F.lit("risk_mitigation"), F.lit("continuous_monitoring"))
    return j.select(*_b(by), F.posexplode(F.filter(acts, lambda x: x.isNotNull())).alias("ordinal", "action"),
                    F.round("min_conservative", 2).alias("min_conservative"))


def chart_series(history: DataFrame, scen: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Long-form (series, ts, value) of history, forecast, bounds and scenarios."""
    hist = history.select(*_b(by), F.lit("history").alias("series"), "ts", F.col("y").alias("value"))
    parts = [hist]
    for c in ("forecast", "lower_bound", "upper_bound", "conservative", "optimistic"):
        parts.append(scen.select(*_b(by), F.lit(c).alias("series"), "ts", F.col(c).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_dates(pred: DataFrame, series: DataFrame, horizon: int, *, by: Sequence[str] = (),
                 freq: str = "MS") -> DataFrame:
    """Forecast step -> calendar date after each series' last date (V8)."""
    from bizlens.operators.series import future_dates
    fd = future_dates(series, int(horizon), by=by, freq=freq)
    return pred.join(fd, [*by, "step"])
