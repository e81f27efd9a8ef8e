"""The three end-to-end runs of the reference, as compositions of operators.

Each function returns a dict of result DataFrames for every group of ``by``
at once. The cleaned / typed input feeds several results, so it is written
once to the shared checkpoint folder (``cut_lineage``) instead of being
recomputed by every result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators import anomaly, clean, forecast, insight, kpi, profile, relate, schema
from bizlens.session import cut_lineage


def data_intelligence(df: DataFrame, *, time_col: str, by: Sequence[str] = (),
                      order_by: Sequence[str] | None = None, k: int = 10) -> dict[str, DataFrame]:
    """clean -> profile -> correlate -> trends -> ranked, de-duplicated insights -> reasoning -> recommendations."""
    by = list(by)
    cleaned = cut_lineage(clean.clean(df, by=by, order_by=order_by))  # order_by: standardised names
    cols = relate.analysis_columns(cleaned, by)
    pairs = relate.ranked_pairs(cleaned, by=by, columns=cols, k=k)
    kpi_col = sorted(cols, key=lambda c: -schema.priority_score(c))[0]
    imp = relate.feature_importance(cleaned, kpi_col, by=by, columns=cols)
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    tr = relate.trends(cleaned, time_col=time_col, by=by, columns=cols).withColumn(
        "column_order", order[F.col("column")])
    miss = profile.missing_values(cleaned, by=by).groupBy(*by).agg(F.sum("missing").alias("missing"))
    dups = profile.duplicate_rows(cleaned, by=by).select(*by, F.col("duplicate_rows").alias("duplicates"))
    qual = miss.join(dups, by) if by else miss.crossJoin(dups)
    ranked = insight.rank_insights(pairs, imp, tr, qual, by=by)
    merged = insight.merge_similar(insight.deduplicate_exact(ranked, by=by), by=by)
    reasons = insight.reasoning(merged, pairs, imp, tr, qual, by=by, kpi=kpi_col)
    return {
        "profile": profile.column_profile(cleaned, by=by),
        "numeric_summary": profile.describe(cleaned, by=by),
        "correlations": pairs,
        "feature_importance": imp,
        "trends": tr,
        "insights": merged,
        "reasoning": reasons,
        "recommendations": insight.recommendations(pairs, imp, tr, reasons, by=by, kpi=kpi_col),
    }


def prediction(series: DataFrame, *, horizon: int = 12, by: Sequence[str] = (),
               candidates: Sequence[forecast.Forecaster] | None = None, validation: str = "holdout",
               freq: str = "MS") -> dict[str, DataFrame]:
    """validate -> select the model per series -> refit -> intervals -> scenarios -> summary, risks, actions."""
    by = list(by)
    series = cut_lineage(series)
    cands = list(candidates or [forecast.LinearTrend(), forecast.SeasonalNaive(12), forecast.HistoricalMean()])
    selection = forecast.select_best_model(series, cands, min(horizon, 12), by=by, validation=validation)
    best = selection.filter("is_best").select(*by, "model", "MAPE")
    preds = None
    for m in cands:  # every series is forecast by its own winner; one job per candidate
        p = m.predict(m.fit(series, by), horizon, by).withColumn("model", F.lit(m.name))
        preds = p if preds is None else preds.unionByName(p)
    chosen = preds.join(best.select(*by, "model"), [*by, "model"]).drop("model")
    dated = forecast.attach_dates(chosen, series, horizon, by=by, freq=freq)
    bt = forecast.backtest(series, cands, min(horizon, 12), by=by).join(best.select(*by, "model"), [*by, "model"])
    with_bounds = forecast.intervals(dated, series, by=by, resid=forecast.residuals(bt))
    scen = forecast.scenarios(with_bounds, series, by=by)
    mape = best.select(*by, "MAPE")
    summary = forecast.forecast_summary(scen, series, mape, by=by)
    return {"model_selection": selection, "forecast": scen, "summary": summary,
            "risks": forecast.assess_risks(scen, mape, by=by),
            "actions": forecast.generate_actions(summary, scen, by=by),
            "chart": forecast.chart_series(series, scen, by=by)}


def recommendation(df: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = (),
                   order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """map -> quality -> features -> KPIs -> anomalies -> health -> linear forecast -> rules and plan."""
    by = list(by)
    base = cut_lineage(df)
    counted = profile.distinct_counts(base)
    quality = profile.quality_score(base, mapping, by=by, counted=counted)
    fe, m = kpi.synthesize_profit(counted, mapping)
    k = kpi.compute_kpis(fe, m, by=by, order_by=order_by, weight="_n")
    q = quality.select(*by, "data_quality_score")
    health = kpi.health_score(k.join(q, by) if by else k.crossJoin(q), by=by)
    dash = kpi.build_dashboard(k, by=by).join(k.select(*by, "marketing_roi"), by) if by else \
        kpi.build_dashboard(k).crossJoin(k.select("marketing_roi"))
    anomalies = anomaly.zscore_outliers(base, m, by=by, date=m.get("date"))
    rules_in = anomalies.select(*by, "metric", F.date_format("date", "yyyy-MM-dd").alias("period"),
                                F.struct("date", "metric").alias("anomaly_order")) if m.get("date") else None
    rules = insight.apply_rules(dash, rules_in, by=by)
    out = {"quality": quality, "kpis": k, "health": health, "dashboard": dash, "anomalies": anomalies,
           "rules": rules, "action_plan": insight.action_plan(rules, dash, by=by),
           "alerts": anomaly.kpi_alerts(k, by=by)}
    if mapping.get("date") and mapping.get("revenue"):
        cols = [mapping["revenue"]] + ([mapping["expenses"]] if mapping.get("expenses") else [])
        monthly = relate.monthly_rollup(base, mapping["date"], by=by, columns=cols)
        monthly = monthly.withColumnRenamed(mapping["revenue"], "revenue")
        if mapping.get("expenses"):
            monthly = monthly.withColumnRenamed(mapping["expenses"], "expenses")
        proj = forecast.linear_trend_forecast(monthly, by=by, expenses="expenses" if mapping.get("expenses") else None)
        out["projection"] = proj
        out["horizons"] = forecast.horizon_summary(proj, by=by)
    return out
