"""Insights, rules and narrative rows.

Everything here reads small per-group result rows (pairs, drivers, trends,
KPIs) and runs for every group at once: unions, expressions, bounded
``row_number`` filters, and - for the few order-dependent merges over at
most ten rows per group - a higher-order ``aggregate`` over a bounded array.
Rules are data: a fixed rules table is broadcast and joined to the
unpivoted KPI rows by a range condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import null_safe_join, q

# Insight templates (J1), reasoning phrases (J4) and recommendation texts.
CORRELATION_TEXT = "%s strongly influences %s (corr=%.2f)"
DRIVER_TEXT = "%s is a key driver of performance"
TREND_TEXT = "%s is %s over time"
REASONING_PHRASES = ["This indicates that ", "The data shows that ", "This reveals that "]

# J6 rules (order, metric, low, high, category, horizon, finding template,
# action, impact, plan prefix, functional list, functional prefix). low < value < high.
INF = float("inf")
RULES = [
    (0, "current_ratio", -INF, 1.25, "Liquidity & Working Capital", "30 Days",
     "Current Liquidity Ratio of %.2f indicates potential working capital pressure.",
     "Offer 2/10 net 30 early payment discounts to accelerate accounts receivable collections and liquidate stagnant inventory.",
     "Builds liquid cash reserves and stabilizes immediate operational cash flow.",
     "Working Capital", "risk_reduction", "Improve liquidity cushion"),
    (3, "net_profit_margin", -INF, 10.0, "Profitability & Cost Control", "90 Days",
     "Net Profit Margin stands at %.1f%% (Below 10.0%% benchmark).",
     "Conduct a vendor spend audit on top operating expenses and renegotiate COGS supplier contracts.",
     "Expands net profit margin by +3.0% to +5.0% within 90 days.",
     "Cost Audit", "profit_improvement", "COGS Optimization"),
    (4, "marketing_roi", 0.0, 2.5, "Marketing Efficiency", "90 Days",
     "Marketing ROI of %.2fx indicates sub-optimal spend efficiency.",
     "Reallocate performance advertising budgets away from underperforming channels toward high-converting segments.",
     "Increases customer acquisition efficiency by 25.0%.",
     "Marketing Reallocation", "revenue_improvement", "Acquisition Efficiency"),
    (5, "churn_rate", 4.0, INF, "Customer Retention", "90 Days",
     "Customer Churn Rate at %.1f%% exceeds healthy retention levels (<3.0%%).",
     "Implement an automated customer success workflow targeting accounts showing decreased product engagement.",
     "Protects recurring baseline revenue and lowers customer churn by 1.5%.",
     "Retention Automation", "revenue_improvement", "Churn Reduction"),
    (6, "revenue_growth", -INF, 5.0, "Revenue Expansion", "12 Months",
     "Annualized revenue growth rate is sluggish at %.1f%%.",
     "Introduce tiered value product/service bundles and expand cross-sell channels into adjacent customer segments.",
     "Drives long-term top-line growth by 8.0% to 15.0%.",
     "Market Expansion", "revenue_improvement", "Product Bundling"),
]
RULE_COLUMNS = ("ordinal int, metric string, low double, high double, category string, time_horizon string, "
                "finding_template string, action string, impact string, plan_prefix string, functional string, "
                "functional_prefix string")
# J7 defaults when a list is empty.
PLAN_DEFAULTS = {
    "30 Days": "Establish automated weekly financial performance reporting dashboards for department heads.",
    "90 Days": "Optimize customer onboarding workflows to increase 90-day retention and lifetime value.",
    "12 Months": "Evaluate strategic partnership and geographic expansion opportunities to increase enterprise valuation.",
    "revenue_improvement": "Refine sales expansion playbook and introduce cross-sell incentives for existing accounts.",
    "profit_improvement": "Audit administrative overhead to identify automation opportunities for recurring operational expenses.",
    "risk_reduction": "Conduct quarterly cybersecurity and compliance reviews to mitigate enterprise liability.",
}
# Metric defaults of J6: missing metrics count as 0, the current ratio as 1.
RULE_METRIC_DEFAULTS = {"current_ratio": 1.0, "net_profit_margin": 0.0, "marketing_roi": 0.0,
                        "churn_rate": 0.0, "revenue_growth": 0.0}


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


# ----------------------------------------------------------------------------
# J1-J3
# ----------------------------------------------------------------------------

def rank_insights(pairs: DataFrame, importance: DataFrame, trends: DataFrame, quality: DataFrame | None = None,
                  *, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """score = 0.5 strength + 0.3 impact + 0.2 confidence; keep > 0.5; top k per group.

    ``pairs``: (by, feature_1, feature_2, correlation, rank) from R2;
    ``importance``: (by, feature, importance, rank) from R3; ``trends``:
    (by, column, trend, slope) from T1; ``quality``: (by, missing, duplicates).
    """
    by = list(by)

    def pen(df):
        if quality is None:
            return df.withColumn("_mp", F.lit(0.0)).withColumn("_dp", F.lit(0.0))
        qq = quality.select(*_b(by), F.when(F.col("missing") > 0, 0.2).otherwise(0.0).alias("_mp"),
                            F.when(F.col("duplicates") > 0, 0.1).otherwise(0.0).alias("_dp"))
        return (df.join(qq, by, "left") if by else df.crossJoin(qq)).fillna(0.0, ["_mp", "_dp"])

    c = pen(pairs)
    corr = F.abs(F.col("correlation"))
    c = c.select(*_b(by), F.lit("correlation").alias("type"),
                 F.format_string(CORRELATION_TEXT, F.col("feature_1"), F.col("feature_2"), corr).alias("insight"),
                 F.array("feature_1", "feature_2").alias("features"), _clamp01(corr).alias("strength"),
                 F.when(corr > 0.6, 0.7).otherwise(0.4).alias("business_impact"),
                 F.greatest(F.lit(0.0), 1.0 - F.col("_mp") - F.col("_dp")).alias("confidence"),
                 F.lit(0).alias("_src"), F.col("rank").cast("long").alias("_ord"))
    fi = pen(importance)
    s = _clamp01(F.abs(F.col("importance")))
    fi = fi.select(*_b(by), F.lit("feature_importance").alias("type"),
                   F.format_string(DRIVER_TEXT, F.col("feature")).alias("insight"),
                   F.array("feature").alias("features"), s.alias("strength"),
                   F.when(s > 0.5, 0.8).otherwise(0.5).alias("business_impact"),
                   F.greatest(F.lit(0.0), 1.0 - F.col("_mp")).alias("confidence"),
                   F.lit(1).alias("_src"), F.col("rank").cast("long").alias("_ord"))
    tr = trends.select(*_b(by), F.lit("trend").alias("type"),
                       F.format_string(TREND_TEXT, F.col("column"), F.col("trend")).alias("insight"),
                       F.array("column").alias("features"), _clamp01(F.abs(F.col("slope"))).alias("strength"),
                       F.lit(0.6).alias("business_impact"), F.lit(1.0).alias("confidence"),
                       F.lit(2).alias("_src"), F.col("column_order").cast("long").alias("_ord"))
    u = c.unionByName(fi).unionByName(tr)
    score = F.round(0.5 * F.col("strength") + 0.3 * F.col("business_impact") + 0.2 * F.col("confidence"), 3)
    u = u.select(*_b(by), "type", "insight", "features", F.round("strength", 3).alias("strength"),
                 F.round("business_impact", 3).alias("business_impact"), F.round("confidence", 3).alias("confidence"),
                 score.alias("score"), "_src", "_ord")
    w = Window.partitionBy(*_b(by)).orderBy(F.desc("score"), "_src", "_ord")
    return (u.filter(F.col("score") > 0.5).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).drop("_src", "_ord"))


def deduplicate_exact(ranked: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """key = type + sorted features; the best score is kept (first on ties);
    ``first_rank`` keeps the first-seen order of each key."""
    key = F.concat_ws(":", F.col("type"), F.concat_ws("-", F.array_sort("features")))
    row = F.struct("type", "insight", "features", "strength", "business_impact", "confidence", "score", "rank")
    g = ranked.groupBy(*_b(by), key.alias("key")).agg(
        F.max_by(row, F.struct(F.col("score"), -F.col("rank"))).alias("r"), F.min("rank").alias("first_rank"))
    return g.select(*_b(by), "key", "first_rank", "r.*")


def _similar(a: Column, b: Column, ignore: Sequence[str] = ()) -> Column:
    la, lb = F.lower(a), F.lower(b)

    def words(t):
        w = F.array_distinct(F.split(t, " "))
        return F.array_except(w, F.array(*[F.lit(x) for x in ignore])) if ignore else w

    shared = F.size(F.array_intersect(words(la), words(lb)))
    return F.contains(lb, la) | F.contains(la, lb) | (shared > 3)


def merge_similar(unique: DataFrame, *, by: Sequence[str] = (), ignore_words: Sequence[str] = ()) -> DataFrame:
    """Greedy merge in first-seen order: an insight whose text contains (or
    is contained in) an earlier kept one, or shares > 3 words with it, is
    merged into it - replacing it when its score is higher. The fold runs
    over the group's <= 10 rows collected into one array. By default every
    "X is a key driver of performance" pair merges (the reference's
    behaviour); ``ignore_words`` (e.g. the template words) stops that."""
    cols = ["type", "insight", "features", "strength", "business_impact", "confidence", "score"]
    st = F.struct(*[F.col(c) for c in cols])
    g = unique.groupBy(*_b(by)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("first_rank"), st.alias("v")))),
                    lambda e: e["v"]).alias("items"))  # bounded: <= k rows per group

    def step(acc, x):
        hits = F.filter(F.transform(acc, lambda e, i: F.when(_similar(x["insight"], e["insight"], ignore_words), i)),
                        lambda i: i.isNotNull())
        idx = F.array_min(hits)
        replaced = F.transform(acc, lambda e, i: F.when((i == idx) & (x["score"] > e["score"]), x).otherwise(e))
        return F.when(idx.isNull(), F.concat(acc, F.array(x))).otherwise(replaced)

    empty = F.slice(F.col("items"), 1, 0)
    merged = g.select(*_b(by), F.aggregate(F.col("items"), empty, step).alias("m"))
    out = merged.select(*_b(by), F.posexplode("m").alias("_pos", "r")).select(*_b(by), "_pos", "r.*")
    w = Window.partitionBy(*_b(by)).orderBy(F.desc("score"), "_pos")
    return out.withColumn("rank", F.row_number().over(w)).drop("_pos")


# ----------------------------------------------------------------------------
# J4 reasoning, J5 recommendations
# ----------------------------------------------------------------------------

def reasoning(insights: DataFrame, pairs: DataFrame, importance: DataFrame, trends: DataFrame,
              quality: DataFrame | None = None, *, by: Sequence[str] = (), kpi: str = "key business metrics",
              target: str | None = None) -> DataFrame:
    """One row per group: reasoning text, opportunities and risks (distinct, 5 each)."""
    by = list(by)
    target = target or kpi
    ins = insights.filter(F.col("rank") <= 5).groupBy(*_b(by)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "insight"))), lambda e: e["insight"]).alias("ins"))
    phr = F.array(*[F.lit(p) for p in REASONING_PHRASES])
    blocks = F.transform(F.col("ins"), lambda t, i: F.concat(
        F.element_at(phr, (i % 3 + 1).cast("int")), F.lower(t), F.lit(f", which impacts {kpi}.")))
    opp_i = F.transform(F.filter(F.col("ins"), lambda t: F.lower(t).contains("increase") | F.lower(t).contains("positive")),
                        lambda t: F.lit(f"Leverage this positive driver to improve {kpi}."))
    risk_i = F.transform(F.filter(F.col("ins"), lambda t: F.lower(t).contains("decrease") | F.lower(t).contains("negative")),
                         lambda t: F.lit(f"Decline in this area could negatively affect {kpi}."))
    top_pair = pairs.filter(F.col("rank") == 1).select(*_b(by), "feature_1", "feature_2", "correlation")
    top_feat = importance.filter(F.col("rank") == 1).select(*_b(by), "feature")
    tr3 = trends.filter(F.col("column_order") < 3).groupBy(*_b(by)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column_order", "column", "trend"))),
                    lambda e: F.struct(e["column"].alias("c"), e["trend"].alias("t"))).alias("tr"))
    j = ins
    for other in (top_pair, top_feat, tr3):
        j = j.join(other, by, "left") if by else j.crossJoin(other)
    if quality is not None:
        j = j.join(quality, by, "left") if by else j.crossJoin(quality)
    else:
        j = j.withColumn("missing", F.lit(0)).withColumn("duplicates", F.lit(0))
    pair_block = F.when(F.col("feature_1").isNotNull(), F.format_string(
        "There is a measurable relationship between %s and %s (correlation: %.2f), meaning changes in %s directly influence %s.",
        "feature_1", "feature_2", "correlation", "feature_1", "feature_2"))
    feat_block = F.when(F.col("feature").isNotNull(), F.format_string(
        f"%s is a major driver of {target}, making it a high-impact optimization variable.", "feature"))
    trend_blocks = F.transform(F.coalesce(F.col("tr"), F.array().cast("array<struct<c:string,t:string>>")), lambda e: F.when(
        e["t"] == "increasing", F.concat(e["c"], F.lit(" shows an upward trend indicating growth momentum.")))
        .when(e["t"] == "decreasing", F.concat(e["c"], F.lit(" is declining, indicating potential performance risk."))))
    all_blocks = F.filter(F.concat(blocks, F.array(pair_block, feat_block), trend_blocks), lambda x: x.isNotNull())
    opps = F.concat(opp_i, F.array(
        F.when(F.col("feature_1").isNotNull(), F.format_string("Improving %s can significantly enhance %s performance.",
                                                              "feature_1", "feature_2")),
        F.when(F.col("feature").isNotNull(), F.format_string(f"Prioritize optimization of %s to improve {target}.", "feature"))),
        F.transform(F.coalesce(F.col("tr"), F.array().cast("array<struct<c:string,t:string>>")),
                    lambda e: F.when(e["t"] == "increasing",
                                     F.concat(F.lit("Capitalize on increasing "), e["c"], F.lit(" to scale performance.")))))
    risks = F.concat(risk_i, F.transform(F.coalesce(F.col("tr"), F.array().cast("array<struct<c:string,t:string>>")),
                                         lambda e: F.when(e["t"] == "decreasing", F.concat(
                                             F.lit("Declining "), e["c"], F.lit(" may negatively affect business outcomes.")))),
                     F.array(F.when(F.col("missing") > 0, F.lit(
                         "Data quality issues detected (missing values present), which may reduce accuracy.")),
                         F.when(F.col("duplicates") > 0, F.lit(
                             "Duplicate records detected, which may distort analytical insights."))))
    clean = lambda a: F.slice(F.array_distinct(F.filter(a, lambda x: x.isNotNull())), 1, 5)
    return j.select(*_b(by), F.array_join(all_blocks, " ").alias("reasoning"),
                    clean(opps).alias("opportunities"), clean(risks).alias("risks"))


def recommendations(pairs: DataFrame, importance: DataFrame, trends: DataFrame, reasons: DataFrame, *,
                    by: Sequence[str] = (), kpi: str = "key metric", target: str | None = None,
                    k: int = 7) -> DataFrame:
    """Typed priorities from the top pair, top driver, first 3 trends, 3 opportunities
    and 3 risks; distinct (action, reason); high > medium > low, stable; top k."""
    by = list(by)
    target = target or kpi
    rec = lambda pr, a, r, i, o: F.struct(F.lit(pr).alias("priority") if isinstance(pr, str) else pr.alias("priority"),
                                          a.alias("action"), r.alias("reason"), i.alias("impact"), F.lit(o).alias("o"))
    p = pairs.filter(F.col("rank") == 1).select(*_b(by), rec(
        "high", F.format_string("Increase focus on optimizing %s", "feature_1"),
        F.format_string("%s strongly influences %s (correlation: %.2f)", "feature_1", "feature_2", "correlation"),
        F.lit(f"Direct improvement in {kpi}"), 0).alias("x"), F.lit(0).alias("_i"))
    f = importance.filter(~F.col("feature").isin(target, kpi))
    wf = Window.partitionBy(*_b(by)).orderBy(F.desc("importance"), "rank")
    f = f.withColumn("_r", F.row_number().over(wf)).filter(F.col("_r") == 1).select(*_b(by), rec(
        "high", F.format_string("Prioritize improvement of %s", "feature"),
        F.format_string(f"%s is a strong driver of {target}", "feature"),
        F.lit(f"Significant uplift in {target}"), 1).alias("x"), F.lit(0).alias("_i"))
    t = trends.filter((F.col("column_order") < 3) & F.col("trend").isin("increasing", "decreasing")).select(
        *_b(by), rec(F.when(F.col("trend") == "increasing", "medium").otherwise("high"),
                     F.when(F.col("trend") == "increasing", F.format_string("Scale initiatives related to %s", "column"))
                     .otherwise(F.format_string("Investigate and reverse decline in %s", "column")),
                     F.when(F.col("trend") == "increasing", F.format_string("%s is trending upward", "column"))
                     .otherwise(F.format_string("%s is trending downward", "column")),
                     F.when(F.col("trend") == "increasing", F.lit("Opportunity for growth"))
                     .otherwise(F.lit("Prevent performance loss")), 2).alias("x"),
        F.col("column_order").alias("_i"))
    o = reasons.select(*_b(by), F.posexplode(F.slice("opportunities", 1, 3)).alias("_i", "op")).select(
        *_b(by), rec("medium", F.col("op"), F.lit("Derived from AI reasoning"),
                     F.lit("Potential performance improvement"), 3).alias("x"), "_i")
    r = reasons.select(*_b(by), F.posexplode(F.slice("risks", 1, 3)).alias("_i", "rk")).select(
        *_b(by), rec("high", F.concat(F.lit("Mitigate risk: "), F.col("rk")), F.lit("Identified risk from AI reasoning"),
                     F.lit("Prevent negative outcomes"), 4).alias("x"), "_i")
    u = p.unionByName(f).unionByName(t).unionByName(o).unionByName(r).select(*_b(by), "x.*", "_i")
    first = Window.partitionBy(*_b(by), "action", "reason").orderBy("o", "_i")
    u = u.withColumn("_d", F.row_number().over(first)).filter(F.col("_d") == 1)
    prio = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    w = Window.partitionBy(*_b(by)).orderBy(F.desc(prio), "o", "_i")
    return u.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("o", "_i", "_d")


# ----------------------------------------------------------------------------
# J6 rules, J7 plan, J8 observations, J9 summary
# ----------------------------------------------------------------------------

def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_COLUMNS)


def apply_rules(metrics: DataFrame, anomalies: DataFrame | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """Rules triggered per group: (category, finding, action, impact, time_horizon, ordinal).

    KPI rows are unpivoted to (metric, value) with the rule defaults, then
    joined to the broadcast rules table on metric and low < value < high.
    The first two anomalies of each group add Risk Mitigation rows.
    """
    by = list(by)
    spark = metrics.sparkSession
    vals = [F.coalesce(F.col(m).cast("double"), F.lit(d)).alias(m) for m, d in RULE_METRIC_DEFAULTS.items()]
    long = metrics.select(*_b(by), *vals).unpivot(by, list(RULE_METRIC_DEFAULTS), "metric", "value")
    rules = F.broadcast(rules_table(spark))  # five fixed rows
    j = long.join(rules, (long.metric == rules.metric) & (long.value > rules.low) & (long.value < rules.high))
    fired = j.select(*_b(by), "ordinal", "category", F.expr("format_string(finding_template, value)").alias("finding"),
                     "action", "impact", "time_horizon", "plan_prefix", "functional", "functional_prefix",
                     F.lit(0).alias("_sub"))
    if anomalies is not None:
        wa = Window.partitionBy(*_b(by)).orderBy("anomaly_order")
        a = anomalies.withColumn("_k", F.row_number().over(wa)).filter(F.col("_k") <= 2)
        act = F.format_string("Investigate root cause of variance spike in %s during period %s.", "metric", "period")
        ar = a.select(*_b(by), F.lit(1).alias("ordinal"), F.lit("Risk Mitigation").alias("category"),
                      F.format_string("Flagged risk event: %s on %s.", "metric", "period").alias("finding"),
                      act.alias("action"), F.lit("Prevents recurring operational cost leakage.").alias("impact"),
                      F.lit("30 Days").alias("time_horizon"), F.lit("Risk Audit").alias("plan_prefix"),
                      F.lit("risk_reduction").alias("functional"),
                      F.format_string("Investigate %s outlier to prevent margin erosion.", "metric").alias("functional_prefix"),
                      F.col("_k").alias("_sub"))
        fired = fired.unionByName(ar)
    return fired


def action_plan(rules: DataFrame, groups: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """30-day / 90-day / 12-month lists and revenue / profit / risk lists per group, with defaults."""
    by = list(by)
    r = rules.select(*_b(by), "ordinal", "_sub", "time_horizon", "functional",
                     F.concat_ws(": ", "plan_prefix", "action").alias("plan_item"),
                     F.when(F.col("functional") == "risk_reduction",
                            F.when(F.col("category") == "Risk Mitigation", F.col("functional_prefix"))
                            .otherwise(F.concat_ws(": ", "functional_prefix", "action")))
                     .otherwise(F.concat_ws(": ", "functional_prefix", "action")).alias("func_item"))

    def lst(cond, item):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ordinal", "_sub", item.alias("t"))))),
                           lambda e: e["t"])  # bounded: at most 7 rules per group

    g = r.groupBy(*_b(by)).agg(
        lst(F.col("time_horizon") == "30 Days", F.col("plan_item")).alias("immediate_30_days"),
        lst(F.col("time_horizon") == "90 Days", F.col("plan_item")).alias("medium_term_90_days"),
        lst(F.col("time_horizon") == "12 Months", F.col("plan_item")).alias("long_term_12_months"),
        lst(F.col("functional") == "revenue_improvement", F.col("func_item")).alias("revenue_improvement"),
        lst(F.col("functional") == "profit_improvement", F.col("func_item")).alias("profit_improvement"),
        lst(F.col("functional") == "risk_reduction", F.col("func_item")).alias("risk_reduction"))
    j = groups.select(*_b(by)).join(g, by, "left") if by else g
    def dflt(c, key):
        return F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c)).otherwise(F.array(F.lit(PLAN_DEFAULTS[key])))
    return j.select(*_b(by), dflt("immediate_30_days", "30 Days").alias("immediate_30_days"),
                    dflt("medium_term_90_days", "90 Days").alias("medium_term_90_days"),
                    dflt("long_term_12_months", "12 Months").alias("long_term_12_months"),
                    dflt("revenue_improvement", "revenue_improvement").alias("revenue_improvement"),
                    dflt("profit_improvement", "profit_improvement").alias("profit_improvement"),
                    dflt("risk_reduction", "risk_reduction").alias("risk_reduction"))


def observations(dashboard: DataFrame, drivers: DataFrame | None = None, forecast_last: DataFrame | None = None,
                 *, by: Sequence[str] = ()) -> DataFrame:
    """Narrative observations from growth / margin, churn, top driver, forecast and ROI."""
    by = list(by)
    j = dashboard
    if drivers is not None:
        d = drivers.filter(F.col("rank") == 1).select(*_b(by), "driver", "relationship_strength", "correlation")
        j = j.join(d, by, "left") if by else j.crossJoin(d)
    if forecast_last is not None:
        j = j.join(forecast_last, by, "left") if by else j.crossJoin(forecast_last)
    g, m = F.coalesce(F.col("revenue_growth"), F.lit(0.0)), F.coalesce(F.col("net_profit_margin"), F.lit(0.0))
    gm = F.col("gross_margin")
    ch = F.coalesce(F.col("churn_rate"), F.lit(0.0))
    first = (F.when((g > 5) & (m > 15), F.format_string(
        "Strong operational expansion: Revenue expanded by %.2f%% while sustaining high net profit margins of %.2f%%.", g, m))
        .when((g > 5) & (m <= 5), F.format_string(
            "Revenue is expanding (+%.2f%%), but net profit margin remains constrained at %.2f%%, indicating operational cost pressures.", g, m))
        .when(g < 0, F.format_string(
            "Revenue contracted by %.2f%% over the evaluated timeframe with a net margin profile of %.2f%%.", F.abs(g), m))
        .otherwise(F.concat(F.format_string("Revenue growth remains stable at %.2f%% with a net margin of %.2f%%", g, m),
                            F.when(gm.isNotNull(), F.format_string(" and gross margin of %.2f%%", gm)).otherwise(F.lit("")),
                            F.lit("."))))
    churn = (F.when(ch > 10, F.format_string(
        "Elevated customer churn risk: Churn rate is currently elevated at %.2f%%, requiring customer retention focus.", ch))
        .when(ch > 0, F.format_string("Customer retention is healthy with a churn rate controlled at %.2f%%.", ch)))
    parts = [first, churn]
    if drivers is not None:
        parts.append(F.when(F.col("driver").isNotNull(), F.format_string(
            "Primary revenue driver identified: '%s' shows a %s correlation score of %.2f with top-line income.",
            "driver", F.lower("relationship_strength"), "correlation")))
    if forecast_last is not None:
        parts.append(F.when(F.col("last_projection").isNotNull(), F.format_string(
            "Forecasting models indicate a %s trajectory, projecting revenue to reach $%,.2f by %s.",
            F.lower("trend"), "last_projection", "last_period")))
    if "marketing_roi" in dashboard.columns:
        roi = F.col("marketing_roi")
        parts.append(F.when(roi > 3, F.format_string(
            "Marketing efficiency is high, generating $%.2f in revenue per dollar spent (%.2fx ROI).", roi, roi))
            .when(roi > 0, F.format_string(
                "Marketing ROI stands at %.2fx, suggesting opportunity for acquisition channel optimization.", roi)))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return j.select(*_b(by), F.posexplode(arr).alias("ordinal", "observation"))


def health_narrative(health: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One summary sentence per group from the health score (70 / 50 bands) and risk."""
    s = F.col("health_score")
    band = (F.when(s >= 70, "demonstrates strong financial health")
            .when(s >= 50, "shows moderate financial stability with room for improvement")
            .otherwise("faces significant financial challenges that require immediate attention"))
    text = F.format_string("The business %s with a health score of %.1f/100 (%s) and %s risk exposure.",
                           band, s, F.col("status"), F.lower(F.col("risk_level")))
    return health.select(*_b(by), text.alias("summary"))


# The sentences of the executive summary.
SUMMARY_INTRO = "This analysis examines a %s dataset consisting of %d records and %d variables, with a focus on improving %s."
SUMMARY_DRIVER = ("The results show a strong relationship between %s and %s (correlation: %.2f), indicating that changes in %s "
                  "are closely linked to performance in %s.")
SUMMARY_UP = "%s is trending upward, suggesting positive momentum."
SUMMARY_DOWN = "%s is showing a decline, which may require attention."
SUMMARY_OPPORTUNITY = "A key opportunity lies in %s"
SUMMARY_RISK = "However, %s"


def executive_summary(context: DataFrame, rows: DataFrame, pairs: DataFrame, trends: DataFrame, reasons: DataFrame, *,
                      columns: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., summary): the dataset, its strongest pair, the first trend, opportunity and
    risk, each where there is one. ``context``: the C14 row; ``rows``: (by..., rows)."""
    by = list(by)
    top = pairs.filter(F.col("rank") == 1).select(*_b(by), "feature_1", "feature_2", "correlation")
    first = trends.filter(F.col("column_order") == 0).select(*_b(by), "column", "trend")
    why = reasons.select(*_b(by), F.get("opportunities", F.lit(0)).alias("opportunity"), F.get("risks", F.lit(0)).alias("risk"))
    j = rows.crossJoin(context.select("domain", "kpi"))  # one row of context
    for other in (top, first, why):
        j = null_safe_join(j, other, by, "left") if by else j.join(other, how="left")
    parts = [F.format_string(SUMMARY_INTRO, "domain", "rows", F.lit(columns), F.coalesce("kpi", F.lit("performance"))),
             F.when(F.col("feature_1").isNotNull(), F.format_string(SUMMARY_DRIVER, "feature_1", "feature_2", "correlation",
                                                                    "feature_1", "feature_2")),
             F.when(F.col("trend") == "increasing", F.format_string(SUMMARY_UP, "column"))
             .when(F.col("trend") == "decreasing", F.format_string(SUMMARY_DOWN, "column")),
             F.when(F.col("opportunity").isNotNull(), F.format_string(SUMMARY_OPPORTUNITY, F.lower("opportunity"))),
             F.when(F.col("risk").isNotNull(), F.format_string(SUMMARY_RISK, F.lower("risk")))]
    return j.select(*_b(by), F.concat_ws(" ", *parts).alias("summary"))
