"""Derived features (F1-F4), KPIs (K1-K16) and the health score (H1-H4).

The KPI operator is two aggregates: (by, month) partials, then by (hash
aggregates but for latest-value fields, whose struct order needs a sort).
Both carry only partial sums, so the shuffle is one row per (group, month)
per map task whatever the row count, and a hot group is already combined
map-side. Health scoring is projections on the one-row-per-group result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import clamp, div, finite, lit_null, null_safe_join, q

# Health weights and tiers (must equal the reference).
HEALTH_WEIGHTS = {
    "profit_margin": 0.25,
    "revenue_growth": 0.20,
    "ebitda_margin": 0.15,
    "current_ratio": 0.15,
    "churn_rate": 0.15,
    "data_quality": 0.10,
}

KPI_COLUMNS = [
    "total_revenue", "total_expenses", "total_profit", "net_profit_margin", "gross_margin",
    "operating_margin", "ebitda_margin", "revenue_growth", "customer_growth", "churn_rate",
    "total_marketing_spend", "marketing_roi", "cac", "cash_balance", "current_ratio",
    "debt_ratio", "inventory_turnover",
]


def _c(name: str) -> Column:
    return F.col(q(name))


# ----------------------------------------------------------------------------
# F1-F4 derived features
# ----------------------------------------------------------------------------

def synthesize_profit(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, dict]:
    """add profit = revenue - expenses (or expenses = revenue - profit), NULL as 0."""
    m = dict(mapping)
    rev, exp, prof = m.get("revenue"), m.get("expenses"), m.get("profit")
    if rev and exp and not prof:
        df = df.withColumn("_synth_profit", F.coalesce(_c(rev), F.lit(0.0)) - F.coalesce(_c(exp), F.lit(0.0)))
        m["profit"] = "_synth_profit"
    elif rev and prof and not exp:
        df = df.withColumn("_synth_expenses", F.coalesce(_c(rev), F.lit(0.0)) - F.coalesce(_c(prof), F.lit(0.0)))
        m["expenses"] = "_synth_expenses"
    return df, m


def engineer_features(df: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = (),
                      order_by: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Synthesised profit, margin %, calendar parts, lag-1 revenue growth.

    The lag runs per ``by`` group ordered by date (then ``order_by`` for ties) as
    one pass over range-partitioned rows (``plans.carry``): no group is ever
    sorted in one task. NULL is a group of its own.
    """
    df, m = synthesize_profit(df, mapping)
    rev, prof, date = m.get("revenue"), m.get("profit"), m.get("date")
    if rev and prof:
        rv = F.coalesce(_c(rev).cast("double"), F.lit(0.0))
        pv = F.coalesce(_c(prof).cast("double"), F.lit(0.0))
        df = df.withColumn("_profit_margin_pct", F.when(rv > 0, pv / rv * 100.0).otherwise(0.0))
    if date:
        d = _c(date)
        df = (df.withColumn("_year", F.year(d)).withColumn("_month", F.month(d))
              .withColumn("_year_month", F.date_trunc("month", d).cast("date")))
        if rev:
            rv = F.coalesce(_c(rev).cast("double"), F.lit(0.0))
            from bizlens.plans.carry import neighbours
            okeys = ["__dnull", date, *[c for c in (order_by or []) if c != date and c not in by]]
            cols = df.columns
            keyed = df.withColumn("__dnull", d.isNull().cast("int")).withColumn("__rv", rv)
            near = neighbours(keyed, list(by), okeys, ["__rv"], inclusive=False)
            df = near.select(*[_c(c) for c in cols], F.col("__pv0").alias("_revenue_lag1"))
            g = F.when(F.col("_revenue_lag1") > 0,
                       (rv - F.col("_revenue_lag1")) / F.col("_revenue_lag1") * 100.0).otherwise(0.0)
            df = df.withColumn("_revenue_growth_pct", F.coalesce(finite(g), F.lit(0.0)))
    return df, m


# ----------------------------------------------------------------------------
# K1-K13 KPI row per group
# ----------------------------------------------------------------------------

_SUM_FIELDS = ["revenue", "expenses", "profit", "gross_profit", "cogs", "operating_expenses",
               "marketing_spend", "new_customers", "churned_customers"]
_MEAN_FIELDS = ["churn_rate", "cac", "inventory", "active_customers", "debt_to_equity"]
_LAST_FIELDS = ["cash_balance", "debt", "equity"]


def compute_kpis(df: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = (),
                 order_by: Sequence[str] | None = None, weight: str | None = None, stored: bool = False) -> DataFrame:
    """K1-K13 for every group of ``by`` in two aggregates.

    ``mapping`` maps canonical fields (revenue, expenses, profit, date, ...)
    to columns. Rows are ordered by date, then ``order_by`` for "last value"
    metrics; without a date column ``order_by`` is the row order.
    ``weight`` names a multiplicity column (rows already collapsed to
    distinct rows with counts, e.g. by the quality profile): sums and
    counts are weighted, first / last values are unaffected.
    ``stored`` tells that the rows are cheap to read again: last values then
    come from the rows of each group's last date, and no aggregate sorts the rows.
    """
    m = {k: v for k, v in mapping.items() if v in df.columns}
    if "active_customers" not in m and "customers" in m:
        m["active_customers"] = m["customers"]
    by = list(by)
    date = m.get("date")
    order_cols = ([date] if date else []) + [c for c in (order_by or []) if c != date]
    if not order_cols:
        raise ValueError("compute_kpis needs a date mapping or order_by for first/last values")

    # Order key: date first with NULL dates last, then the tie-breakers.
    okey = F.struct(*([F.when(_c(date).isNull(), 1).otherwise(0).alias("_dnull")] if date else []),
                    *[_c(c).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    month = F.date_trunc("month", _c(date)) if date else F.lit(None).cast("timestamp")

    wt = _c(weight) if weight else None

    def wsum(v):
        return F.sum(v * wt) if wt is not None else F.sum(v)

    def wcount(v):
        return F.sum(F.when(v.isNotNull(), wt)) if wt is not None else F.count(v)

    pre = []
    for f in _SUM_FIELDS:
        if f in m:
            pre.append(wsum(finite(_c(m[f]))).alias(f"{f}__s"))
    for f in _MEAN_FIELDS:
        if f in m:
            v = finite(_c(m[f]))
            pre += [wsum(v).alias(f"{f}__s"), wcount(v).alias(f"{f}__n")]
    lasts = [f for f in _LAST_FIELDS if f in m]
    again = bool(stored and date and lasts)
    if not again:
        pre += [F.max_by(finite(_c(m[f])), okey).alias(f"{f}__last") for f in lasts]
    if "revenue" in m:
        rv = finite(_c(m["revenue"]))
        pre.append(wcount(rv).alias("rev__n"))
        # First / last row values serve growth only without dates; struct-ordered
        # min_by / max_by force a sort-based aggregate, so they are added only then.
        if not date:
            pre += [F.min_by(rv, F.when(rv.isNotNull(), okey)).alias("rev__first"),
                    F.max_by(rv, F.when(rv.isNotNull(), okey)).alias("rev__lastv"),
                    F.min(F.when(rv.isNotNull(), okey)).alias("rev__fo"),
                    F.max(F.when(rv.isNotNull(), okey)).alias("rev__lo")]
    if "active_customers" in m:
        ac = finite(_c(m["active_customers"]))
        pre += [F.min_by(ac, F.when(ac.isNotNull(), okey)).alias("ac__first"),
                F.max_by(ac, F.when(ac.isNotNull(), okey)).alias("ac__lastv"),
                F.min(F.when(ac.isNotNull(), okey)).alias("ac__fo"),
                F.max(F.when(ac.isNotNull(), okey)).alias("ac__lo")]
    pre.append((F.sum(wt) if wt is not None else F.count(F.lit(1))).alias("n__rows"))
    if lasts and not again:
        pre.append(F.max(okey).alias("okey__max"))

    monthly = df.groupBy(*[_c(b) for b in by], month.alias("_month")).agg(*pre)

    # Second level: one row per group.
    agg = [F.sum("n__rows").alias("n_rows")]
    for f in _SUM_FIELDS:
        if f in m:
            agg.append(F.coalesce(F.sum(f"{f}__s"), F.lit(0.0)).alias(f"s_{f}"))
    for f in _MEAN_FIELDS:
        if f in m:
            agg.append(div(F.sum(f"{f}__s"), F.sum(f"{f}__n").cast("double")).alias(f"mean_{f}"))
    if not again:
        agg += [F.max_by(f"{f}__last", "okey__max").alias(f"last_{f}") for f in lasts]
    if "revenue" in m:
        mrev = F.when(F.col("_month").isNotNull(), F.coalesce(F.col("revenue__s"), F.lit(0.0)))
        agg += [F.sum("rev__n").alias("rev_n"),
                (F.min_by("rev__first", "rev__fo") if not date else F.lit(None).cast("double")).alias("rev_first_row"),
                (F.max_by("rev__lastv", "rev__lo") if not date else F.lit(None).cast("double")).alias("rev_last_row"),
                F.count(F.col("_month")).alias("n_months"),
                F.min_by(mrev, F.col("_month")).alias("rev_first_month"),
                F.max_by(mrev, F.col("_month")).alias("rev_last_month")]
    if "active_customers" in m:
        agg += [F.min_by("ac__first", "ac__fo").alias("ac_first"),
                F.max_by("ac__lastv", "ac__lo").alias("ac_last"),
                F.sum("active_customers__n").alias("ac_n")]
    has_dates = F.count(F.col("_month")) > 0
    agg.append(has_dates.alias("has_dates"))
    g = monthly.groupBy(*[_c(b) for b in by]).agg(*agg)
    if again:
        # a NULL date is later than any other
        top = df.groupBy(*[_c(b) for b in by]).agg(F.max(_c(date).isNull()).alias("_undated"), F.max(_c(date)).alias("_top"))
        near = null_safe_join(df, F.broadcast(top), by).where(  # one row a group
            F.when(F.col("_undated"), _c(date).isNull()).otherwise(_c(date) == F.col("_top")))
        g = null_safe_join(g, near.groupBy(*[_c(b) for b in by]).agg(
            *[F.max_by(finite(_c(m[f])), okey).alias(f"last_{f}") for f in lasts]), by, "left")

    return g.select(*[_c(b) for b in by], *_kpi_exprs(m, date is not None))


def _kpi_exprs(m: Mapping[str, str], dated: bool) -> list[Column]:
    has = lambda f: f in m
    n = F.col("n_rows")
    rev = F.col("s_revenue") if has("revenue") else F.lit(0.0)
    exp = F.col("s_expenses") if has("expenses") else F.lit(0.0)
    if has("profit"):
        prof = F.col("s_profit")
    elif has("revenue") and has("expenses"):
        prof = rev - exp
    else:
        prof = F.lit(0.0)
    out = {
        "total_revenue": F.round(rev, 2),
        "total_expenses": F.round(exp, 2),
        "total_profit": F.round(prof, 2),
        "net_profit_margin": F.when(rev > 0, F.round(prof / rev * 100.0, 2)).otherwise(0.0),
    }
    if has("gross_profit"):
        gm = F.when(rev > 0, F.round(F.col("s_gross_profit") / rev * 100.0, 2))
    elif has("cogs"):
        gm = F.when(rev > 0, F.round((rev - F.col("s_cogs")) / rev * 100.0, 2))
    else:
        gm = lit_null()
    out["gross_margin"] = gm
    if has("operating_expenses"):
        om = F.when(rev > 0, F.round((rev - F.col("s_operating_expenses")) / rev * 100.0, 2))
    elif has("expenses"):
        om = F.when(rev > 0, F.round((rev - exp) / rev * 100.0, 2))
    else:
        om = lit_null()
    out["operating_margin"] = om
    out["ebitda_margin"] = F.round(om * 1.05, 2)

    # K5 revenue growth: first to last calendar month sum; without dates first to last row.
    if has("revenue"):
        by_month = F.when((F.col("n_months") >= 2) & (F.col("rev_first_month") > 0),
                          F.round((F.col("rev_last_month") - F.col("rev_first_month"))
                                  / F.col("rev_first_month") * 100.0, 2)).otherwise(0.0)
        by_row = F.when(F.col("rev_first_row") > 0,
                        F.round((F.col("rev_last_row") - F.col("rev_first_row"))
                                / F.col("rev_first_row") * 100.0, 2)).otherwise(0.0)
        growth = (F.when((n <= 1) | (F.col("rev_n") < 2), F.lit(0.0))
                  .when(F.col("has_dates"), by_month).otherwise(by_row)) if dated else (
            F.when((n <= 1) | (F.col("rev_n") < 2), F.lit(0.0)).otherwise(by_row))
    else:
        growth = F.lit(0.0)
    out["revenue_growth"] = growth.cast("double")

    # K6 customer growth.
    if has("active_customers"):
        out["customer_growth"] = F.when(
            (n > 1) & (F.col("ac_n") >= 2) & (F.col("ac_first") > 0),
            F.round((F.col("ac_last") - F.col("ac_first")) / F.col("ac_first") * 100.0, 2)
        ).otherwise(0.0)
    else:
        out["customer_growth"] = lit_null()

    # K7 churn.
    if has("churn_rate"):
        a = F.col("mean_churn_rate")
        scaled = F.when((a > 0) & (a <= 1), a * 100.0).otherwise(a)
        out["churn_rate"] = F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)), 2)
    elif has("churned_customers") and has("active_customers"):
        act = F.col("mean_active_customers")
        out["churn_rate"] = F.when(act > 0, F.round(F.col("s_churned_customers") / act * 100.0, 2)).otherwise(0.0)
    else:
        out["churn_rate"] = lit_null()

    # K8/K9 marketing.
    mkt = F.col("s_marketing_spend") if has("marketing_spend") else lit_null()
    out["total_marketing_spend"] = F.round(mkt, 2)
    out["marketing_roi"] = F.when(mkt > 0, F.round(rev / mkt, 2))
    if has("cac"):
        out["cac"] = F.round(F.col("mean_cac"), 2)
    elif has("marketing_spend") and has("new_customers"):
        nc = F.col("s_new_customers")
        out["cac"] = F.when((mkt > 0) & (nc > 0), F.round(mkt / nc, 2))
    else:
        out["cac"] = lit_null()

    # K10-K13 balance sheet.
    cash = F.col("last_cash_balance") if has("cash_balance") else lit_null()
    debt = F.col("last_debt") if has("debt") else lit_null()
    equity = F.col("last_equity") if has("equity") else lit_null()
    inv = F.col("mean_inventory") if has("inventory") else lit_null()
    out["cash_balance"] = F.round(cash, 2)
    if has("debt_to_equity"):
        dr = F.round(F.col("mean_debt_to_equity"), 2)
    else:
        dr = (F.when(debt.isNotNull() & equity.isNotNull() & (equity > 0), F.round(debt / equity, 2))
              .when(debt.isNotNull() & cash.isNotNull() & ((cash + debt) > 0), F.round(debt / (cash + debt), 2)))
    out["debt_ratio"] = dr
    monthly_exp = F.when(n > 0, exp / (n / 30.0)).otherwise(0.0)
    out["current_ratio"] = F.when(cash.isNotNull() & (monthly_exp > 0), F.round(cash / monthly_exp, 2))
    out["inventory_turnover"] = F.when(inv.isNotNull() & (inv > 0), F.round(exp / inv, 2))
    return [out[k].cast("double").alias(k) for k in KPI_COLUMNS]


# ----------------------------------------------------------------------------
# K15/K16 dashboard
# ----------------------------------------------------------------------------

DASHBOARD_COLUMNS = [
    "total_revenue", "total_expenses", "net_profit", "net_profit_margin", "gross_margin",
    "ebitda_margin", "operating_margin", "revenue_growth", "total_customers", "customer_growth",
    "churn_rate", "customer_lifetime_value", "roi", "current_ratio", "debt_ratio",
    "inventory_turnover",
]


def build_dashboard(kpis: DataFrame, *, by: Sequence[str] = (),
                    customers: DataFrame | None = None) -> DataFrame:
    """16 executive metrics with the documented defaults.

    ``customers`` (by..., total_customers) comes from ``count_distinct`` over
    the customer id column; without it the default of 100 applies. The
    ``imputed`` array names every metric that used a default.
    """
    by = list(by)
    k = kpis
    if customers is not None:
        k = k.join(customers, by, "left") if by else k.crossJoin(customers)
    else:
        k = k.withColumn("total_customers", lit_null("bigint"))
    net = F.col("net_profit_margin")
    growth = F.col("revenue_growth")
    defaults = {
        "gross_margin": F.least(F.greatest(net + 25.0, F.lit(0.0)), F.lit(85.0)),
        "ebitda_margin": net * 1.15,
        "operating_margin": net * 1.05,
        "customer_growth": F.least(F.greatest(growth * 0.65, F.lit(-50.0)), F.lit(100.0)),
        "churn_rate": F.greatest(F.lit(0.5), 5.0 - growth * 0.1),
        "current_ratio": F.lit(1.5),
        "debt_ratio": F.lit(0.2),
        "inventory_turnover": F.lit(5.0),
    }
    cols = {
        "total_revenue": F.col("total_revenue"),
        "total_expenses": F.col("total_expenses"),
        "net_profit": F.col("total_profit"),
        "net_profit_margin": net,
        "revenue_growth": growth,
    }
    imputed = []
    for name, dflt in defaults.items():
        cols[name] = F.round(F.coalesce(F.col(name), dflt), 2)
        imputed.append(F.when(F.col(name).isNull(), F.lit(name)))
    tc = F.coalesce(F.col("total_customers").cast("double"), F.lit(100.0))
    imputed.append(F.when(F.col("total_customers").isNull(), F.lit("total_customers")))
    cols["total_customers"] = tc
    cols["customer_lifetime_value"] = F.when(tc > 0, F.round(F.col("total_revenue") / tc, 2)).otherwise(0.0)
    cols["roi"] = F.when(F.col("total_expenses") > 0,
                         F.round(F.col("total_profit") / F.col("total_expenses") * 100.0, 2)).otherwise(0.0)
    return k.select(*[F.col(b) for b in by],
                    *[cols[c].cast("double").alias(c) for c in DASHBOARD_COLUMNS],
                    F.filter(F.array(*imputed), lambda x: x.isNotNull()).alias("imputed"))


# ----------------------------------------------------------------------------
# H1-H4 health
# ----------------------------------------------------------------------------

def _piecewise_scores(margin: Column, growth: Column, ebitda: Column, current: Column,
                      churn: Column) -> dict[str, Column]:
    s_margin = (F.when(margin >= 30, 100.0).when(margin >= 0, 40.0 + margin / 30.0 * 60.0)
                .otherwise(F.greatest(F.lit(0.0), 40.0 + margin / 20.0 * 40.0)))
    s_growth = (F.when(growth >= 25, 100.0).when(growth >= 0, 50.0 + growth / 25.0 * 50.0)
                .otherwise(F.greatest(F.lit(0.0), 50.0 + growth / 15.0 * 50.0)))
    s_ebitda = (F.when(ebitda >= 25, 100.0).when(ebitda >= 0, 30.0 + ebitda / 25.0 * 70.0)
                .otherwise(F.greatest(F.lit(0.0), 30.0 + ebitda / 10.0 * 30.0)))
    s_current = (F.when(current >= 2, 100.0).when(current >= 1, 50.0 + (current - 1.0) * 50.0)
                 .otherwise(F.greatest(F.lit(0.0), current * 50.0)))
    s_churn = (F.when(churn <= 0, 100.0).when(churn <= 5, 100.0 - churn / 5.0 * 40.0)
               .when(churn <= 15, F.greatest(F.lit(0.0), 60.0 - (churn - 5.0) / 10.0 * 60.0))
               .otherwise(0.0))

    def keep(metric, score):
        return F.when(metric.isNotNull(), score)

    return {
        "profit_margin": keep(margin, s_margin),
        "revenue_growth": keep(growth, s_growth),
        "ebitda_margin": keep(ebitda, s_ebitda),
        "current_ratio": keep(current, s_current),
        "churn_rate": keep(churn, s_churn),
    }


def health_score(kpis: DataFrame, *, quality: Column | str | float = "data_quality_score",
                 by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """H1-H4: score, status, confidence and risk for every KPI row.

    Sub-scores are skipped when their metric is NULL and the weights are
    renormalised over those present (data quality is always present).
    """
    qcol = F.col(quality) if isinstance(quality, str) else (
        quality if isinstance(quality, Column) else F.lit(float(quality)))
    margin, growth = F.col("net_profit_margin"), F.col("revenue_growth")
    ebitda, current, churn = F.col("ebitda_margin"), F.col("current_ratio"), F.col("churn_rate")
    subs = _piecewise_scores(margin, growth, ebitda, current, churn)
    s_quality = F.least(F.greatest(qcol.cast("double"), F.lit(0.0)), F.lit(100.0))

    pairs = [F.struct(v.alias("s"), F.lit(HEALTH_WEIGHTS[k]).alias("w")) for k, v in subs.items()]
    pairs.append(F.struct(s_quality.alias("s"), F.lit(HEALTH_WEIGHTS["data_quality"]).alias("w")))
    arr = F.filter(F.array(*pairs), lambda p: p["s"].isNotNull())
    wsum = F.aggregate(arr, F.lit(0.0), lambda a, p: a + p["w"])
    comp = F.aggregate(arr, F.lit(0.0), lambda a, p: a + p["s"] * p["w"])
    composite = F.when(wsum > 0, comp / wsum).otherwise(50.0)
    final = F.round(F.least(F.greatest(composite, F.lit(0.0)), F.lit(100.0)), 1)

    out = kpis.withColumn("_final", final).withColumn("_squal", s_quality)
    core = F.filter(F.array(*[v for v in subs.values()]), lambda x: x.isNotNull())
    var = F.aggregate(core, F.lit(0.0), lambda a, s: a + (s - F.col("_final")) * (s - F.col("_final"))) / F.size(core)
    stability = F.when(F.size(core) > 0, F.greatest(F.lit(0.0), 100.0 - F.sqrt(var))).otherwise(50.0)
    conf = F.round(F.least(F.greatest(F.col("_squal") * 0.6 + stability * 0.4, F.lit(10.0)), F.lit(99.9)), 1)
    f = F.col("_final")
    status = (F.when(f >= 85, "Excellent").when(f >= 70, "Healthy").when(f >= 55, "Stable")
              .when(f >= 40, "At Risk").otherwise("Critical"))
    nz = lambda c, cond: c.isNotNull() & cond
    critical = (f < 40) | nz(current, current < 0.8) | nz(margin, margin < -15)
    high = (f < 55) | nz(current, current < 1.0) | nz(churn, churn > 12) | nz(margin, margin < 0)
    medium = (f < 75) | nz(churn, churn > 7) | nz(growth, growth < 0)
    risk = (F.when(critical, "Critical").when(high, "High").when(medium, "Medium").otherwise("Low"))
    return out.select(
        *[F.col(b) for b in by], *[F.col(c) for c in keep],
        F.col("_final").alias("health_score"),
        status.alias("status"),
        conf.alias("confidence_score"),
        risk.alias("risk_level"),
        F.round(F.col("_squal"), 1).alias("data_quality_score"),
    )


def with_empty_defaults(kpis: DataFrame, groups: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Every group of ``groups`` gets a KPI row; groups without data get the
    empty-input defaults (zero totals, margin and growth; other metrics NULL)."""
    zero = {"total_revenue", "total_expenses", "total_profit", "net_profit_margin", "revenue_growth"}
    j = groups.select(*[_c(b) for b in by]).distinct().join(kpis, list(by), "left")
    return j.select(*[_c(b) for b in by],
                    *[(F.coalesce(F.col(c), F.lit(0.0)) if c in zero else F.col(c)).alias(c) for c in KPI_COLUMNS],
                    F.col("total_revenue").isNull().alias("empty_input"))
