"""DuckDB SQL for the registered queries (the correctness oracle).

Every statement reads the same driver tables through the SQL text of the
views in ``bizlens.plans.views``; computed columns carry the same aliases
as the Spark side and floats are rounded the same way.
"""

from __future__ import annotations

from bizlens.plans.oracle_insight import insight_sql
from bizlens.plans.oracle_series import infer_sql, series_sql
from bizlens.plans.views import BALANCE_SQL, BV_SQL, FV_SQL

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------
# KPI building blocks (business view by region)
# ---------------------------------------------------------------------------

_ORDER = "date, region, segment, product, customer, revenue, expenses, quantity"
_ORDER_DESC = ", ".join(c + " DESC" for c in _ORDER.split(", "))


def _kpi_sql(view: str, finance: bool) -> str:
    extra_m = ""
    extra_g = ""
    if finance:
        extra_m = """, sum(marketing) AS mkt, sum(new_customers) AS newc,
            sum(churn) AS churn_s, count(churn) AS churn_n, sum(inventory) AS inv_s, count(inventory) AS inv_n"""
        extra_g = """, sum(mkt) AS mkt, sum(newc) AS newc, sum(churn_s) / sum(churn_n) AS churn_mean,
            sum(inv_s) / sum(inv_n) AS inv_mean"""
    last = ""
    if finance:
        last = f""",
    lastrow AS (SELECT region, cash AS last_cash, debt AS last_debt FROM (
        SELECT region, cash, debt, row_number() OVER (PARTITION BY region ORDER BY {_ORDER_DESC}) AS rn
        FROM {view} lv) WHERE rn = 1)"""
    return f"""WITH v AS {view},
    m AS (SELECT region, date_trunc('month', date) AS month, sum(revenue) AS rev, sum(expenses) AS exp,
            count(*) AS n, count(revenue) AS rev_n{extra_m}
          FROM v GROUP BY region, date_trunc('month', date)),
    g AS (SELECT region, coalesce(sum(rev), 0) AS rev, coalesce(sum(exp), 0) AS exp, sum(n) AS n,
            sum(rev_n) AS rev_n, count(month) AS n_months,
            arg_min(rev, month) AS first_m, arg_max(rev, month) AS last_m{extra_g}
          FROM m GROUP BY region){last}"""


_K_BASE = """round(rev, 2) AS total_revenue, round(exp, 2) AS total_expenses, round(rev - exp, 2) AS total_profit,
    CASE WHEN rev > 0 THEN round((rev - exp) / rev * 100.0, 2) ELSE 0.0 END AS net_profit_margin,
    CASE WHEN n <= 1 OR rev_n < 2 THEN 0.0
         WHEN n_months >= 2 AND first_m > 0 THEN round((last_m - first_m) / first_m * 100.0, 2)
         ELSE 0.0 END AS revenue_growth,
    CASE WHEN rev > 0 THEN round((rev - exp) / rev * 100.0, 2) END AS operating_margin,
    CASE WHEN rev > 0 THEN round(round((rev - exp) / rev * 100.0, 2) * 1.05, 2) END AS ebitda_margin"""

SQL["K1"] = _kpi_sql(FV_SQL, True) + f"""
SELECT g.region, {_K_BASE},
    CAST(NULL AS DOUBLE) AS gross_margin, CAST(NULL AS DOUBLE) AS customer_growth,
    round(least(greatest(CASE WHEN churn_mean > 0 AND churn_mean <= 1 THEN churn_mean * 100.0 ELSE churn_mean END, 0.0), 100.0), 2) AS churn_rate,
    round(mkt, 2) AS total_marketing_spend,
    CASE WHEN mkt > 0 THEN round(rev / mkt, 2) END AS marketing_roi,
    CASE WHEN mkt > 0 AND newc > 0 THEN round(mkt / newc, 2) END AS cac,
    round(last_cash, 2) AS cash_balance,
    CASE WHEN last_debt + last_cash > 0 THEN round(last_debt / (last_cash + last_debt), 2) END AS debt_ratio,
    CASE WHEN n > 0 AND exp / (n / 30.0) > 0 THEN round(last_cash / (exp / (n / 30.0)), 2) END AS current_ratio,
    CASE WHEN inv_mean > 0 THEN round(exp / inv_mean, 2) END AS inventory_turnover
FROM g JOIN lastrow USING (region)"""

# Health: quality score of the business view (no NULLs, no duplicates,
# one of four domains mapped) and the piecewise sub-scores.
_HEALTH_CORE = """
    q AS (SELECT region, round((100.0 - 100.0 * nulls / (rows * 7)) * 0.35 + (100.0 - 100.0 * nulls / (rows * 7)) * 0.35
                 + greatest(0.0, 100.0 - dups / rows * 100.0) * 0.15 + 25.0 * 0.15, 1) AS dq
          FROM (SELECT region, sum(cnt) AS rows, sum(cnt) - count(*) AS dups, 0 AS nulls
                FROM (SELECT date, region, segment, product, customer, revenue, expenses, quantity, count(*) AS cnt
                      FROM v GROUP BY ALL) dd GROUP BY region) qq),
    k AS (SELECT g.region, {base} FROM g),
    s AS (SELECT k.*, q.dq,
        CASE WHEN net_profit_margin >= 30 THEN 100.0 WHEN net_profit_margin >= 0 THEN 40.0 + net_profit_margin / 30.0 * 60.0
             ELSE greatest(0.0, 40.0 + net_profit_margin / 20.0 * 40.0) END AS s_m,
        CASE WHEN revenue_growth >= 25 THEN 100.0 WHEN revenue_growth >= 0 THEN 50.0 + revenue_growth / 25.0 * 50.0
             ELSE greatest(0.0, 50.0 + revenue_growth / 15.0 * 50.0) END AS s_g,
        CASE WHEN ebitda_margin IS NULL THEN NULL WHEN ebitda_margin >= 25 THEN 100.0
             WHEN ebitda_margin >= 0 THEN 30.0 + ebitda_margin / 25.0 * 70.0
             ELSE greatest(0.0, 30.0 + ebitda_margin / 10.0 * 30.0) END AS s_e
        FROM k JOIN q USING (region)),
    f AS (SELECT s.*, round(least(greatest(
              (s_m * 0.25 + s_g * 0.20 + coalesce(s_e * 0.15, 0) + least(greatest(dq, 0), 100) * 0.10)
              / (0.25 + 0.20 + CASE WHEN s_e IS NULL THEN 0 ELSE 0.15 END + 0.10), 0), 100), 1) AS hs FROM s)"""

SQL["H1"] = _kpi_sql(BV_SQL, False) + "," + _HEALTH_CORE.format(base=_K_BASE) + """
SELECT region, round(rev, 2) AS total_revenue, round(rev - exp, 2) AS total_profit, net_profit_margin, revenue_growth,
    hs AS health_score,
    CASE WHEN hs >= 85 THEN 'Excellent' WHEN hs >= 70 THEN 'Healthy' WHEN hs >= 55 THEN 'Stable'
         WHEN hs >= 40 THEN 'At Risk' ELSE 'Critical' END AS status,
    round(least(greatest(least(greatest(dq, 0), 100) * 0.6 + 0.4 * greatest(0.0, 100.0 - sqrt(
        ((s_m - hs) ^ 2 + (s_g - hs) ^ 2 + coalesce((s_e - hs) ^ 2, 0)) / (2 + CASE WHEN s_e IS NULL THEN 0 ELSE 1 END))),
        10.0), 99.9), 1) AS confidence_score,
    CASE WHEN hs < 40 OR net_profit_margin < -15 THEN 'Critical'
         WHEN hs < 55 OR net_profit_margin < 0 THEN 'High'
         WHEN hs < 75 OR revenue_growth < 0 THEN 'Medium' ELSE 'Low' END AS risk_level,
    round(least(greatest(dq, 0), 100), 1) AS data_quality_score
FROM f JOIN g USING (region)"""


# ---------------------------------------------------------------------------
# Schema and type inference (C)
# ---------------------------------------------------------------------------

from bizlens.plans.views import DUPS_SQL, EXTREME_SQL, HOLES_SQL, TEXT_SQL  # noqa: E402

_TEXT_COLS = ["date_txt", "iso_txt", "region", "revenue_txt", "quantity_txt", "rate_txt"]
_PATTERNS = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$"]
_STRICT = ["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y"]
_STRICT_SPARK = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]
_CHART = ["%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%Y-%m", "%b-%Y", "%B-%Y"]
_CHART_SPARK = ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM", "MMM-yyyy",
                "MMMM-yyyy"]


def _stats_sql(c: str) -> str:
    pat = " OR ".join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '{p}'), false)" for p in _PATTERNS)
    fmts = ", ".join(f"count(try_strptime(CAST({c} AS VARCHAR), '{f}')) AS \"{f}\"" for f in sorted(set(_STRICT + _CHART)))
    return (f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, "
            f"count(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)) AS numeric, "
            f"sum(CASE WHEN {pat} THEN 1 ELSE 0 END) AS pattern, {fmts} FROM t")


_STATS = "WITH t AS " + TEXT_SQL + ", s AS (" + " UNION ALL ".join(_stats_sql(c) for c in _TEXT_COLS) + ")\n"

SQL["C4"] = _STATS + """SELECT "column", round(numeric / rows, 4) AS valid_ratio, numeric / rows >= 0.7 AS converted FROM s"""

_gate = "(non_null > 0 AND pattern / greatest(non_null, 1) >= 0.6)"
_c5_choice = "CASE WHEN \"%Y-%m-%d\" / greatest(rows, 1) >= 0.7 THEN 'yyyy-MM-dd' " + " ".join(
    f"WHEN {_gate} AND \"{f}\" / greatest(rows, 1) >= 0.7 THEN '{sf}'" for f, sf in zip(_STRICT, _STRICT_SPARK)) + " END"
_c5_ratio = "CASE WHEN \"%Y-%m-%d\" / greatest(rows, 1) >= 0.7 THEN \"%Y-%m-%d\" / greatest(rows, 1) " + " ".join(
    f"WHEN {_gate} AND \"{f}\" / greatest(rows, 1) >= 0.7 THEN \"{f}\" / greatest(rows, 1)" for f in _STRICT) + " END"
SQL["C5"] = _STATS + f'SELECT "column", {_c5_choice} AS format, round({_c5_ratio}, 4) AS valid_ratio FROM s'

SQL["C6"] = _STATS + """SELECT "column", (non_null > 0 AND CASE WHEN non_null > 0 THEN pattern / non_null ELSE 0 END >= 0.6
    AND "%Y-%m-%d" / greatest(rows, 1) >= 0.6) AS is_datetime FROM s"""

SQL["C7"] = _STATS + 'SELECT "column", CASE '  + " ".join(
    f"WHEN \"{f}\" >= greatest(3.0, rows * 0.5) THEN '{sf}'" for f, sf in zip(_CHART, _CHART_SPARK)) + " END AS format FROM s"

SQL["C9"] = f"""WITH v AS {BV_SQL}, n AS (SELECT count(*) AS rows, count(DISTINCT region) AS dr, count(DISTINCT segment) AS ds,
    count(DISTINCT product) AS dp FROM v)
SELECT 'date' AS "column", 'datetime' AS kind, CAST(NULL AS DOUBLE) AS unique_ratio FROM n
UNION ALL SELECT 'region', CASE WHEN dr / rows > 0.7 THEN 'other' ELSE 'categorical' END, round(dr / rows, 4) FROM n
UNION ALL SELECT 'segment', CASE WHEN ds / rows > 0.7 THEN 'other' ELSE 'categorical' END, round(ds / rows, 4) FROM n
UNION ALL SELECT 'product', CASE WHEN dp / rows > 0.7 THEN 'other' ELSE 'categorical' END, round(dp / rows, 4) FROM n
UNION ALL SELECT 'customer', 'numeric', NULL FROM n UNION ALL SELECT 'revenue', 'numeric', NULL FROM n
UNION ALL SELECT 'expenses', 'numeric', NULL FROM n UNION ALL SELECT 'quantity', 'numeric', NULL FROM n"""


def _acct(c: str) -> str:
    v = f"TRY_CAST(regexp_replace(trim({c}), '[\\$,%\\(\\)\\s]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN regexp_matches(trim({c}), '^\\(.*\\)$') THEN -{v} ELSE {v} END"


SQL["C11"] = f"""SELECT customer, product, iso_txt, revenue_txt, round({_acct('revenue_txt')}, 2) AS revenue,
    {_acct('rate_txt')} AS rate FROM {TEXT_SQL} t"""

# ---------------------------------------------------------------------------
# Cleaning (D)
# ---------------------------------------------------------------------------

_H8 = "date, region, segment, product, customer, revenue, expenses, quantity"

SQL["D1"] = f"SELECT DISTINCT * FROM {DUPS_SQL} d"
SQL["D2"] = f"SELECT {_H8} FROM {HOLES_SQL} h"
SQL["D3"] = f"""SELECT customer, product, revenue, expenses, quantity FROM {HOLES_SQL} h
    WHERE NOT (revenue IS NULL AND expenses IS NULL AND quantity IS NULL)"""
SQL["D4"] = f"SELECT {_H8} FROM {HOLES_SQL} h WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _H8.split(", "))
SQL["D5"] = f"""WITH h AS {HOLES_SQL}, m AS (SELECT region, median(revenue) AS mr, median(expenses) AS me,
    median(quantity) AS mq FROM h GROUP BY region)
SELECT date, region, segment, product, customer, round(coalesce(revenue, mr), 6) AS revenue,
    round(coalesce(expenses, me), 6) AS expenses, round(coalesce(quantity, mq), 6) AS quantity
FROM h LEFT JOIN m USING (region)"""
SQL["D6"] = f"""WITH h AS {HOLES_SQL}, c AS (SELECT region, segment, count(*) AS n FROM h WHERE segment IS NOT NULL GROUP BY ALL),
    m AS (SELECT region, segment AS ms FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, segment) = 1)
SELECT date, region, coalesce(segment, ms, 'unknown') AS segment, product, customer, revenue, expenses, quantity
FROM h LEFT JOIN m USING (region)"""
SQL["D7"] = f"""WITH h AS {HOLES_SQL}, m AS (SELECT region, min(date) AS md FROM h GROUP BY region)
SELECT coalesce(date, md) AS date, region, segment, product, customer, revenue, expenses, quantity
FROM h LEFT JOIN m USING (region)"""
SQL["D8"] = f"""SELECT region, CAST(sum(CASE WHEN isinf(revenue) THEN 1 ELSE 0 END) AS BIGINT) AS infinite_values,
    CAST(sum(CASE WHEN revenue IS NULL OR isinf(revenue) THEN 1 ELSE 0 END) AS BIGINT) AS null_after,
    CAST(sum(CASE WHEN isnan(revenue) THEN 1 ELSE 0 END) AS BIGINT) AS nan_after
FROM {EXTREME_SQL} e GROUP BY region"""

_D9_ORDER = ", ".join(f"{c} NULLS FIRST" for c in _H8.split(", "))


def _interp(c: str) -> str:
    back = f"OVER (PARTITION BY product ORDER BY {_D9_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fwd = f"OVER (PARTITION BY product ORDER BY {_D9_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""last_value({c} IGNORE NULLS) {back} AS {c}_pv,
        last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {back} AS {c}_pr,
        first_value({c} IGNORE NULLS) {fwd} AS {c}_nv,
        first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {fwd} AS {c}_nr"""


def _interp_out(c: str) -> str:
    lin = f"CASE WHEN {c}_nr = {c}_pr THEN {c}_pv ELSE {c}_pv + ({c}_nv - {c}_pv) * (rn - {c}_pr) / ({c}_nr - {c}_pr) END"
    return (f"round(CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pv IS NOT NULL AND {c}_nv IS NOT NULL THEN {lin} "
            f"ELSE coalesce({c}_pv, {c}_nv) END, 6) AS {c}")


SQL["D9"] = f"""WITH h AS (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY {_D9_ORDER}) AS DOUBLE) AS rn
    FROM {HOLES_SQL} h0),
    w AS (SELECT *, {_interp('revenue')}, {_interp('expenses')}, {_interp('quantity')} FROM h)
SELECT date, region, segment, product, customer, {_interp_out('revenue')}, {_interp_out('expenses')},
    {_interp_out('quantity')} FROM w"""

SQL["D10"] = "SELECT doc_id, lower(trim(text)) AS text, lower(trim(lang)) AS lang, lower(trim(source)) AS source FROM documents"
SQL["D11"] = f"""SELECT region, date, round(sum(revenue), 4) AS revenue, round(sum(expenses), 4) AS expenses,
    round(sum(quantity), 4) AS quantity, min(product) AS product FROM {BV_SQL} v GROUP BY region, date"""
SQL["D12"] = f"""SELECT * FROM (SELECT try_strptime(date_txt, '%Y-%m-%d') AS date_txt, customer, product,
    TRY_CAST(quantity_txt AS DOUBLE) AS quantity_txt FROM {TEXT_SQL} t) x
    WHERE date_txt IS NOT NULL AND quantity_txt IS NOT NULL"""

_D14_COLS = ["date", "segment", "product", "customer", "revenue", "expenses", "quantity", "empty"]
_D14_ALLNULL = " AND ".join(f"{c} IS NULL" for c in _D14_COLS)
SQL["D14"] = f"""WITH h AS {HOLES_SQL},
    c AS (SELECT *, count(*) AS _n FROM h GROUP BY ALL),
    g AS (SELECT region, sum(_n) AS initial_rows, sum(_n) - count(*) AS duplicates_removed,
        sum(CASE WHEN {_D14_ALLNULL} THEN 1 ELSE 0 END) AS empty_rows_removed,
        {", ".join(f"sum(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS nn_{c}, sum(CASE WHEN {c} IS NULL AND NOT ({_D14_ALLNULL}) THEN 1 ELSE 0 END) AS nl_{c}" for c in _D14_COLS)}
        FROM c GROUP BY region),
    s AS (SELECT *, {" + ".join(f"CASE WHEN nn_{c} = 0 THEN 1 ELSE 0 END" for c in _D14_COLS)} AS empty_cols,
        {" + ".join(f"CASE WHEN nn_{c} > 0 THEN nl_{c} ELSE 0 END" for c in _D14_COLS)} AS before,
        CASE WHEN nn_date > 0 THEN nl_date ELSE 0 END AS after,
        initial_rows - duplicates_removed - empty_rows_removed AS rows_after FROM g),
    z AS (SELECT *, least(greatest(round(1.0 - CASE WHEN rows_after * ({len(_D14_COLS)} - empty_cols) > 0
        THEN after / (rows_after * ({len(_D14_COLS)} - empty_cols)) ELSE 0 END
        - least(0.05, duplicates_removed / greatest(initial_rows, 1)), 2), 0.0), 1.0) AS quality_score FROM s)
SELECT region, initial_rows, duplicates_removed, empty_rows_removed, CAST(empty_cols AS BIGINT) AS empty_columns_removed,
    CAST(before AS BIGINT) AS missing_values_before, CAST(before - after AS BIGINT) AS missing_values_imputed,
    CAST(after AS BIGINT) AS missing_values_remaining, CAST(0 AS BIGINT) AS infinite_values_replaced,
    quality_score, quality_score >= 0.70 AS is_clean FROM z"""

# ---------------------------------------------------------------------------
# Profiling (P)
# ---------------------------------------------------------------------------

_HCOLS = {"date": "timestamp_ntz", "segment": "string", "product": "string", "customer": "bigint",
          "revenue": "double", "expenses": "double", "quantity": "double", "empty": "double"}
_NULLSUM = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _HCOLS)

SQL["P1"] = f"""SELECT region, count(*) AS rows, CAST(8 AS BIGINT) AS columns, count(*) * 8 AS total_cells,
    CAST(sum(nulls) AS BIGINT) AS total_missing_values, round(sum(nulls) / (count(*) * 8) * 100.0, 2) AS overall_missing_percentage,
    round((sum(bytes) + 57.0 * count(*)) / (1024 * 1024), 4) AS memory_mb
FROM (SELECT region, {_NULLSUM} AS nulls, coalesce(strlen(segment), 0) + coalesce(strlen(product), 0) AS bytes FROM {HOLES_SQL} h) x GROUP BY region"""

SQL["P2"] = f"WITH h AS {HOLES_SQL}\n" + "\nUNION ALL ".join(
    f"""SELECT region, '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count,
    round((count(*) - count({c})) / count(*) * 100.0, 4) AS null_percentage, count(DISTINCT {c}) AS unique_values,
    {str(t in ('bigint', 'double')).lower()} AS is_numeric, false AS is_boolean, {str(t == 'timestamp_ntz').lower()} AS is_datetime
    FROM h GROUP BY region""" for c, t in _HCOLS.items())


def _num_long(view: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT region, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {view} v{i}"
                              for i, c in enumerate(cols))


_P3 = ["customer", "revenue", "expenses", "quantity", "empty"]
SQL["P3"] = f"""SELECT region, "column", count(x) AS count, round(avg(x), 4) AS mean,
    round(CASE WHEN count(x) > 1 THEN stddev_samp(x) WHEN count(x) = 1 THEN 0.0 END, 4) AS std,
    round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS median,
    round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS max,
    round(CASE WHEN count(x) > 2 THEN coalesce(skewness(x), 0.0) WHEN count(x) > 0 THEN 0.0 END, 4) AS skewness
FROM ({_num_long(HOLES_SQL, _P3)}) l GROUP BY region, "column" HAVING count(x) > 0"""

SQL["P4"] = f"""SELECT region, 'date' AS "column", min(date) AS min_date, max(date) AS max_date
FROM {HOLES_SQL} h GROUP BY region"""

_P5 = ["customer", "revenue", "expenses", "quantity"]
SQL["P5"] = f"""SELECT region, "column", CAST(count(x) AS DOUBLE) AS count, round(coalesce(avg(x), 0), 4) AS mean,
    round(coalesce(stddev_samp(x), 0), 4) AS std, round(coalesce(min(x), 0), 4) AS min,
    round(coalesce(quantile_cont(x, 0.25), 0), 4) AS p25, round(coalesce(quantile_cont(x, 0.5), 0), 4) AS p50,
    round(coalesce(quantile_cont(x, 0.75), 0), 4) AS p75, round(coalesce(max(x), 0), 4) AS max
FROM ({_num_long(BV_SQL, _P5)}) l GROUP BY region, "column\""""

SQL["P6"] = f"""SELECT region, "column", round(avg(x), 4) AS mean, round(median(x), 4) AS median,
    round(stddev_samp(x), 4) AS std, round(skewness(x), 4) AS skewness, round(min(x), 4) AS min, round(max(x), 4) AS max
FROM ({_num_long(BV_SQL, _P5)}) l GROUP BY region, "column" HAVING count(x) > 3"""

SQL["P7"] = f"""WITH v AS {BV_SQL},
    l AS (SELECT region, 'segment' AS "column", segment AS value FROM v UNION ALL
          SELECT region, 'product', product FROM v),
    c AS (SELECT region, "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT region, "column", value, count, CAST(row_number() OVER (PARTITION BY region, "column" ORDER BY count DESC, value) AS INTEGER) AS rank
FROM c QUALIFY rank <= 10"""

SQL["P8"] = f"WITH h AS {HOLES_SQL}\n" + "\nUNION ALL ".join(
    f"SELECT region, '{c}' AS \"column\", count(*) - count({c}) AS missing FROM h GROUP BY region" for c in _HCOLS)

SQL["P9"] = f"""SELECT region, sum(n) AS rows, sum(n) - count(*) AS duplicate_rows
FROM (SELECT *, count(*) AS n FROM {DUPS_SQL} d GROUP BY ALL) x GROUP BY region"""

SQL["P10"] = f"""WITH c AS (SELECT *, count(*) AS n FROM {HOLES_SQL} h GROUP BY ALL),
    g AS (SELECT region, sum(n) AS rows, sum(n) - count(*) AS duplicate_rows,
        sum(({_NULLSUM}) * n) AS null_cells FROM c GROUP BY region),
    s AS (SELECT *, (rows * 8 - null_cells) / (rows * 8) * 100.0 AS comp,
        greatest(0.0, 100.0 - duplicate_rows / rows * 100.0) AS uniq FROM g)
SELECT region, rows, CAST(8 AS BIGINT) AS columns, CAST(null_cells AS BIGINT) AS null_cells, duplicate_rows,
    round(comp, 1) AS completeness_pct, 25.0 AS canonical_coverage_pct,
    round(comp * 0.35 + comp * 0.35 + uniq * 0.15 + 25.0 * 0.15, 1) AS data_quality_score FROM s"""

SQL["P12"] = f"""SELECT region, "column", round(avg(x), 2) AS mean, round(coalesce(stddev_samp(x), 0), 2) AS std,
    round(min(x), 2) AS min, round(max(x), 2) AS max, round(median(x), 2) AS median
FROM ({_num_long(HOLES_SQL, _P3)}) l GROUP BY region, "column" HAVING count(x) > 0"""

# ---------------------------------------------------------------------------
# Correlation, drivers, trends (R, T)
# ---------------------------------------------------------------------------

_RC = ["quantity", "revenue", "expenses"]
_PAIRS = [(i, j) for i in range(3) for j in range(i + 1, 3)]
_NS = {"quantity": 0, "revenue": 100, "expenses": 0, "customer": 0}

SQL["R1"] = f"WITH v AS {BV_SQL}\n" + "\nUNION ALL ".join(
    [f"SELECT region, '{_RC[i]}' AS row, '{_RC[j]}' AS col, round(coalesce(corr({_RC[i]}, {_RC[j]}), 0), 4) AS r FROM v GROUP BY region"
     for i, j in _PAIRS]
    + [f"SELECT region, '{_RC[j]}', '{_RC[i]}', round(coalesce(corr({_RC[i]}, {_RC[j]}), 0), 4) FROM v GROUP BY region"
       for i, j in _PAIRS]
    + [f"SELECT region, '{c}', '{c}', 1.0 FROM v GROUP BY region" for c in _RC])

SQL["R2"] = f"""WITH v AS {BV_SQL}, p AS (""" + " UNION ALL ".join(
    f"SELECT region, '{_RC[i]}' AS f1, '{_RC[j]}' AS f2, {k} AS ord, corr({_RC[i]}, {_RC[j]}) AS r, "
    f"{_NS[_RC[i]] + _NS[_RC[j]]} AS ns FROM v GROUP BY region" for k, (i, j) in enumerate(_PAIRS)) + """),
    s AS (SELECT *, round(abs(r) * 1000 + ns, 2) AS bs FROM p WHERE r IS NOT NULL AND NOT isnan(r))
SELECT region, f1 AS feature_1, f2 AS feature_2, CAST(ord AS INTEGER) AS ordinal, round(r, 4) AS r,
    round(abs(r), 4) AS correlation,
    CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
    bs AS business_score, CAST(row_number() OVER (PARTITION BY region ORDER BY bs DESC, ord) AS INTEGER) AS rank
FROM s QUALIFY rank <= 10"""

_R3_OTHERS = ["quantity", "expenses", "customer"]
_R3_LONG = f"WITH v AS {BV_SQL}, l AS (" + " UNION ALL ".join(
    f"SELECT region, '{c}' AS feature, {k} AS ord, corr({c}, revenue) AS r, stddev_samp({c}) AS sd, count(*) AS n "
    f"FROM v GROUP BY region" for k, c in enumerate(_R3_OTHERS)) + ")\n"

SQL["R3"] = _R3_LONG + """SELECT region, feature, CAST(ord AS INTEGER) AS ordinal, round(abs(r), 4) AS importance,
    CAST(row_number() OVER (PARTITION BY region ORDER BY round(abs(r), 4) DESC, ord) AS INTEGER) AS rank
FROM l WHERE r IS NOT NULL AND NOT isnan(r)"""

SQL["R4"] = _R3_LONG + """, c AS (SELECT region, feature, ord, n, coalesce(round(r, 3), 0.0) AS c FROM l WHERE sd > 0),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY abs(c) DESC, ord) AS INTEGER) AS rank FROM c)
SELECT region, feature AS driver, rank, round(c, 2) AS correlation,
    CASE WHEN c > 0.7 THEN 'Strong Positive' WHEN c > 0.3 THEN 'Moderate Positive' WHEN c < -0.7 THEN 'Strong Negative'
         WHEN c < -0.3 THEN 'Moderate Negative' ELSE 'Weak/Neutral' END AS relationship_strength,
    round(least(100.0, greatest(0.0, c * c * 100.0)), 1) AS impact_score,
    round(least(99.0, greatest(20.0, abs(c) * 70.0 + least(30.0, n * 0.5))), 1) AS confidence
FROM k WHERE rank <= 5"""

_R6 = ["customer", "revenue", "expenses", "quantity"]
SQL["R6"] = f"WITH v AS {BV_SQL}, l AS (" + " UNION ALL ".join(
    f"SELECT region, '{c}' AS col, {_NS[c]} AS s, coalesce(abs(avg({c})), -1.0) AS a, {-k} AS o FROM v GROUP BY region"
    for k, c in enumerate(_R6)) + ")\nSELECT region, arg_max(col, (s, a, o)) AS recommended_kpi FROM l GROUP BY region"

SQL["R7"] = f"""SELECT region, regr_count(revenue, quantity) AS points, round(regr_slope(revenue, quantity), 4) AS slope,
    round(regr_intercept(revenue, quantity), 4) AS intercept, round(regr_r2(revenue, quantity), 4) AS r2
FROM {BV_SQL} v GROUP BY region"""

SQL["T1"] = f"""WITH v AS {BV_SQL}, l AS (""" + " UNION ALL ".join(
    f"SELECT region, '{c}' AS \"column\", date, segment, product, customer, {c} AS value FROM v" for c in _RC) + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY region, "column" ORDER BY date, segment, product, customer, value) AS rn
          FROM l WHERE date IS NOT NULL AND value IS NOT NULL),
    g AS (SELECT region, "column", count(*) AS points, coalesce(regr_slope(value, rn), 0.0) AS s FROM r GROUP BY ALL)
SELECT region, "column", CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS trend,
    round(s, 6) AS slope, points FROM g WHERE points >= 6"""

SQL["T3"] = f"""SELECT segment, round(avg(revenue), 4) AS mean_value FROM {BV_SQL} v GROUP BY segment
ORDER BY avg(revenue) DESC, segment LIMIT 10"""

SQL["T4"] = f"""SELECT region, date AS ts, round(avg(revenue), 4) AS mean_value FROM {BV_SQL} v
WHERE date IS NOT NULL GROUP BY region, date"""

SQL["T5"] = f"""WITH v AS {BV_SQL},
    s AS (SELECT region, CAST(date_trunc('month', date) AS DATE) AS month, sum(quantity) AS quantity,
          sum(revenue) AS revenue, sum(expenses) AS expenses FROM v WHERE date IS NOT NULL GROUP BY ALL),
    cal AS (SELECT region, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
            FROM s GROUP BY region)
SELECT region, month, round(coalesce(quantity, 0), 2) AS quantity, round(coalesce(revenue, 0), 2) AS revenue,
    round(coalesce(expenses, 0), 2) AS expenses FROM cal LEFT JOIN s USING (region, month)"""

SQL["T6"] = f"""SELECT region, product AS key, round(sum(revenue), 2) AS total,
    CAST(row_number() OVER (PARTITION BY region ORDER BY sum(revenue) DESC, product) AS INTEGER) AS rank
FROM {BV_SQL} v GROUP BY region, product QUALIFY rank <= 5"""

# ---------------------------------------------------------------------------
# Features (F)
# ---------------------------------------------------------------------------

SQL["F1"] = f"""SELECT customer, product, date, revenue, expenses,
    round(coalesce(revenue, 0) - coalesce(expenses, 0), 6) AS profit FROM {HOLES_SQL} h"""
SQL["F2"] = f"""SELECT customer, product, date, revenue,
    round(CASE WHEN revenue > 0 THEN (revenue - expenses) / revenue * 100.0 ELSE 0.0 END, 6) AS profit_margin_pct
FROM {BV_SQL} v"""
SQL["F3"] = f"""SELECT customer, product, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
    CAST(date_trunc('month', date) AS DATE) AS year_month FROM {BV_SQL} v"""
SQL["F4"] = f"""SELECT region, customer, product, date, revenue, revenue_lag1,
    round(CASE WHEN revenue_lag1 > 0 THEN (revenue - revenue_lag1) / revenue_lag1 * 100.0 ELSE 0.0 END, 6) AS revenue_growth_pct
FROM (SELECT *, lag(revenue) OVER (PARTITION BY region ORDER BY {_ORDER}) AS revenue_lag1 FROM {BV_SQL} v) x"""

# ---------------------------------------------------------------------------
# KPI variants, dashboard, anomalies (K, A)
# ---------------------------------------------------------------------------

_OKEY = "(date, region, segment, product, customer, revenue, expenses, quantity)"

SQL["K5"] = f"""WITH v AS {BV_SQL},
    m AS (SELECT product, date_trunc('month', date) AS month, sum(revenue) AS rev, count(*) AS n, count(revenue) AS rev_n
          FROM v GROUP BY ALL),
    g AS (SELECT product, coalesce(sum(rev), 0) AS rev, sum(n) AS n, sum(rev_n) AS rev_n, count(month) AS n_months,
          arg_min(rev, month) AS first_m, arg_max(rev, month) AS last_m FROM m GROUP BY product)
SELECT product, round(rev, 2) AS total_revenue,
    CASE WHEN n <= 1 OR rev_n < 2 THEN 0.0 WHEN n_months >= 2 AND first_m > 0
         THEN round((last_m - first_m) / first_m * 100.0, 2) ELSE 0.0 END AS revenue_growth FROM g"""

SQL["K6"] = f"""WITH v AS {BV_SQL},
    g AS (SELECT segment, count(*) AS n, count(quantity) AS ac_n, arg_min(quantity, {_OKEY}) AS f,
          arg_max(quantity, {_OKEY}) AS l FROM v GROUP BY segment)
SELECT segment, CASE WHEN n > 1 AND ac_n >= 2 AND f > 0 THEN round((l - f) / f * 100.0, 2) ELSE 0.0 END AS customer_growth
FROM g"""

SQL["K15"] = f"""WITH k AS ({SQL["K1"]}),
    c AS (SELECT region, count(DISTINCT customer) AS tc FROM {FV_SQL} f GROUP BY region)
SELECT region, total_revenue, total_expenses, total_profit AS net_profit, net_profit_margin,
    round(coalesce(gross_margin, least(greatest(net_profit_margin + 25.0, 0.0), 85.0)), 2) AS gross_margin,
    round(coalesce(ebitda_margin, net_profit_margin * 1.15), 2) AS ebitda_margin,
    round(coalesce(operating_margin, net_profit_margin * 1.05), 2) AS operating_margin,
    revenue_growth, CAST(tc AS DOUBLE) AS total_customers,
    round(coalesce(customer_growth, least(greatest(revenue_growth * 0.65, -50.0), 100.0)), 2) AS customer_growth,
    round(coalesce(churn_rate, greatest(0.5, 5.0 - revenue_growth * 0.1)), 2) AS churn_rate,
    CASE WHEN tc > 0 THEN round(total_revenue / tc, 2) ELSE 0.0 END AS customer_lifetime_value,
    CASE WHEN total_expenses > 0 THEN round(total_profit / total_expenses * 100.0, 2) ELSE 0.0 END AS roi,
    round(coalesce(current_ratio, 1.5), 2) AS current_ratio, round(coalesce(debt_ratio, 0.2), 2) AS debt_ratio,
    round(coalesce(inventory_turnover, 5.0), 2) AS inventory_turnover,
    list_filter([CASE WHEN gross_margin IS NULL THEN 'gross_margin' END,
                 CASE WHEN ebitda_margin IS NULL THEN 'ebitda_margin' END,
                 CASE WHEN operating_margin IS NULL THEN 'operating_margin' END,
                 CASE WHEN customer_growth IS NULL THEN 'customer_growth' END,
                 CASE WHEN churn_rate IS NULL THEN 'churn_rate' END,
                 CASE WHEN current_ratio IS NULL THEN 'current_ratio' END,
                 CASE WHEN debt_ratio IS NULL THEN 'debt_ratio' END,
                 CASE WHEN inventory_turnover IS NULL THEN 'inventory_turnover' END], lambda x: x IS NOT NULL) AS imputed
FROM k JOIN c USING (region)"""

SQL["K1_rollup"] = f"""SELECT region, segment, count(*) AS rows, round(sum(revenue), 2) AS total_revenue,
    round(sum(expenses), 2) AS total_expenses, round(sum(revenue) - sum(expenses), 2) AS total_profit,
    CASE WHEN sum(revenue) > 0 THEN round((sum(revenue) - sum(expenses)) / sum(revenue) * 100.0, 2) ELSE 0.0 END
        AS net_profit_margin
FROM {BV_SQL} v GROUP BY ROLLUP (region, segment)"""

_DAILY = f"(SELECT region, date, sum(revenue) AS revenue, sum(expenses) AS expenses FROM {BV_SQL} v GROUP BY region, date)"


def _z_sql(col: str, label: str, lower: bool) -> str:
    z = f"(({col} - mu) / sd)"
    cond = f"{z} < -2.0" if lower else f"{z} > 2.0"
    crit = f"abs({z}) > 3.0" + (f" OR {col} < mu * 0.5" if lower else "")
    return f"""SELECT region, date, 'statistical_outlier' AS type,
        CASE WHEN {crit} THEN 'Critical' WHEN abs({z}) > 2.5 THEN 'High' WHEN abs({z}) > 2.0 THEN 'Medium' ELSE 'Low' END AS severity,
        '{label}' AS metric, round({col}, 2) AS value, round(mu, 2) AS historical_average, round({z}, 4) AS z_score
    FROM d JOIN (SELECT region, avg({col}) AS mu, stddev_samp({col}) AS sd, count({col}) AS n FROM d GROUP BY region) s
    USING (region) WHERE n >= 3 AND sd > 0 AND {col} IS NOT NULL AND {cond}"""


SQL["A1"] = f"WITH d AS {_DAILY}\n" + _z_sql("revenue", "Revenue Dropped Significantly", True) + \
    "\nUNION ALL " + _z_sql("expenses", "Expense Spike Detected", False)

SQL["A4"] = f"""WITH k AS ({SQL["K1"]})
SELECT region, 'liquidity_risk' AS type, 'Critical' AS severity, 'Current Ratio' AS metric, current_ratio AS value
FROM k WHERE current_ratio < 1.0
UNION ALL SELECT region, 'retention_risk', 'High', 'Customer Churn', churn_rate FROM k WHERE churn_rate > 10.0"""

SQL["A5"] = f"""WITH k AS ({SQL["K1"]}),
    l AS (SELECT region, list_filter([CASE WHEN revenue_growth > 5.0 THEN 'scale_acquisition' END,
        CASE WHEN total_revenue > 0 AND total_expenses / total_revenue > 0.70 THEN 'restructure_costs'
             WHEN total_revenue > 0 THEN 'reinvest_margin' END, 'optimize_cac'], lambda x: x IS NOT NULL) AS ops FROM k)
SELECT region, CAST(unnest(range(0, len(ops))) AS INTEGER) AS ordinal, unnest(ops) AS opportunity FROM l"""

# ---------------------------------------------------------------------------
# Series and forecasting (V, M)
# ---------------------------------------------------------------------------

_MS = f"""(SELECT region, CAST(month AS TIMESTAMP) AS ts, round(revenue, 2) AS y FROM ({SQL["T5"]}) t5)"""
_MS_RAW = f"""(WITH v AS {BV_SQL},
    s AS (SELECT region, CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS revenue,
          sum(expenses) AS expenses FROM v WHERE date IS NOT NULL GROUP BY ALL),
    cal AS (SELECT region, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
            FROM s GROUP BY region)
SELECT region, month, coalesce(revenue, 0) AS revenue, coalesce(expenses, 0) AS expenses
FROM cal LEFT JOIN s USING (region, month))"""
_MS = f"(SELECT region, CAST(month AS TIMESTAMP) AS ts, round(revenue, 2) AS y FROM {_MS_RAW} m0)"
_X = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS BIGINT) AS t,
    count(*) OVER (PARTITION BY region) AS n FROM {_MS} s0)"""

SQL["V2"] = f"""SELECT region, median_gap_days, inferred, coalesce(inferred, 'D') AS freq
FROM {infer_sql(f"(SELECT region, date_trunc('month', date) AS ts FROM {BV_SQL} v WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY ALL)", "region")} i"""

SQL["V3"] = f"""SELECT region, ts, round(y, 6) AS y, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(quarter(ts) AS INTEGER) AS quarter,
    CAST(last_day(CAST(ts AS DATE)) = CAST(ts AS DATE) AS INTEGER) AS is_month_end,
    round(sin(2 * pi() * month(ts) / 12.0), 6) + 0.0 AS sin_month, round(cos(2 * pi() * month(ts) / 12.0), 6) + 0.0 AS cos_month
FROM {_MS} s"""


def _roll(k: int, use: str) -> str:
    fr = f"OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    full = f"count(y) {fr} = {k}"
    return (f"CASE WHEN {full} AND {use} THEN avg(y) {fr} END AS y_rolling_mean_{k}, "
            f"CASE WHEN {full} AND {use} THEN stddev_samp(y) {fr} END AS y_rolling_std_{k}")


_LAGS = f"""(SELECT region, ts, y,
    lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2, lag(y, 3) OVER w AS y_lag_3,
    CASE WHEN n >= 24 THEN lag(y, 6) OVER w END AS y_lag_6, CASE WHEN n >= 24 THEN lag(y, 12) OVER w END AS y_lag_12,
    {_roll(2, 'n < 12')}, {_roll(3, 'true')}, {_roll(6, 'n >= 12')}
FROM {_X} x WINDOW w AS (PARTITION BY region ORDER BY ts))"""
_FEATS = ["y_lag_1", "y_lag_2", "y_lag_3", "y_lag_6", "y_lag_12", "y_rolling_mean_2", "y_rolling_std_2",
          "y_rolling_mean_3", "y_rolling_std_3", "y_rolling_mean_6", "y_rolling_std_6"]

SQL["V5"] = f"SELECT region, ts, round(y, 4) AS y, " + ", ".join(f"round({c}, 4) AS {c}" for c in _FEATS) + f" FROM {_LAGS} l"

SQL["V7"] = f"SELECT region, ts, round(y, 4) AS y, " + ", ".join(
    f"round(coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS {c}"
    for c in _FEATS) + f" FROM {_LAGS} l"

SQL["V8"] = f"""SELECT region, CAST(step AS INTEGER) AS step, CAST(CAST(last AS DATE) + to_months(step) AS TIMESTAMP) AS ts
FROM (SELECT region, max(ts) AS last FROM {_MS} s GROUP BY region) l, range(1, 13) r(step)"""

_LT = f"""(WITH x AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY month) - 1 AS DOUBLE) AS t FROM {_MS_RAW} m),
    f AS (SELECT region, count(*) AS n, max(month) AS last, regr_slope(revenue, t) AS b_rev, regr_intercept(revenue, t) AS a_rev,
          regr_slope(expenses, t) AS b_exp, regr_intercept(expenses, t) AS a_exp, sum(expenses) AS s_exp FROM x GROUP BY region
          HAVING count(*) >= 2),
    e AS (SELECT region, coalesce(stddev_pop(revenue - (a_rev + b_rev * t)), 0.0) AS std_error FROM x JOIN f USING (region)
          GROUP BY region)
SELECT region, CAST(step AS INTEGER) AS step, strftime(CAST(last AS DATE) + to_months(step), '%Y-%m') AS period,
    round(greatest(a_rev + b_rev * (n + step - 1), 0.0), 2) AS projected_revenue,
    CASE WHEN s_exp > 0 THEN round(greatest(a_exp + b_exp * (n + step - 1), 0.0), 2) END AS projected_expenses,
    CASE WHEN s_exp > 0 THEN round((a_rev + b_rev * (n + step - 1)) - (a_exp + b_exp * (n + step - 1)), 2) END AS projected_profit,
    b_rev AS revenue_slope, std_error
FROM f JOIN e USING (region), range(1, 13) r(step))"""

SQL["M1"] = f"SELECT region, step, period, projected_revenue, projected_expenses, projected_profit FROM {_LT} p"

SQL["M2"] = f"""WITH p AS {_LT},
    g AS (SELECT region, sum(CASE WHEN step <= 1 THEN projected_revenue END) AS rev1,
          sum(CASE WHEN step <= 3 THEN projected_revenue END) AS rev3, sum(CASE WHEN step <= 12 THEN projected_revenue END) AS rev12,
          sum(CASE WHEN step <= 1 THEN coalesce(projected_profit, 0) END) AS prof1,
          sum(CASE WHEN step <= 3 THEN coalesce(projected_profit, 0) END) AS prof3,
          sum(CASE WHEN step <= 12 THEN coalesce(projected_profit, 0) END) AS prof12, first(std_error) AS sd FROM p GROUP BY region)
SELECT region, 'next_month' AS horizon, 1 AS months, round(rev1, 2) AS revenue, round(prof1, 2) AS profit,
    round(greatest(0.0, round(rev1, 2) - 1.96 * sd * sqrt(1)), 2) AS lower_bound_revenue, round(round(rev1, 2) + 1.96 * sd * sqrt(1), 2) AS upper_bound_revenue FROM g
UNION ALL SELECT region, 'next_quarter', 3, round(rev3, 2), round(prof3, 2),
    round(greatest(0.0, round(rev3, 2) - 1.96 * sd * sqrt(3)), 2), round(round(rev3, 2) + 1.96 * sd * sqrt(3), 2) FROM g
UNION ALL SELECT region, 'next_year', 12, round(rev12, 2), round(prof12, 2),
    round(greatest(0.0, round(rev12, 2) - 1.96 * sd * sqrt(12)), 2), round(round(rev12, 2) + 1.96 * sd * sqrt(12), 2) FROM g"""

SQL["M3"] = f"""SELECT region, round(revenue_slope, 4) AS revenue_slope,
    CASE WHEN revenue_slope < -50 THEN 'Downward Trajectory' WHEN revenue_slope > 50 THEN 'Upward Acceleration'
         ELSE 'Stable / Horizontal' END AS trend FROM {_LT} p WHERE step = 1"""

_SPLIT = f"""(SELECT *, CAST(least(6, greatest(1, floor(n * 0.25))) AS BIGINT) AS test_size FROM {_X} x)"""

SQL["M9"] = f"""SELECT region, ts, t, n, test_size, CASE WHEN t >= n - test_size THEN 'test' ELSE 'train' END AS role
FROM {_SPLIT} s"""

SQL["M12"] = f"""WITH x AS {_X},
    p AS (SELECT DISTINCT region, n, CASE WHEN n - 18 < 12 THEN 12 ELSE n - 18 END AS start FROM x),
    q AS (SELECT *, CAST(greatest(1, floor((n - start - 6) / 2)) AS BIGINT) AS stp FROM p),
    folds AS (SELECT region, CAST(i AS INTEGER) AS fold,
        CAST(CASE WHEN n < 18 THEN greatest(1, n - 6) ELSE start + i * stp END AS BIGINT) AS split,
        CAST(CASE WHEN n < 18 THEN n ELSE least(start + i * stp + 6, n) END AS BIGINT) AS test_end
        FROM q, range(0, 3) r(i)
        WHERE (n < 18 AND i = 0) OR (n >= 18 AND start + i * stp < n AND start + i * stp >= 12))
SELECT region, ts, fold, split, test_end, CASE WHEN t < split THEN 'train' ELSE 'test' END AS role
FROM x JOIN folds USING (region) WHERE t < test_end"""

# Holdout predictions of the three SQL forecasters (h = 6).
_BT = f"""(WITH s AS {_SPLIT},
    tr AS (SELECT * FROM s WHERE t < n - test_size),
    te AS (SELECT region, ts, y, t - (n - test_size) + 1 AS step FROM s WHERE t >= n - test_size),
    lf AS (SELECT region, count(*) AS nt, coalesce(regr_slope(y, t), 0.0) AS b, coalesce(regr_intercept(y, t), avg(y)) AS a
           FROM tr GROUP BY region),
    sn AS (SELECT region, list(y ORDER BY t) AS season, count(*) AS m FROM
           (SELECT *, count(*) OVER (PARTITION BY region) AS nt FROM tr) z WHERE t >= nt - 12 GROUP BY region),
    mu AS (SELECT region, avg(y) AS mu FROM tr GROUP BY region)
SELECT te.region, 'linear_trend' AS model, 0 AS ordinal, ts, y, a + b * (nt + step - 1) AS forecast FROM te JOIN lf USING (region)
UNION ALL SELECT te.region, 'seasonal_naive_12', 1, ts, y, season[CAST((step - 1) % m AS BIGINT) + 1] FROM te JOIN sn USING (region)
UNION ALL SELECT te.region, 'historical_mean', 2, ts, y, mu FROM te JOIN mu USING (region))"""


def _metrics_sql(keys: str, src: str) -> str:
    return f"""SELECT {keys}, count(*) AS n,
    round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - forecast) / y) END), 0.0), 4) AS MAPE,
    round(sqrt(avg((y - forecast) * (y - forecast))), 2) AS RMSE, round(avg(abs(y - forecast)), 2) AS MAE,
    round(coalesce(avg(CASE WHEN (abs(y) + abs(forecast)) / 2.0 <> 0 THEN abs(y - forecast) / ((abs(y) + abs(forecast)) / 2.0) END), 0.0), 4) AS sMAPE,
    round(CASE WHEN var_pop(y) * count(y) > 0 THEN 1.0 - sum((y - forecast) * (y - forecast)) / (var_pop(y) * count(y)) ELSE 0.0 END, 4) AS R2,
    round(max(abs(y - forecast)), 2) AS MAX_ERROR FROM {src} b GROUP BY {keys}"""


SQL["M13"] = _metrics_sql("region, model", f"(SELECT * FROM {_BT} b0 WHERE model = 'linear_trend')")
SQL["M14"] = f"""SELECT region, ts, round(y, 2) AS y, round(forecast, 1) AS forecast, round(y - forecast, 1) AS residual
FROM {_BT} b WHERE model = 'linear_trend'"""
SQL["M10"] = f"""WITH m AS ({_metrics_sql("region, model, ordinal", _BT)})
SELECT region, model, CAST(ordinal AS INTEGER) AS ordinal, n, MAPE, RMSE, MAE, sMAPE, R2, MAX_ERROR,
    row_number() OVER (PARTITION BY region ORDER BY MAPE, ordinal) = 1 AS is_best FROM m"""

SQL["M7_naive"] = f"""WITH sn AS (SELECT region, list(y ORDER BY t) AS season, count(*) AS m FROM {_X} x WHERE t >= n - 12 GROUP BY region)
SELECT region, CAST(step AS INTEGER) AS step, round(season[CAST((step - 1) % m AS BIGINT) + 1], 4) AS forecast
FROM sn, range(1, 13) r(step)"""

# Final linear forecast (12 months) with intervals from the holdout residuals.
_FC = f"""(WITH x AS {_X},
    lf AS (SELECT region, count(*) AS nt, max(ts) AS last, coalesce(regr_slope(y, t), 0.0) AS b,
           coalesce(regr_intercept(y, t), avg(y)) AS a FROM x GROUP BY region),
    rs AS (SELECT region, stddev_pop(y - forecast) AS rsd, count(*) AS rn FROM {_BT} b WHERE model = 'linear_trend' GROUP BY region),
    hs AS (SELECT region, stddev_pop(y) AS hsd, count(y) AS hn, min(y) AS hmin, avg(y) AS hmu FROM x GROUP BY region),
    p AS (SELECT region, CAST(step AS INTEGER) AS step, a + b * (nt + step - 1) AS forecast,
          CAST(CAST(last AS DATE) + to_months(step) AS TIMESTAMP) AS ts FROM lf, range(1, 13) r(step)),
    st AS (SELECT *, CASE WHEN rn > 2 THEN rsd WHEN hn > 0 THEN hsd * 0.10 ELSE 1.0 END AS sigma FROM hs LEFT JOIN rs USING (region))
SELECT region, step, forecast, ts, hn, hsd, hmu,
    CASE WHEN hmin >= 0 THEN greatest(round(forecast - 1.96 * sigma * sqrt(step), 2), 0.0)
         ELSE round(forecast - 1.96 * sigma * sqrt(step), 2) END AS lower_bound,
    round(forecast + 1.96 * sigma * sqrt(step), 2) AS upper_bound FROM p JOIN st USING (region))"""

SQL["M15"] = f"SELECT region, step, round(forecast, 2) AS forecast, ts, lower_bound, upper_bound FROM {_FC} f"

_SC = f"""(SELECT region, step, ts, lower_bound, upper_bound, round(forecast, 2) AS forecast,
    round(least(forecast * (1.0 - (0.08 + 0.01 * v * step)), lower_bound), 2) AS conservative,
    round(greatest(forecast * (1.0 + (0.08 + 0.01 * v * step)), upper_bound), 2) AS optimistic
FROM (SELECT *, CASE WHEN hn > 1 AND hmu <> 0 THEN hsd / hmu ELSE 0.05 END AS v FROM {_FC} f) z)"""

SQL["M16"] = f"SELECT * FROM {_SC} s"

_MAPE = f"(SELECT region, MAPE FROM ({_metrics_sql('region', f'(SELECT * FROM {_BT} b0 WHERE model = {chr(39)}linear_trend{chr(39)})')}) mm)"

SQL["M18"] = f"""WITH last AS (SELECT region, arg_max(y, ts) AS lv FROM {_MS} s GROUP BY region),
    f AS (SELECT region, sum(forecast) AS tot, avg(forecast) AS av, arg_max(ts, forecast) AS best_period, count(*) AS horizon
          FROM {_SC} sc GROUP BY region),
    j AS (SELECT *, CASE WHEN lv > 0 THEN (av - lv) / lv * 100.0 ELSE 0.0 END AS g FROM f JOIN last USING (region)
          LEFT JOIN {_MAPE} mp USING (region))
SELECT region, round(lv, 2) AS current_period_baseline, round(tot, 2) AS projected_horizon_total,
    round(av, 2) AS projected_period_average, round(g, 2) AS growth_rate_pct,
    CASE WHEN g > 2 THEN 'UPWARD GROWTH' WHEN g < -2 THEN 'DOWNWARD SLUMP' ELSE 'STABLE / FLAT' END AS trend_direction,
    CASE WHEN coalesce(MAPE, 0) < 0.05 THEN 'High (MAPE < 5%)' WHEN coalesce(MAPE, 0) < 0.15 THEN 'Moderate (MAPE < 15%)'
         ELSE 'Low confidence' END AS forecast_confidence, best_period, horizon FROM j"""

SQL["M20"] = f"""WITH g AS (SELECT region, sum(forecast) AS f, sum(conservative) AS c, arg_min(forecast, step) AS first_f,
        arg_max(forecast, step) AS last_f, count(*) AS h FROM {_SC} sc GROUP BY region),
    j AS (SELECT *, CASE WHEN f > 0 THEN (f - c) / f * 100.0 ELSE 0.0 END AS gap FROM g LEFT JOIN {_MAPE} mp USING (region)),
    l AS (SELECT region, gap, list_filter([CASE WHEN coalesce(MAPE, 0) > 0.15 THEN 'high_forecast_variance' END,
        CASE WHEN gap > 10.0 THEN 'downside_exposure' END,
        CASE WHEN h > 1 AND last_f < first_f THEN 'negative_horizon_drift' END], lambda x: x IS NOT NULL) AS r FROM j),
    l2 AS (SELECT region, gap, CASE WHEN len(r) > 0 THEN r ELSE ['low_operational_risk'] END AS r FROM l)
SELECT region, CAST(unnest(range(0, len(r))) AS INTEGER) AS ordinal, unnest(r) AS risk, round(gap, 1) AS downside_gap_pct FROM l2"""

SQL["M21"] = f"""WITH s AS ({SQL["M18"]}),
    mc AS (SELECT region, min(conservative) AS mc FROM {_SC} sc GROUP BY region),
    l AS (SELECT region, mc, list_filter([CASE WHEN growth_rate_pct > 5 THEN 'capital_commitment'
        WHEN growth_rate_pct < -2 THEN 'cost_realignment' END, 'risk_mitigation', 'continuous_monitoring'],
        lambda x: x IS NOT NULL) AS a FROM s JOIN mc USING (region))
SELECT region, CAST(unnest(range(0, len(a))) AS INTEGER) AS ordinal, unnest(a) AS action, round(mc, 2) AS min_conservative FROM l"""

SQL["M22"] = f"""SELECT region, 'history' AS series, ts, round(y, 2) AS value FROM {_MS} s
UNION ALL SELECT region, 'forecast', ts, forecast FROM {_SC} a
UNION ALL SELECT region, 'lower_bound', ts, lower_bound FROM {_SC} b
UNION ALL SELECT region, 'upper_bound', ts, upper_bound FROM {_SC} c
UNION ALL SELECT region, 'conservative', ts, conservative FROM {_SC} d
UNION ALL SELECT region, 'optimistic', ts, optimistic FROM {_SC} e"""

# ---------------------------------------------------------------------------
# Drift, entitlement joins, similarity (G, B, N)
# ---------------------------------------------------------------------------

from bizlens.plans.tenancy import (AS_OF, FEATURES_SQL, PLANS_SQL, SUBSCRIPTIONS_SQL, TENANTS_SQL,  # noqa: E402
                                   USER_TENANT_SQL, USERS_SQL)


def _fin(c: str) -> str:
    return f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


_DRIFT = f"""(WITH e AS (SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS side,
        {_fin('value')} AS value, {_fin("CAST(json_extract_string(props, '$.k') AS DOUBLE)")} AS k FROM events),
    l AS (SELECT event_type, 'value' AS "column", value AS v, side FROM e WHERE value IS NOT NULL
          UNION ALL SELECT event_type, 'k', k, side FROM e WHERE k IS NOT NULL),
    m AS (SELECT event_type, "column", sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS n1,
          sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS n2,
          avg(CASE WHEN side = 1 THEN v END) AS reference_mean, avg(CASE WHEN side = 2 THEN v END) AS current_mean,
          stddev_samp(CASE WHEN side = 1 THEN v END) AS reference_std, stddev_samp(CASE WHEN side = 2 THEN v END) AS current_std
          FROM l GROUP BY ALL),
    c AS (SELECT event_type, "column", v, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c1,
          sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS c2 FROM l GROUP BY ALL),
    cdf AS (SELECT *, sum(c1) OVER w AS cum1, sum(c2) OVER w AS cum2, lead(v) OVER w AS nv FROM c
            WINDOW w AS (PARTITION BY event_type, "column" ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT event_type, "column", max(abs(cum1 / n1 - cum2 / n2)) AS ks,
          coalesce(sum(abs(cum1 / n1 - cum2 / n2) * (nv - v)), 0.0) AS w FROM cdf JOIN m USING (event_type, "column")
          GROUP BY ALL),
    j AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) AS en FROM m JOIN s USING (event_type, "column")),
    p AS (SELECT *, (en + 0.12 + 0.11 / en) * ks AS lam FROM j)
SELECT event_type, "column", CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, ks AS ks_statistic,
    CASE WHEN n1 > 0 AND n2 > 0 THEN least(greatest(CASE WHEN lam < 1e-3 THEN 1.0 ELSE
        2.0 * list_sum(list_transform(range(1, 101), lambda j: pow(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam))) END, 0.0), 1.0)
    END AS ks_pvalue, w AS wasserstein_distance, reference_mean, current_mean, reference_std, current_std FROM p)"""

SQL["G1"] = f"""SELECT event_type, "column", n1, n2, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue,
    round(wasserstein_distance, 6) AS wasserstein_distance, round(reference_mean, 6) AS reference_mean,
    round(current_mean, 6) AS current_mean, round(reference_std, 6) AS reference_std, round(current_std, 6) AS current_std,
    (n1 > 0 AND n2 > 0 AND ks_pvalue < 0.05) AS drift_detected FROM {_DRIFT} d"""

SQL["G2"] = f"""SELECT event_type, true AS success, sum(CAST(ks_pvalue < 0.05 AS INTEGER)) > 0 AS drift_detected,
    round(sum(CAST(ks_pvalue < 0.05 AS INTEGER)) / count(*) * 100.0, 2) AS drift_percentage,
    CAST(count(*) AS INTEGER) AS total_columns_checked, CAST(sum(CAST(ks_pvalue < 0.05 AS INTEGER)) AS INTEGER) AS drifted_columns
FROM {_DRIFT} d GROUP BY event_type"""

SQL["G3"] = f"""WITH s AS (SELECT CAST(month(date) AS INTEGER) AS month_of_year,
        avg(CASE WHEN date < TIMESTAMP '1998-06-01' THEN revenue END) AS b, avg(CASE WHEN date >= TIMESTAMP '1998-06-01' THEN revenue END) AS c
        FROM {BV_SQL} v GROUP BY ALL)
SELECT month_of_year, round(b, 4) AS baseline_mean, round(c, 4) AS current_mean,
    round(CASE WHEN b <> 0 THEN (c - b) / abs(b) * 100.0 END, 4) AS shift_pct,
    coalesce(abs(CASE WHEN b <> 0 THEN (c - b) / abs(b) * 100.0 END) > 20.0, false) AS shifted FROM s"""

SQL["B1"] = f"""SELECT ut.user_id, ut.tenant_id, t.name AS tenant_name, ut.role FROM {USER_TENANT_SQL} ut
JOIN {TENANTS_SQL} t ON ut.tenant_id = t.id"""
SQL["B2"] = f"""SELECT u.id AS user_id, u.email, ut.tenant_id, t.name AS tenant_name, ut.role, ut.subscription_plan
FROM {USERS_SQL} u JOIN {USER_TENANT_SQL} ut ON ut.user_id = u.id JOIN {TENANTS_SQL} t ON ut.tenant_id = t.id"""
SQL["B3"] = f"""SELECT t.id AS tenant_id, t.name AS tenant_name, ut.user_id, u.email, ut.role
FROM {TENANTS_SQL} t JOIN {USER_TENANT_SQL} ut ON ut.tenant_id = t.id JOIN {USERS_SQL} u ON ut.user_id = u.id"""
_EFF = f"""(SELECT u.id AS user_id, ut.tenant_id,
    CASE WHEN ut.id IS NULL THEN 'Starter' WHEN ut.subscription_expiry < TIMESTAMP '{AS_OF}' THEN 'Starter'
         ELSE coalesce(ut.subscription_plan, 'Starter') END AS effective_plan
FROM {USERS_SQL} u LEFT JOIN {USER_TENANT_SQL} ut ON ut.user_id = u.id)"""
SQL["B4"] = f"SELECT * FROM {_EFF} e"
SQL["B5"] = f"""SELECT e.effective_plan, e.user_id, e.tenant_id, p.rank, f.feature
FROM {_EFF} e JOIN {PLANS_SQL} p ON p.plan = e.effective_plan JOIN {FEATURES_SQL} f ON f.min_rank <= p.rank"""
SQL["B6"] = f"""SELECT tenant_id, id, plan, status, start_date FROM {SUBSCRIPTIONS_SQL} s
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, id DESC) = 1"""
SQL["B7"] = f"""WITH pr AS (SELECT plan, 'USD' AS currency, price_usd AS price FROM {PLANS_SQL} p
    UNION ALL SELECT plan, 'NGN', price_usd * 800 FROM {PLANS_SQL} p2)
SELECT s.id, s.tenant_id, s.plan, s.currency, pr.price, s.amount = pr.price AS amount_matches
FROM {SUBSCRIPTIONS_SQL} s JOIN pr ON s.plan = pr.plan AND s.currency = pr.currency"""

SQL["N1"] = """WITH ex AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings),
    c AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM
          (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY ALL) z GROUP BY label),
    s AS (SELECT c.query_id, e.vec_id,
          list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.q), lambda p: p[1] * p[2]))
          / (sqrt(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x)))
             * sqrt(list_sum(list_transform(c.q, lambda x: x * x)))) AS similarity
          FROM embeddings e, c)
SELECT query_id, vec_id, round(similarity, 6) AS similarity,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 5"""

SQL["N2"] = """WITH b AS (SELECT doc_id, text, source, 0 AS batch FROM documents
    UNION ALL SELECT item_id, text, 'benchmark', 1 FROM benchmark)
SELECT md5(text) AS key, doc_id, text, source FROM b
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY batch DESC, doc_id DESC) = 1"""

# ---------------------------------------------------------------------------
# Insights and rules (J)
# ---------------------------------------------------------------------------

from bizlens.operators.insight import PLAN_DEFAULTS, RULE_METRIC_DEFAULTS, RULES  # noqa: E402

_J1 = f"""(WITH p AS ({SQL["R2"]}), i AS ({SQL["R3"]}),
    t AS (SELECT *, CASE "column" WHEN 'quantity' THEN 0 WHEN 'revenue' THEN 1 ELSE 2 END AS column_order FROM ({SQL["T1"]}) t0),
    u AS (SELECT region, 'correlation' AS type, printf('%s strongly influences %s (corr=%.2f)', feature_1, feature_2, abs(correlation)) AS insight,
            [feature_1, feature_2] AS features, least(greatest(abs(correlation), 0.0), 1.0) AS strength,
            CASE WHEN abs(correlation) > 0.6 THEN 0.7 ELSE 0.4 END AS business_impact, 1.0 AS confidence, 0 AS src, rank AS ord FROM p
          UNION ALL SELECT region, 'feature_importance', printf('%s is a key driver of performance', feature), [feature],
            least(greatest(abs(importance), 0.0), 1.0), CASE WHEN least(greatest(abs(importance), 0.0), 1.0) > 0.5 THEN 0.8 ELSE 0.5 END,
            1.0, 1, rank FROM i
          UNION ALL SELECT region, 'trend', printf('%s is %s over time', "column", trend), ["column"],
            least(greatest(abs(slope), 0.0), 1.0), 0.6, 1.0, 2, column_order FROM t),
    u2 AS (SELECT region, type, insight, features, CAST(strength AS DOUBLE) AS strength,
            CAST(business_impact AS DOUBLE) AS business_impact, CAST(confidence AS DOUBLE) AS confidence, src, ord FROM u),
    s AS (SELECT region, type, insight, features, round(strength, 3) AS strength, round(business_impact, 3) AS business_impact,
            round(confidence, 3) AS confidence, round(0.5 * strength + 0.3 * business_impact + 0.2 * confidence, 3) AS score, src, ord FROM u2)
SELECT region, type, insight, features, strength, business_impact, confidence, score,
    CAST(row_number() OVER (PARTITION BY region ORDER BY score DESC, src, ord) AS INTEGER) AS rank
FROM s WHERE score > 0.5 QUALIFY rank <= 10)"""

SQL["J1"] = f"SELECT * FROM {_J1} j"
SQL["J2"] = f"""SELECT region, type || ':' || array_to_string(list_sort(features), '-') AS key, min(rank) OVER k AS first_rank,
    type, insight, features, strength, business_impact, confidence, score, rank FROM {_J1} j
WINDOW k AS (PARTITION BY region, type || ':' || array_to_string(list_sort(features), '-'))
QUALIFY row_number() OVER (PARTITION BY region, type || ':' || array_to_string(list_sort(features), '-') ORDER BY score DESC, rank) = 1"""

_RULES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', {}, {}, '{}', '{}', '{}', '{}', '{}', '{}', '{}', '{}')".format(
        o, m, "'-inf'::DOUBLE" if lo == float('-inf') else lo, "'inf'::DOUBLE" if hi == float('inf') else hi,
        cat, hz, tpl.replace("'", "''"), act.replace("'", "''"), imp.replace("'", "''"), pp, fn, fp)
    for (o, m, lo, hi, cat, hz, tpl, act, imp, pp, fn, fp) in RULES) + \
    ") t(ordinal, metric, low, high, category, time_horizon, finding_template, action, impact, plan_prefix, functional, functional_prefix))"

_J6 = f"""(WITH d AS ({SQL["K15"]}), k1 AS ({SQL["K1"]}),
    mv AS (SELECT d.region, {", ".join(f"coalesce(CAST({'k1.' if m == 'marketing_roi' else 'd.'}{m} AS DOUBLE), {v}) AS {m}" for m, v in RULE_METRIC_DEFAULTS.items())}
           FROM d JOIN k1 USING (region)),
    l AS (UNPIVOT mv ON {", ".join(RULE_METRIC_DEFAULTS)} INTO NAME metric VALUE value),
    fired AS (SELECT l.region, r.ordinal, 0 AS sub, r.category, printf(r.finding_template, l.value) AS finding, r.action, r.impact,
              r.time_horizon, r.plan_prefix, r.functional, r.functional_prefix FROM l JOIN {_RULES_SQL} r
              ON l.metric = r.metric AND l.value > r.low AND l.value < r.high),
    an AS (SELECT region, metric, strftime(date, '%Y-%m-%d') AS period,
           row_number() OVER (PARTITION BY region ORDER BY date, metric) AS k FROM ({SQL["A1"]}) a0),
    ar AS (SELECT region, 1 AS ordinal, k AS sub, 'Risk Mitigation' AS category,
           printf('Flagged risk event: %s on %s.', metric, period) AS finding,
           printf('Investigate root cause of variance spike in %s during period %s.', metric, period) AS action,
           'Prevents recurring operational cost leakage.' AS impact, '30 Days' AS time_horizon, 'Risk Audit' AS plan_prefix,
           'risk_reduction' AS functional, printf('Investigate %s outlier to prevent margin erosion.', metric) AS functional_prefix
           FROM an WHERE k <= 2)
SELECT * FROM fired UNION ALL SELECT * FROM ar)"""

SQL["J6"] = f"""SELECT region, CAST(ordinal AS INTEGER) AS ordinal, CAST(sub AS INTEGER) AS _sub, category, finding, action,
    impact, time_horizon FROM {_J6} j"""


def _plan_list(cond: str, item: str, key: str) -> str:
    lst = f"list({item} ORDER BY ordinal, sub) FILTER (WHERE {cond})"
    return f"CASE WHEN len(coalesce({lst}, [])) > 0 THEN {lst} ELSE ['{PLAN_DEFAULTS[key]}'] END"


_FUNC = ("CASE WHEN functional = 'risk_reduction' AND category = 'Risk Mitigation' THEN functional_prefix "
         "ELSE functional_prefix || ': ' || action END")
SQL["J7"] = f"""SELECT region,
    {_plan_list("time_horizon = '30 Days'", "plan_prefix || ': ' || action", "30 Days")} AS immediate_30_days,
    {_plan_list("time_horizon = '90 Days'", "plan_prefix || ': ' || action", "90 Days")} AS medium_term_90_days,
    {_plan_list("time_horizon = '12 Months'", "plan_prefix || ': ' || action", "12 Months")} AS long_term_12_months,
    {_plan_list("functional = 'revenue_improvement'", _FUNC, "revenue_improvement")} AS revenue_improvement,
    {_plan_list("functional = 'profit_improvement'", _FUNC, "profit_improvement")} AS profit_improvement,
    {_plan_list("functional = 'risk_reduction'", _FUNC, "risk_reduction")} AS risk_reduction
FROM {_J6} j GROUP BY region"""

# ---------------------------------------------------------------------------
# Sources and streams (S, W)
# ---------------------------------------------------------------------------

SQL["S5"] = """SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS sum_qty,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL"""
SQL["S8"] = """SELECT doc_id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark"""
SQL["S11"] = f"SELECT * FROM {BV_SQL} v ORDER BY {_ORDER} LIMIT 10"
_ROUNDTRIP = f"""SELECT region, count(*) AS rows, round(sum(round(revenue, 2)), 2) AS revenue,
    min(date) AS first_date, max(date) AS last_date FROM {BV_SQL} v GROUP BY region"""
SQL["S2"] = _ROUNDTRIP
SQL["S3"] = _ROUNDTRIP
SQL["S4"] = f"""SELECT region, count(*) AS rows, round(sum(revenue), 2) AS revenue,
    min(date) AS first_date, max(date) AS last_date FROM {BV_SQL} v GROUP BY region"""

SQL["W2"] = """SELECT * FROM (SELECT date_trunc('day', ts) AS window_start,
    date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS events,
    round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2, 3) w
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
SQL["W3"] = """WITH s AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, event_type, ts, value, round((value - mu) / sd, 4) AS z_score FROM events JOIN s USING (event_type)
WHERE sd > 0 AND abs((value - mu) / sd) > 2.0"""

SQL["C12"] = f"""SELECT region, CAST(date_trunc('month', date) AS TIMESTAMP) AS ts, sum(revenue) AS y FROM {FV_SQL} f
WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY ALL"""
SQL["C12_values"] = SQL["C12"]
SQL["T2"] = f"""WITH v AS {BV_SQL}, d AS (SELECT 'region' AS "column", count(DISTINCT region) AS unique_values FROM v
    UNION ALL SELECT 'segment', count(DISTINCT segment) FROM v UNION ALL SELECT 'product', count(DISTINCT product) FROM v)
SELECT "column", unique_values FROM d WHERE unique_values BETWEEN 2 AND 12
ORDER BY CASE WHEN regexp_matches("column", 'segment|category|region|department|gender|group|channel|type') THEN 1 ELSE 0 END DESC,
    (SELECT min(place) FROM (SELECT column_name AS n, row_number() OVER () AS place FROM (DESCRIBE SELECT * FROM v)) x
     WHERE x.n = d."column") LIMIT 1"""
SQL["R5"] = f"""SELECT * EXCLUDE (tier) FROM (SELECT *, CASE WHEN lower(feature_1) = 'revenue' OR lower(feature_2) = 'revenue' THEN 0
    WHEN regexp_matches(lower(feature_1), 'revenue|sales|profit|income|purchase|conversion|score|spend')
     AND regexp_matches(lower(feature_2), 'revenue|sales|profit|income|purchase|conversion|score|spend')
    THEN 1 ELSE 2 END AS tier FROM ({SQL["R2"]}) p)
QUALIFY row_number() OVER (PARTITION BY region ORDER BY tier, rank) = 1"""
SQL["S9"] = """SELECT CAST(11 AS INTEGER) AS columns, CAST(least(count(*), 5) AS BIGINT) AS rows_seen, true AS enough_columns,
    count(*) >= 5 AS enough_rows, count(*) >= 5 AS valid FROM lineitem"""

SQL["K14"] = f"""WITH v AS (SELECT f.*, n.n_name AS nation FROM {FV_SQL} f JOIN customer c ON f.customer = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey),
    m AS (SELECT nation, date_trunc('month', date) AS month, sum(revenue) AS rev, sum(expenses) AS exp, count(*) AS n,
          count(revenue) AS rev_n FROM v GROUP BY ALL),
    g AS (SELECT nation, coalesce(sum(rev), 0) AS rev, coalesce(sum(exp), 0) AS exp, sum(n) AS n, sum(rev_n) AS rev_n,
          count(month) AS n_months, arg_min(rev, month) AS first_m, arg_max(rev, month) AS last_m FROM m GROUP BY nation),
    k AS (SELECT nation, round(rev, 2) AS total_revenue, round(rev - exp, 2) AS total_profit,
          CASE WHEN rev > 0 THEN round((rev - exp) / rev * 100.0, 2) ELSE 0.0 END AS net_profit_margin,
          CASE WHEN n <= 1 OR rev_n < 2 THEN 0.0 WHEN n_months >= 2 AND first_m > 0
               THEN round((last_m - first_m) / first_m * 100.0, 2) ELSE 0.0 END AS revenue_growth FROM g)
SELECT n.n_name AS nation, coalesce(total_revenue, 0.0) AS total_revenue, coalesce(total_profit, 0.0) AS total_profit,
    coalesce(net_profit_margin, 0.0) AS net_profit_margin, coalesce(revenue_growth, 0.0) AS revenue_growth,
    total_revenue IS NULL AS empty_input
FROM (SELECT DISTINCT n_name FROM nation) n LEFT JOIN k ON k.nation = n.n_name"""

SQL["C8"] = _STATS + 'SELECT "column", (non_null > 0 AND numeric < non_null AND greatest(' + ", ".join(
    f'"{f}"' for f in _CHART) + ') / non_null >= 0.8) AS can_parse FROM s'

_FOLDS = f"""(WITH x AS {_X},
    p AS (SELECT DISTINCT region, n, CASE WHEN n - 18 < 12 THEN 12 ELSE n - 18 END AS start FROM x),
    q AS (SELECT *, CAST(greatest(1, floor((n - start - 6) / 2)) AS BIGINT) AS stp FROM p)
SELECT region, CAST(i AS INTEGER) AS fold,
    CAST(CASE WHEN n < 18 THEN greatest(1, n - 6) ELSE start + i * stp END AS BIGINT) AS split,
    CAST(CASE WHEN n < 18 THEN n ELSE least(start + i * stp + 6, n) END AS BIGINT) AS test_end
FROM q, range(0, 3) r(i) WHERE (n < 18 AND i = 0) OR (n >= 18 AND start + i * stp < n AND start + i * stp >= 12))"""

_CV_BT = f"""(WITH x AS {_X}, f AS {_FOLDS},
    tr AS (SELECT x.region, x.ts, x.y, x.t, f.fold FROM x JOIN f USING (region) WHERE x.t < f.split),
    te AS (SELECT x.region, f.fold, x.ts, x.y, x.t - f.split + 1 AS step FROM x JOIN f USING (region)
           WHERE x.t >= f.split AND x.t < f.test_end),
    lf AS (SELECT region, fold, count(*) AS nt, coalesce(regr_slope(y, t), 0.0) AS b,
           coalesce(regr_intercept(y, t), avg(y)) AS a FROM tr GROUP BY region, fold),
    sn AS (SELECT region, fold, list(y ORDER BY t) AS season, count(*) AS m FROM
           (SELECT *, count(*) OVER (PARTITION BY region, fold) AS nt FROM tr) z WHERE t >= nt - 12 GROUP BY region, fold),
    mu AS (SELECT region, fold, avg(y) AS mu FROM tr GROUP BY region, fold)
SELECT te.region, te.fold, 'linear_trend' AS model, 0 AS ordinal, ts, y, a + b * (nt + step - 1) AS forecast
    FROM te JOIN lf USING (region, fold)
UNION ALL SELECT te.region, te.fold, 'seasonal_naive_12', 1, ts, y, season[CAST((step - 1) % m AS BIGINT) + 1]
    FROM te JOIN sn USING (region, fold)
UNION ALL SELECT te.region, te.fold, 'historical_mean', 2, ts, y, mu FROM te JOIN mu USING (region, fold))"""

SQL["M12_cv"] = f"""WITH pf AS ({_metrics_sql("region, model, ordinal, fold", _CV_BT)}),
    m AS (SELECT region, model, ordinal, CAST(sum(n) AS BIGINT) AS n, round(avg(MAPE), 4) AS MAPE, round(avg(RMSE), 4) AS RMSE,
          round(avg(MAE), 4) AS MAE, round(avg(sMAPE), 4) AS sMAPE, round(avg(R2), 4) AS R2,
          round(avg(MAX_ERROR), 4) AS MAX_ERROR FROM pf GROUP BY region, model, ordinal)
SELECT region, model, CAST(ordinal AS INTEGER) AS ordinal, n, MAPE, RMSE, MAE, sMAPE, R2, MAX_ERROR,
    row_number() OVER (PARTITION BY region ORDER BY MAPE, ordinal) = 1 AS is_best FROM m"""
SQL["C1"] = f"SELECT * FROM {FV_SQL} f"
SQL["C2"] = f"SELECT date, revenue, expenses, quantity AS revenue_2 FROM {BV_SQL} v"
SQL["C10"] = f"""SELECT date, revenue, expenses, new_customers, churn AS churn_rate, marketing AS marketing_spend, debt,
    inventory, cash AS cash_balance, product, region FROM {FV_SQL} f"""
SQL["J9"] = f"""SELECT region, 'The business ' || CASE WHEN health_score >= 70 THEN 'demonstrates strong financial health'
    WHEN health_score >= 50 THEN 'shows moderate financial stability with room for improvement'
    ELSE 'faces significant financial challenges that require immediate attention' END || ' with a health score of '
    || printf('%.1f', health_score) || '/100 (' || status || ') and ' || lower(risk_level) || ' risk exposure.' AS summary
FROM ({SQL["H1"]}) h"""
_MT = "(SELECT key AS region, ts, round(sum(v), 2) AS y FROM (" + " UNION ALL ".join(
    f"SELECT region || '|{c}' AS key, CAST(date_trunc('month', date) AS TIMESTAMP) AS ts, {c} AS v FROM {BV_SQL} v"
    for c in ("revenue", "expenses")) + ") u WHERE ts IS NOT NULL AND v IS NOT NULL GROUP BY ALL)"
SQL["M17"] = f"""SELECT split_part(region, '|', 1) AS region, split_part(region, '|', 2) AS target, * EXCLUDE (region)
FROM ({SQL["M10"].replace(_MS, _MT)}) m"""

SQL.update(series_sql(_MS, _DAILY, _BT, _metrics_sql))
SQL.update(insight_sql(SQL, BV_SQL, _LT))
SQL["W4"] = f"""SELECT * EXCLUDE (ks_pvalue0), 0 AS batch_id FROM (SELECT event_type, "column", n1, n2, round(ks_statistic, 6) AS ks_statistic,
    round(ks_pvalue, 6) AS ks_pvalue, round(wasserstein_distance, 6) AS wasserstein_distance, round(reference_mean, 6) AS reference_mean,
    round(current_mean, 6) AS current_mean, round(reference_std, 6) AS reference_std, round(current_std, 6) AS current_std,
    (n1 > 0 AND n2 > 0 AND ks_pvalue < 0.05) AS drift_detected, ks_pvalue AS ks_pvalue0 FROM {_DRIFT.replace(
        "FROM events),", "FROM (SELECT *, 1 AS part FROM events WHERE ts < TIMESTAMP '2024-01-16' UNION ALL SELECT *, 2 FROM events) ev),").replace(
        "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS side", "part AS side")} d)"""


def _balance_sql(gross: str, churn: str, cac: str, debt: str) -> str:
    return f"""WITH v AS {BALANCE_SQL},
    m AS (SELECT region, date_trunc('month', date) AS month, sum(revenue) AS rev FROM v GROUP BY ALL),
    mm AS (SELECT region, arg_min(rev, month) AS first_m, arg_max(rev, month) AS last_m FROM m GROUP BY region),
    ends AS (SELECT region, max(CASE WHEN up = 1 THEN active END) AS ac_first, max(CASE WHEN down = 1 THEN active END) AS ac_last,
        max(CASE WHEN down = 1 THEN cash END) AS cash, max(CASE WHEN down = 1 THEN debt END) AS debt,
        max(CASE WHEN down = 1 THEN equity END) AS equity FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_ORDER}) AS up,
            row_number() OVER (PARTITION BY region ORDER BY {_ORDER_DESC}) AS down FROM v) r GROUP BY region),
    g AS (SELECT region, sum(revenue) AS rev, sum(expenses) AS exp, count(*) AS n, sum(gross_profit) AS gp, sum(cogs) AS cogs,
        sum(churned) AS churned, avg(active) AS active, avg(cost_per_customer) AS cpc, sum(marketing) AS mkt, avg(leverage) AS leverage,
        avg(inventory) AS inv FROM v GROUP BY region)
SELECT region, round(rev, 2) AS total_revenue, round(exp, 2) AS total_expenses, round(rev - exp, 2) AS total_profit,
    round((rev - exp) / rev * 100.0, 2) AS net_profit_margin, round({gross}, 2) AS gross_margin,
    round((rev - exp) / rev * 100.0, 2) AS operating_margin, round(round((rev - exp) / rev * 100.0, 2) * 1.05, 2) AS ebitda_margin,
    round((last_m - first_m) / first_m * 100.0, 2) AS revenue_growth, round((ac_last - ac_first) / ac_first * 100.0, 2) AS customer_growth,
    {churn} AS churn_rate, round(mkt, 2) AS total_marketing_spend, round(rev / mkt, 2) AS marketing_roi, {cac} AS cac,
    round(cash, 2) AS cash_balance, round(cash / (exp / (n / 30.0)), 2) AS current_ratio, {debt} AS debt_ratio,
    round(exp / inv, 2) AS inventory_turnover FROM g JOIN ends USING (region) JOIN mm USING (region)"""


SQL["K1_balance"] = _balance_sql("gp / rev * 100.0", "round(churned / active * 100.0, 2)", "round(cpc, 2)", "round(debt / equity, 2)")
SQL["K1_cogs"] = _balance_sql("(rev - cogs) / rev * 100.0", "round(churned / active * 100.0, 2)", "NULL::DOUBLE", "round(leverage, 2)")
SQL["C14"] = f"""WITH v AS {BV_SQL}, n AS (SELECT unnest([{{'c': 'region', 'o': 1, 'n': (SELECT count(DISTINCT region) FROM v)}},
    {{'c': 'segment', 'o': 2, 'n': (SELECT count(DISTINCT segment) FROM v)}}, {{'c': 'product', 'o': 3, 'n': (SELECT count(DISTINCT product) FROM v)}}]) AS x)
SELECT 'sales' AS domain, 'revenue' AS kpi, 'revenue' AS target, (SELECT x.c FROM n WHERE x.n BETWEEN 2 AND 12
    ORDER BY x.c NOT IN ('region', 'segment'), x.o LIMIT 1) AS category, 1.0 AS confidence"""
