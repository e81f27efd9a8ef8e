"""DuckDB SQL of the series, forecasting and streaming queries added to ``oracle``:
structure and frequency detection, seasonal ARIMA, tenant models, payments, horizons."""

from __future__ import annotations

from bizlens.functions.linalg import normal_sql, products_sql
from bizlens.operators.series import (GAP_RULES, HORIZON_LABELS, MONTHS, POSITION_NAMES, WEEKDAYS, horizon_periods)
from bizlens.plans.tenancy import SUBSCRIPTIONS_SQL
from bizlens.plans.views import BV_SQL, TEXT_SQL


def _named(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in pairs)


def _all_there(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def arima_sql(src: str, horizon: int, *, season: int = 12, z: float = 1.282) -> str:
    """(region, step, forecast, lower_bound, upper_bound) of every series of ``src`` (region, ts, y)
    that is long enough for both regressions."""
    s = season
    one = ["d1", "d2", "ds", "ds1"]
    two = ["d1", "ds", "ds1", "e1"]
    zeros = "[" + ", ".join(["0.0"] * s) + ", 1.0]::DOUBLE[]"
    w = "WINDOW w AS (PARTITION BY region ORDER BY ts)"
    run = (f"ys[-1] + ys[-{s}] - ys[-{s + 1}] + ar * ds[-1] + sar * ds[-{s}] + mix * ds[-{s + 1}]"
           " + CASE WHEN step = 0 THEN ma * last_e ELSE 0.0 END")
    new = f"ar * ds[-1] + sar * ds[-{s}] + mix * ds[-{s + 1}] + CASE WHEN step = 0 THEN ma * last_e ELSE 0.0 END"
    psi = f"ar * qs[-1] + sar * qs[-{s}] + mix * qs[-{s + 1}] + CASE WHEN step = 0 THEN ma ELSE 0.0 END"
    return f"""(WITH RECURSIVE x0 AS (SELECT region, ts, y, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY region) AS n,
        y - lag(y, 1) OVER w - lag(y, {s}) OVER w + lag(y, {s + 1}) OVER w AS d FROM {src} src {w}),
    x1 AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, {s}) OVER w AS ds, lag(d, {s + 1}) OVER w AS ds1 FROM x0 {w}),
    p1 AS (SELECT region, {_named(products_sql(one, 'd', tag='p'))} FROM x1 WHERE {_all_there(['d', *one])} GROUP BY region),
    c1 AS (SELECT region, {_named(normal_sql(4, ['f1', 'f2', 'fs', 'fs1'], tag='p'))} FROM p1),
    x2 AS (SELECT x1.*, d - (f1 * d1 + f2 * d2 + fs * ds + fs1 * ds1) AS e FROM x1 JOIN c1 USING (region)),
    x3 AS (SELECT *, lag(e, 1) OVER w AS e1 FROM x2 {w}),
    p2 AS (SELECT region, {_named(products_sql(two, 'd', tag='p'))}, count(*) AS n_obs FROM x3 WHERE {_all_there(['d', *two])} GROUP BY region),
    c2 AS (SELECT region, n_obs, {_named(normal_sql(4, ['ar', 'sar', 'mix', 'ma'], tag='p'))} FROM p2),
    x4 AS (SELECT x3.*, c2.* EXCLUDE (region), d - (ar * d1 + sar * ds + mix * ds1 + ma * e1) AS r FROM x3 JOIN c2 USING (region)),
    m AS (SELECT region, any_value(ar) AS ar, any_value(sar) AS sar, any_value(mix) AS mix, any_value(ma) AS ma,
        sum(r * r) / greatest(1, any_value(n_obs) - 4) AS sigma2, max(CASE WHEN t = n - 1 THEN r END) AS last_e,
        list(y ORDER BY t) FILTER (t >= n - {s + 1}) AS ys, list(d ORDER BY t) FILTER (t >= n - {s + 1}) AS ds
        FROM x4 WHERE n_obs >= 8 GROUP BY region),
    rec(region, step, ar, sar, mix, ma, last_e, sigma2, ys, ds, ps, qs, var) AS (
        SELECT region, 0, ar, sar, mix, ma, last_e, sigma2, ys, ds, {zeros}, {zeros}, 0.0::DOUBLE FROM m
        UNION ALL
        SELECT region, step + 1, ar, sar, mix, ma, last_e, sigma2, list_append(ys, {run}), list_append(ds, {new}),
            list_append(ps, ps[-1] + ps[-{s}] - ps[-{s + 1}] + {psi}), list_append(qs, {psi}), var + ps[-1] * ps[-1]
        FROM rec WHERE step < {horizon})
SELECT region, CAST(step AS INTEGER) AS step, ys[-1] AS forecast, ys[-1] - {z} * sqrt(var * sigma2) AS lower_bound,
    ys[-1] + {z} * sqrt(var * sigma2) AS upper_bound FROM rec WHERE step > 0)"""


def _gap_rule(m: str) -> str:
    out = f"CASE WHEN {m} IS NULL THEN 'D'"
    for lo, hi, name in GAP_RULES:
        out += f" WHEN {m} <= {hi}" + (f" AND {m} >= {lo}" if lo is not None else "") + f" THEN '{name}'"
    return out + " ELSE 'D' END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def infer_sql(src: str, key: str) -> str:
    """(key, median_gap_days, inferred) for the dates ``ts`` of every ``key`` of ``src``."""
    day = 86_400_000_000

    def pick(kind: str) -> str:
        return "CASE pos " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_NAMES[kind].items()) + " END"

    def named(base: str, step: str) -> str:
        return f"(CASE WHEN {step} = 1 THEN '' ELSE CAST(CAST({step} AS BIGINT) AS VARCHAR) END || {base})"

    fine = " ".join(f"WHEN g0 = g1 AND g0 % {size} = 0 THEN {named(chr(39) + name + chr(39), f'g0 // {size}')}"
                    for name, size in (("h", day // 24), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1)))
    return f"""(WITH r AS (SELECT {key}, ts, lag(ts) OVER (PARTITION BY {key} ORDER BY ts) AS p FROM {src} src0),
    q AS (SELECT *, epoch_us(ts) - epoch_us(p) AS gap, date_diff('day', CAST(p AS DATE), CAST(ts AS DATE)) AS days,
        year(ts) * 12 + month(ts) - year(p) * 12 - month(p) AS mgap, year(ts) - year(p) AS ygap, day(ts) AS dom,
        date_diff('day', CAST(ts AS DATE), last_day(CAST(ts AS DATE))) AS left_, isodow(ts) - 1 AS wd, isodow(p) - 1 AS pwd FROM r),
    g AS (SELECT {key}, count(ts) AS n, min(ts) AS f, CAST(median(days) AS DOUBLE) AS median_gap_days, min(gap) AS g0, max(gap) AS g1,
        min(mgap) AS m0, max(mgap) AS m1, min(ygap) AS y0, max(ygap) AS y1, min(month(ts)) AS month0, max(month(ts)) AS month1,
        CASE WHEN bool_and(left_ = 0) THEN 'ce' WHEN bool_and(left_ = 0 OR (left_ < 3 AND wd = 4)) THEN 'be'
             WHEN bool_and(dom = 1) THEN 'cs' WHEN bool_and(dom = 1 OR (dom <= 3 AND wd = 0)) THEN 'bs' END AS pos,
        bool_and(p IS NULL OR (pwd = 4 AND days = 3) OR (pwd < 4 AND days = 1)) AND bool_or(days = 3) AND bool_or(days = 1) AS business,
        min(wd) AS wd0, max(wd) AS wd1, min(CASE WHEN (dom - 1) // 7 < 4 THEN (dom - 1) // 7 END) AS wk0,
        max(CASE WHEN (dom - 1) // 7 < 4 THEN (dom - 1) // 7 END) AS wk1 FROM q GROUP BY {key})
SELECT {key}, median_gap_days, CASE WHEN n < 3 OR g0 <= 0 THEN NULL WHEN g0 % {day} = 0 THEN CASE
    WHEN y0 = y1 AND y0 > 0 AND month0 = month1 AND pos IS NOT NULL THEN {named(f"{pick('Y')} || '-' || {_list(MONTHS)}[month(f)]", 'y0')}
    WHEN m0 = m1 AND m0 > 0 AND pos IS NOT NULL AND m0 % 3 = 0
        THEN {named(f"{pick('Q')} || '-' || {_list(['DEC', 'OCT', 'NOV'])}[month(f) % 3 + 1]", 'm0 // 3')}
    WHEN m0 = m1 AND m0 > 0 AND pos IS NOT NULL THEN {named(pick('M'), 'm0')}
    WHEN g0 = g1 AND (g0 // {day}) % 7 = 0 THEN {named(f"'W-' || {_list(WEEKDAYS)}[isodow(f)]", f'g0 // {day} // 7')}
    WHEN g0 = g1 THEN {named("'D'", f'g0 // {day}')} WHEN business THEN 'B'
    WHEN wd0 = wd1 AND wk0 = wk1 THEN 'WOM-' || CAST(wk0 + 1 AS VARCHAR) || {_list(WEEKDAYS)}[wd0 + 1] END
    ELSE CASE {fine} END END AS inferred FROM g)"""


#: Dates of the given orders on different lattices (the Spark side is ``catalog._lattices``).
LATTICES_SQL = """(WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders), s AS (SELECT min(d) AS a, max(d) AS z FROM o),
    days AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS t FROM s)
SELECT 'month_start' AS kind, CAST(date_trunc('month', d) AS TIMESTAMP) AS ts FROM o GROUP BY ALL
UNION ALL SELECT 'month_end', CAST(last_day(CAST(d AS DATE)) AS TIMESTAMP) FROM o GROUP BY ALL
UNION ALL SELECT 'quarter', CAST(date_trunc('quarter', d) AS TIMESTAMP) FROM o GROUP BY ALL
UNION ALL SELECT 'year', CAST(date_trunc('year', d) AS TIMESTAMP) FROM o GROUP BY ALL
UNION ALL SELECT 'week', CAST(date_trunc('week', d) AS TIMESTAMP) FROM o GROUP BY ALL
UNION ALL SELECT 'day', t FROM days
UNION ALL SELECT 'business', t FROM days WHERE isodow(t) < 6
UNION ALL SELECT 'third_monday', t FROM days WHERE isodow(t) = 1 AND day(t) BETWEEN 15 AND 21
UNION ALL SELECT 'two_weeks', t FROM days WHERE date_diff('day', (SELECT a FROM s), t) % 14 = 0
UNION ALL SELECT 'half_day', t + to_hours(12 * h) FROM days, (SELECT unnest([0, 1]) AS h) hh
UNION ALL SELECT 'irregular', d FROM o WHERE k % 97 = 0 GROUP BY ALL
UNION ALL SELECT 'repeated', d FROM o WHERE k % 50 = 0
UNION ALL SELECT 'two_dates', unnest([a, z]) FROM s)"""


def series_sql(monthly: str, daily: str, backtest: str, metrics) -> dict[str, str]:
    out = {}
    out["M7"] = f"""SELECT region, step, round(forecast, 0) AS forecast, round(lower_bound, 0) AS lower_bound,
        round(upper_bound, 0) AS upper_bound FROM {arima_sql(monthly, 12)} a"""
    train = f"""(SELECT region, ts, y FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS t,
        count(*) OVER (PARTITION BY region) AS n FROM {monthly} m0) m1 WHERE t < n - least(6, greatest(1, floor(n * 0.25))))"""
    tests = f"(SELECT region, ts, y, row_number() OVER (PARTITION BY region ORDER BY ts) AS step FROM {backtest} bt0 WHERE ordinal = 0)"
    four = f"""(SELECT region, model, ordinal, y, forecast FROM {backtest} bt1 UNION ALL
        SELECT te.region, 'seasonal_arima_12', 3, te.y, a.forecast FROM {tests} te JOIN {arima_sql(train, 6)} a USING (region, step))"""
    out["M11"] = f"""WITH m AS ({metrics("region, model, ordinal", four)})
SELECT region, model, CAST(ordinal AS INTEGER) AS ordinal, n, MAPE, RMSE, MAE, sMAPE, R2, MAX_ERROR,
    row_number() OVER (PARTITION BY region ORDER BY MAPE, ordinal) = 1 AS is_best FROM m"""
    out["V2_exact"] = f"""SELECT kind, median_gap_days, inferred, coalesce(inferred, {_gap_rule('median_gap_days')}) AS freq
        FROM {infer_sql(LATTICES_SQL, 'kind')} i"""
    labels = ", ".join(f"('{label}', {horizon_periods(label)})" for label in HORIZON_LABELS)
    out["V9"] = f"""SELECT region, label, CAST(periods AS INTEGER) AS periods, CAST(CAST(last AS DATE) + to_months(1) AS TIMESTAMP) AS first_ts,
        CAST(CAST(last AS DATE) + to_months(CAST(periods AS INTEGER)) AS TIMESTAMP) AS last_ts
        FROM (SELECT region, max(ts) AS last FROM {monthly} m0 GROUP BY region) l, (VALUES {labels}) h(label, periods)"""
    gap = """(SELECT CAST(median(floor((epoch_us(d) - epoch_us(p)) / 86400000000)) AS DOUBLE) AS m
        FROM (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM {src} s0) s1 WHERE p IS NOT NULL)"""
    mixed = f"(SELECT CASE WHEN regexp_matches(date_txt, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(date_txt AS TIMESTAMP) END AS d FROM {TEXT_SQL} t)"
    dates = f"(SELECT date AS d FROM {BV_SQL} v)"

    def structure(case: str, date: str, target: str, src: str) -> str:
        bad = f"(SELECT 1.0 - count(d) / count(*) FROM {src} s2)"
        rule = _gap_rule(gap.format(src=f"(SELECT d FROM {src} s3 WHERE d IS NOT NULL)"))
        return f"""SELECT '{case}' AS case_name, bad <= 0.30 AS is_valid_time_series, '{date}' AS date_column,
            CASE WHEN bad <= 0.30 THEN '{target}' END AS target_column, CASE WHEN bad <= 0.30 THEN {rule} END AS frequency,
            CASE WHEN bad <= 0.30 THEN (SELECT count(*) FROM {src} s4) END AS total_observations, round(bad, 4) AS bad_share,
            CASE WHEN bad > 0.30 THEN 'Column ''{date}'' has >30% unparseable date values.' END AS reason FROM (SELECT {bad} AS bad) b"""
    out["V1"] = " UNION ALL ".join([
        structure("mixed", "date_txt", "customer", mixed), structure("named", "date", "revenue", dates),
        structure("by_values", "iso_txt", "customer", dates),
        "SELECT 'none', false, NULL, NULL, NULL, NULL, NULL, 'No parseable datetime column identified.'"])
    x = ["x0", "x1", "x2", "x3"]
    names = ["intercept", "b_expenses", "b_dow", "b_month_no"]
    told = " + ".join(f"{c} * p{k}y" for k, c in enumerate(names))
    out["M23_update"] = f"""WITH d AS (SELECT region AS tenant, 1.0 AS x0, expenses AS x1, CAST(dayofweek(date) + 1 AS DOUBLE) AS x2,
            CAST(month(date) AS DOUBLE) AS x3, revenue AS y FROM {daily} d0),
        p AS (SELECT tenant, {_named(products_sql(x, 'y', tag='p'))}, sum(y * y) AS yy, count(*) AS n FROM d GROUP BY tenant),
        f AS (SELECT *, {_named(normal_sql(4, names, tag='p'))} FROM p)
    SELECT tenant, n, round(intercept, 1) AS intercept, round(b_expenses, 4) AS b_expenses, round(b_dow, 1) AS b_dow,
        round(b_month_no, 1) AS b_month_no, round(1.0 - (yy - ({told})) / (yy - p0y * p0y / n), 5) AS r2 FROM f"""
    out["W1"] = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS t
            FROM orders WHERE o_orderkey % 17 <> 0),
        wm AS (SELECT max(t) - INTERVAL 1 DAY AS w FROM o),
        e AS (SELECT user_tenant_id AS sub, k, t, s, plan, row_number() OVER (PARTITION BY user_tenant_id ORDER BY t, k) AS rn
            FROM o JOIN {SUBSCRIPTIONS_SQL} sb ON sb.tx_ref = 'tx-' || k, wm WHERE k % 19 <> 0 AND s IN ('F', 'P') AND t <= w),
        rec(sub, rn, k, t, status, plan, expiry, past_due, lapsed) AS (
            SELECT DISTINCT sub, CAST(0 AS BIGINT), NULL::BIGINT, NULL::TIMESTAMP, 'none', 'Starter', NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP FROM e
            UNION ALL
            SELECT sub, rn, k, t, CASE WHEN s = 'F' THEN 'active' ELSE 'past_due' END, CASE WHEN s = 'F' THEN paid ELSE plan0 END,
                CASE WHEN s = 'F' THEN (CASE WHEN st0 = 'active' THEN exp0 ELSE t END) + INTERVAL 30 DAY ELSE exp0 END,
                CASE WHEN s = 'F' THEN NULL WHEN st0 = 'past_due' THEN due0 ELSE t END, CASE WHEN late THEN due + INTERVAL 5 DAY END
            FROM (SELECT *, CASE WHEN over THEN 'none' ELSE status END AS st0, CASE WHEN over THEN 'Starter' ELSE plan END AS plan0,
                    CASE WHEN over THEN NULL ELSE expiry END AS exp0, CASE WHEN over THEN NULL ELSE due END AS due0
                FROM (SELECT r.sub, e.rn, e.k, e.t, e.s, e.plan AS paid, r.status, r.plan, r.expiry, r.past_due AS due,
                        r.status = 'past_due' AND r.past_due + INTERVAL 5 DAY <= e.t AS late,
                        (r.status = 'past_due' AND r.past_due + INTERVAL 5 DAY <= e.t) OR (r.status = 'active' AND r.expiry <= e.t) AS over
                    FROM rec r JOIN e ON e.sub = r.sub AND e.rn = r.rn + 1) z) y)
    SELECT CAST(sub AS INTEGER) AS subscription_id, t AS event_time, k AS transaction_id, status, plan, expiry FROM rec WHERE rn > 0
    UNION ALL SELECT CAST(sub AS INTEGER), lapsed, NULL, 'expired', 'Starter', NULL FROM rec WHERE lapsed IS NOT NULL
    UNION ALL SELECT CAST(sub AS INTEGER), past_due + INTERVAL 5 DAY, NULL, 'expired', 'Starter', NULL
        FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY rn DESC) AS back FROM rec) l, wm
        WHERE back = 1 AND status = 'past_due' AND past_due + INTERVAL 5 DAY <= w"""
    return out
