"""DuckDB SQL of the insight folds and texts: J3, J4, J5, J8 and the round trip of S10."""

from __future__ import annotations

from bizlens.operators.insight import REASONING_PHRASES

_FIELDS = ("type", "insight", "features", "strength", "business_impact", "confidence", "score")
#: One contains the other, or they share more than three words
_SIMILAR = ("contains(lower(e.insight), lower(x.insight)) OR contains(lower(x.insight), lower(e.insight)) OR "
            "len(list_intersect(list_distinct(string_split(lower(x.insight), ' ')), "
            "list_distinct(string_split(lower(e.insight), ' ')))) > 3")


def _two(x: str) -> str:
    """Two decimals, ties away from zero."""
    return f"printf('%.2f', CAST(round(CAST({x} AS DECIMAL(18, 4)), 2) AS DOUBLE))"


def _merged(j2: str) -> str:
    return f"""(WITH RECURSIVE it AS (
      SELECT region, row_number() OVER (PARTITION BY region ORDER BY first_rank) AS k,
        struct_pack({", ".join(f"{c} := {c}" for c in _FIELDS)}) AS x FROM ({j2}) j2),
    fold AS (
      SELECT region, k, [x] AS m FROM it WHERE k = 1
      UNION ALL
      SELECT region, k, CASE WHEN p = 0 THEN list_append(m, x)
        WHEN x.score > m[p].score THEN list_concat(list_append(m[1:p - 1], x), m[p + 1:len(m)]) ELSE m END
      FROM (SELECT f.region, it.k, f.m, it.x,
              coalesce(list_position(list_transform(f.m, lambda e: {_SIMILAR.replace('x.', 'it.x.')}), true), 0) AS p
            FROM fold f JOIN it ON it.region = f.region AND it.k = f.k + 1) s),
    whole AS (SELECT region, m FROM fold QUALIFY row_number() OVER (PARTITION BY region ORDER BY k DESC) = 1),
    each AS (SELECT region, unnest(m) AS r, unnest(range(len(m))) AS pos FROM whole)
SELECT region, {", ".join(f"r.{c} AS {c}" for c in _FIELDS)},
    CAST(row_number() OVER (PARTITION BY region ORDER BY r.score DESC, pos) AS INTEGER) AS rank FROM each)"""


def _first_five(items: str) -> str:
    """The first five distinct, non-null entries of a list."""
    kept = f"list_filter({items}, lambda x: x IS NOT NULL)"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)[1:5]"


def _reasons(sql: dict[str, str], view: str) -> str:
    columns = ("date", "segment", "product", "customer", "revenue", "expenses", "quantity")
    phrases = "[" + ", ".join(f"'{p}'" for p in REASONING_PHRASES) + "]"
    return f"""(WITH ins AS (SELECT region, list(insight ORDER BY rank) AS ins FROM {_merged(sql["J2"])} j3
        WHERE rank <= 5 GROUP BY region),
    p AS (SELECT region, feature_1, feature_2, correlation FROM ({sql["R2"]}) r2 WHERE rank = 1),
    f AS (SELECT region, feature FROM ({sql["R3"]}) r3 WHERE rank = 1),
    t AS (SELECT region, list(struct_pack(c := "column", t := trend) ORDER BY CASE "column" WHEN 'quantity' THEN 0
        WHEN 'revenue' THEN 1 ELSE 2 END) AS tr FROM ({sql["T1"]}) t1 GROUP BY region),
    q AS (SELECT region, sum(n) - count(*) AS duplicates, sum(n * nulls) AS missing FROM (
        SELECT {", ".join(columns)}, region, count(*) AS n,
          {" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in columns)} AS nulls FROM {view} v GROUP BY ALL) d GROUP BY region),
    j AS (SELECT region, ins, feature_1, feature_2, correlation, feature, coalesce(tr, []) AS tr, missing, duplicates
        FROM ins LEFT JOIN p USING (region) LEFT JOIN f USING (region) LEFT JOIN t USING (region) LEFT JOIN q USING (region)),
    l AS (SELECT region, list_concat(list_transform(ins, lambda s, i: {phrases}[(i - 1) % 3 + 1] || lower(s)
            || ', which impacts revenue.'),
          ['There is a measurable relationship between ' || feature_1 || ' and ' || feature_2 || ' (correlation: '
             || {_two("correlation")} || '), meaning changes in ' || feature_1 || ' directly influence ' || feature_2 || '.',
           feature || ' is a major driver of revenue, making it a high-impact optimization variable.'],
          list_transform(tr, lambda e: CASE WHEN e.t = 'increasing' THEN e.c || ' shows an upward trend indicating growth momentum.'
             WHEN e.t = 'decreasing' THEN e.c || ' is declining, indicating potential performance risk.' END)) AS blocks,
        list_concat(list_transform(list_filter(ins, lambda s: contains(lower(s), 'increase') OR contains(lower(s), 'positive')),
             lambda s: 'Leverage this positive driver to improve revenue.'),
          ['Improving ' || feature_1 || ' can significantly enhance ' || feature_2 || ' performance.',
           'Prioritize optimization of ' || feature || ' to improve revenue.'],
          list_transform(tr, lambda e: CASE WHEN e.t = 'increasing'
             THEN 'Capitalize on increasing ' || e.c || ' to scale performance.' END)) AS opps,
        list_concat(list_transform(list_filter(ins, lambda s: contains(lower(s), 'decrease') OR contains(lower(s), 'negative')),
             lambda s: 'Decline in this area could negatively affect revenue.'),
          list_transform(tr, lambda e: CASE WHEN e.t = 'decreasing'
             THEN 'Declining ' || e.c || ' may negatively affect business outcomes.' END),
          [CASE WHEN missing > 0 THEN 'Data quality issues detected (missing values present), which may reduce accuracy.' END,
           CASE WHEN duplicates > 0 THEN 'Duplicate records detected, which may distort analytical insights.' END]) AS risks
      FROM j)
SELECT region, array_to_string(list_filter(blocks, lambda x: x IS NOT NULL), ' ') AS reasoning,
    {_first_five("opps")} AS opportunities, {_first_five("risks")} AS risks FROM l)"""


def _recommendations(sql: dict[str, str], view: str) -> str:
    return f"""WITH rs AS (SELECT * FROM {_reasons(sql, view)} j4),
    p AS (SELECT region, 'high' AS priority, 'Increase focus on optimizing ' || feature_1 AS action,
        feature_1 || ' strongly influences ' || feature_2 || ' (correlation: ' || {_two("correlation")} || ')' AS reason,
        'Direct improvement in revenue' AS impact, 0 AS o, 0 AS i FROM ({sql["R2"]}) r2 WHERE rank = 1),
    f AS (SELECT region, 'high', 'Prioritize improvement of ' || feature, feature || ' is a strong driver of revenue',
        'Significant uplift in revenue', 1, 0 FROM ({sql["R3"]}) r3 WHERE feature <> 'revenue'
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY importance DESC, rank) = 1),
    t AS (SELECT region, CASE trend WHEN 'increasing' THEN 'medium' ELSE 'high' END,
        CASE trend WHEN 'increasing' THEN 'Scale initiatives related to ' ELSE 'Investigate and reverse decline in ' END || "column",
        "column" || CASE trend WHEN 'increasing' THEN ' is trending upward' ELSE ' is trending downward' END,
        CASE trend WHEN 'increasing' THEN 'Opportunity for growth' ELSE 'Prevent performance loss' END, 2,
        CASE "column" WHEN 'quantity' THEN 0 WHEN 'revenue' THEN 1 ELSE 2 END
      FROM ({sql["T1"]}) t1 WHERE trend IN ('increasing', 'decreasing')),
    o AS (SELECT region, 'medium', x, 'Derived from AI reasoning', 'Potential performance improvement', 3, i
      FROM (SELECT region, unnest(opportunities[1:3]) AS x, unnest(range(len(opportunities[1:3]))) AS i FROM rs) a),
    r AS (SELECT region, 'high', 'Mitigate risk: ' || x, 'Identified risk from AI reasoning', 'Prevent negative outcomes', 4, i
      FROM (SELECT region, unnest(risks[1:3]) AS x, unnest(range(len(risks[1:3]))) AS i FROM rs) a),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM o UNION ALL SELECT * FROM r),
    d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY region, action, reason ORDER BY o, i) = 1)
SELECT region, priority, action, reason, impact, CAST(row_number() OVER (PARTITION BY region
    ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, o, i) AS INTEGER) AS rank
FROM d QUALIFY rank <= 7"""


def _observations(sql: dict[str, str], projection: str) -> str:
    return f"""WITH d AS (SELECT k15.*, k1.marketing_roi FROM ({sql["K15"]}) k15 JOIN ({sql["K1"]}) k1 USING (region)),
    dr AS (SELECT region, driver, relationship_strength, correlation AS c FROM ({sql["R4"]}) r4 WHERE rank = 1),
    la AS (SELECT region, arg_max(projected_revenue, step) AS last_projection, max(period) AS last_period,
        CASE WHEN max(revenue_slope) < -50 THEN 'downward trajectory' WHEN max(revenue_slope) > 50 THEN 'upward acceleration'
             ELSE 'stable / horizontal' END AS trend FROM {projection} lt GROUP BY region),
    j AS (SELECT region, coalesce(revenue_growth, 0.0) AS g, coalesce(net_profit_margin, 0.0) AS m, gross_margin AS gm,
        coalesce(churn_rate, 0.0) AS ch, driver, relationship_strength, c, last_projection, last_period, trend, marketing_roi AS roi
      FROM d LEFT JOIN dr USING (region) LEFT JOIN la USING (region)),
    l AS (SELECT region, list_filter([
        CASE WHEN g > 5 AND m > 15 THEN 'Strong operational expansion: Revenue expanded by ' || {_two("g")}
               || '% while sustaining high net profit margins of ' || {_two("m")} || '%.'
             WHEN g > 5 AND m <= 5 THEN 'Revenue is expanding (+' || {_two("g")} || '%), but net profit margin remains constrained at '
               || {_two("m")} || '%, indicating operational cost pressures.'
             WHEN g < 0 THEN 'Revenue contracted by ' || {_two("abs(g)")} || '% over the evaluated timeframe with a net margin profile of '
               || {_two("m")} || '%.'
             ELSE 'Revenue growth remains stable at ' || {_two("g")} || '% with a net margin of ' || {_two("m")} || '%'
               || CASE WHEN gm IS NULL THEN '' ELSE ' and gross margin of ' || {_two("gm")} || '%' END || '.' END,
        CASE WHEN ch > 10 THEN 'Elevated customer churn risk: Churn rate is currently elevated at ' || {_two("ch")}
               || '%, requiring customer retention focus.'
             WHEN ch > 0 THEN 'Customer retention is healthy with a churn rate controlled at ' || {_two("ch")} || '%.' END,
        'Primary revenue driver identified: ''' || driver || ''' shows a ' || lower(relationship_strength)
          || ' correlation score of ' || {_two("c")} || ' with top-line income.',
        'Forecasting models indicate a ' || trend || ' trajectory, projecting revenue to reach $'
          || format('{{:,.2f}}', last_projection) || ' by ' || last_period || '.',
        CASE WHEN roi > 3 THEN 'Marketing efficiency is high, generating $' || {_two("roi")} || ' in revenue per dollar spent ('
               || {_two("roi")} || 'x ROI).'
             WHEN roi > 0 THEN 'Marketing ROI stands at ' || {_two("roi")}
               || 'x, suggesting opportunity for acquisition channel optimization.' END], lambda x: x IS NOT NULL) AS o FROM j)
SELECT region, CAST(unnest(range(len(o))) AS INTEGER) AS ordinal, unnest(o) AS observation FROM l"""


def insight_sql(sql: dict[str, str], view: str, projection: str) -> dict[str, str]:
    """``sql``: the texts registered so far; ``view``: the business view; ``projection``: the monthly trend forecast."""
    return {"J3": f"SELECT * FROM {_merged(sql['J2'])} j3", "J4": f"SELECT * FROM {_reasons(sql, view)} j4",
            "J5": _recommendations(sql, view), "J8": _observations(sql, projection), "S10_fields": sql["K1"]}
