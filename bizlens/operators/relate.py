"""Correlations, drivers and trends.

Correlations are built from covariance / variance aggregates (Welford
updates inside Spark, numerically stable) over pairwise-complete rows, with
``try_divide`` so a constant column gives NULL instead of an ANSI error.
All pairs share one aggregate per group (chunked for wide tables). Trends use a range-partitioned
global row number, so no series is ever sorted inside a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import datetime_columns, finite, numeric_columns, q
from bizlens.operators.schema import priority_score
from bizlens.plans.order import global_row_number

# R5 keywords of business-important metrics.
PAIR_KEYWORDS = ["revenue", "sales", "profit", "income", "purchase", "conversion", "score", "spend"]


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _id_like(name: str) -> bool:
    n = name.lower()
    return n == "id" or n.endswith("_id") or n.startswith("id_") or n.endswith("key")


def analysis_columns(df: DataFrame, by: Sequence[str] = (), *, exclude_ids: bool = True) -> list[str]:
    cols = numeric_columns(df, exclude=by)
    return [c for c in cols if not (exclude_ids and _id_like(c))]


def _pair_r(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    ap, bp = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(ap, bp), F.sqrt(F.var_pop(ap) * F.var_pop(bp)))


def correlation_pairs(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                      exclude_ids: bool = True, chunk: int = 200) -> DataFrame:
    """R1 in long form: (by..., feature_1, feature_2, ordinal, r) for every pair
    in column order; r is NULL when undefined (constant or < 2 rows).

    All pairs of a chunk share one aggregate; wide tables (k (k-1) / 2 pairs)
    are split into chunks of ``chunk`` pairs so no generated aggregate grows
    without bound; the chunks are unioned."""
    cols = list(columns) if columns is not None else analysis_columns(df, by, exclude_ids=exclude_ids)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        raise ValueError("need at least two numeric columns")
    vals = {c: finite(F.col(q(c))) for c in cols}
    out = None
    for start in range(0, len(pairs), chunk):
        part = list(enumerate(pairs))[start:start + chunk]
        g = df.groupBy(*_b(by)).agg(*[_pair_r(vals[cols[i]], vals[cols[j]]).alias(f"p{k}") for k, (i, j) in part])
        structs = [F.struct(F.lit(cols[i]).alias("feature_1"), F.lit(cols[j]).alias("feature_2"),
                            F.lit(k).alias("ordinal"), F.col(f"p{k}").alias("r")) for k, (i, j) in part]
        piece = g.select(*_b(by), F.inline(F.array(*structs)))
        out = piece if out is None else out.unionByName(piece)
    return out


def correlation_matrix(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                       places: int = 4, exclude_ids: bool = True) -> DataFrame:
    """R1 as a matrix in long form (both orders and the diagonal); undefined -> 0."""
    cols = list(columns) if columns is not None else analysis_columns(df, by, exclude_ids=exclude_ids)
    p = correlation_pairs(df, by=by, columns=cols)
    r = F.round(F.coalesce(F.col("r"), F.lit(0.0)), places)
    upper = p.select(*_b(by), F.col("feature_1").alias("row"), F.col("feature_2").alias("col"), r.alias("r"))
    lower = p.select(*_b(by), F.col("feature_2").alias("row"), F.col("feature_1").alias("col"), r.alias("r"))
    diag_src = p.select(*_b(by)).distinct() if by else None
    diag_rows = F.explode(F.array(*[F.lit(c) for c in cols]))
    diag = (diag_src if diag_src is not None else df.sparkSession.range(1).select()).select(
        *_b(by), diag_rows.alias("row")).withColumn("col", F.col("row")).withColumn("r", F.lit(1.0))
    return upper.unionByName(lower).unionByName(diag)


def ranked_pairs(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                 k: int = 10, substring: bool = False) -> DataFrame:
    """R2: |r| to 4 places, strength band, business score = 1000|r| + name scores; top k."""
    cols = list(columns) if columns is not None else analysis_columns(df, by)
    p = correlation_pairs(df, by=by, columns=cols).filter(F.col("r").isNotNull() & ~F.isnan("r"))
    scores = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(priority_score(c, substring=substring)))])
    a = F.abs(F.col("r"))
    p = p.select(*_b(by), "feature_1", "feature_2", "ordinal", F.col("r"),
                 F.round(a, 4).alias("correlation"),
                 F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").otherwise("weak").alias("strength"),
                 F.round(a * 1000 + scores[F.col("feature_1")] + scores[F.col("feature_2")], 2).alias("business_score"))
    w = Window.partitionBy(*_b(by)).orderBy(F.desc("business_score"), F.asc("ordinal"))
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def feature_importance(df: DataFrame, target: str, *, by: Sequence[str] = (),
                       columns: Sequence[str] | None = None) -> DataFrame:
    """|r| of every numeric column with the target, to 4 places, ranked."""
    cols = list(columns) if columns is not None else analysis_columns(df, by)
    others = [c for c in cols if c != target]
    t = finite(F.col(q(target)))
    g = df.groupBy(*_b(by)).agg(*[_pair_r(finite(F.col(q(c))), t).alias(f"i{n}") for n, c in enumerate(others)])
    long = g.select(*_b(by), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(n).alias("ordinal"),
                                                         F.col(f"i{n}").alias("r"))
                                                for n, c in enumerate(others)])))
    long = long.filter(F.col("r").isNotNull() & ~F.isnan("r")).withColumn("importance", F.round(F.abs("r"), 4))
    w = Window.partitionBy(*_b(by)).orderBy(F.desc("importance"), F.asc("ordinal"))
    return long.withColumn("rank", F.row_number().over(w)).drop("r")


def driver_analysis(df: DataFrame, target: str, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                    k: int = 5) -> DataFrame:
    """Top-k drivers of the target by |r| (matrix rounded to 3 places, zero-variance
    columns dropped), with relationship band, impact and confidence."""
    cols = list(columns) if columns is not None else analysis_columns(df, by)
    others = [c for c in cols if c != target]
    t = finite(F.col(q(target)))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for n, c in enumerate(others):
        v = finite(F.col(q(c)))
        aggs += [_pair_r(v, t).alias(f"r{n}"), F.stddev_samp(v).alias(f"s{n}")]
    g = df.groupBy(*_b(by)).agg(*aggs)
    long = g.select(*_b(by), "_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("driver"), F.lit(n).alias("ordinal"), F.col(f"r{n}").alias("r"),
                 F.col(f"s{n}").alias("sd")) for n, c in enumerate(others)])))
    long = long.filter(F.col("sd") > 0)
    r3 = F.coalesce(F.round(F.col("r"), 3), F.lit(0.0))
    long = long.withColumn("correlation", r3)
    w = Window.partitionBy(*_b(by)).orderBy(F.desc(F.abs("correlation")), F.asc("ordinal"))
    c = F.col("correlation")
    band = (F.when(c > 0.7, "Strong Positive").when(c > 0.3, "Moderate Positive")
            .when(c < -0.7, "Strong Negative").when(c < -0.3, "Moderate Negative").otherwise("Weak/Neutral"))
    impact = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * c * 100.0)), 1)
    conf = F.round(F.least(F.lit(99.0), F.greatest(F.lit(20.0), F.abs(c) * 70.0 +
                                                    F.least(F.lit(30.0), F.col("_n") * 0.5))), 1)
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*_b(by), "driver", "rank", F.round(c, 2).alias("correlation"),
                    band.alias("relationship_strength"), impact.alias("impact_score"), conf.alias("confidence")))


def best_correlation(pairs: DataFrame, *, kpi: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """First ranked pair with the KPI, else both names business-like, else the first."""
    f1, f2 = F.lower("feature_1"), F.lower("feature_2")
    kw = lambda c: F.exists(F.array(*[F.lit(k) for k in PAIR_KEYWORDS]), lambda x: F.contains(c, x))
    tier = (F.when(F.lit(kpi is not None) & ((f1 == F.lit((kpi or "").lower())) | (f2 == F.lit((kpi or "").lower()))), 0)
            .when(kw(f1) & kw(f2), 1).otherwise(2))
    w = Window.partitionBy(*_b(by)).orderBy(tier, F.col("rank"))
    return pairs.withColumn("_pick", F.row_number().over(w)).filter(F.col("_pick") == 1).drop("_pick")


def recommended_kpi(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric column with the highest (name score, |mean|)."""
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    g = df.groupBy(*_b(by)).agg(*[F.avg(finite(F.col(q(c)))).alias(f"m{n}") for n, c in enumerate(cols)])
    key = lambda n, c: F.struct(F.lit(priority_score(c)).alias("s"),
                                F.coalesce(F.abs(F.col(f"m{n}")), F.lit(-1.0)).alias("a"), F.lit(-n).alias("o"))
    long = g.select(*_b(by), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), key(n, c).alias("k"))
                                               for n, c in enumerate(cols)])))
    return long.groupBy(*_b(by)).agg(F.max_by("column", "k").alias("recommended_kpi"))


def regression_line(df: DataFrame, x: str, y: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope / intercept / r2 over complete pairs (>= 2 rows)."""
    xv, yv = finite(F.col(q(x))), finite(F.col(q(y)))
    n = F.regr_count(yv, xv)
    return df.groupBy(*_b(by)).agg(
        n.alias("points"), F.when(n >= 2, F.regr_slope(yv, xv)).alias("slope"),
        F.when(n >= 2, F.regr_intercept(yv, xv)).alias("intercept"),
        F.when(n >= 2, F.regr_r2(yv, xv)).alias("r2"))


def trends(df: DataFrame, *, time_col: str | None = None, by: Sequence[str] = (),
           columns: Sequence[str] | None = None, tie_break: Sequence[str] = (),
           min_points: int = 6) -> DataFrame:
    """Slope of each numeric column against its row number in time order.

    Rows with a NULL time or value are dropped per column. The long form
    (by, column, ts, value) gets a global row number from a range-partitioned
    sort; the slope against it equals the slope against 0..n-1 inside each
    group (a group's rows are contiguous), so the final step is a plain
    grouped ``regr_slope`` - no per-group window, no hot task.
    """
    tcol = time_col or (datetime_columns(df) or [None])[0]
    if tcol is None:
        raise ValueError("no datetime column")
    cols = list(columns) if columns is not None else analysis_columns(df, by)
    cols = [c for c in cols if c != tcol]
    extra = [c for c in tie_break if c not in by and c != tcol and c not in cols]
    sel = [*_b(by), F.col(q(tcol)).alias("__ts"), *[F.col(q(c)).alias(f"__t{i}") for i, c in enumerate(extra)],
           *[finite(F.col(q(c))).alias(c) for c in cols]]
    tie_cols = [f"__t{i}" for i in range(len(extra))]
    long = (df.select(*sel).unpivot([*by, "__ts", *tie_cols], cols, "column", "value")
            .filter(F.col("__ts").isNotNull() & F.col("value").isNotNull()))
    ranked = global_row_number(long, [*by, "column", "__ts", *tie_cols, "value"], name="__rn")
    x = F.col("__rn").cast("double")
    g = ranked.groupBy(*_b(by), "column").agg(F.count(F.lit(1)).alias("points"),
                                              F.regr_slope(F.col("value"), x).alias("_slope"))
    g = g.filter(F.col("points") >= min_points)
    s = F.coalesce(F.col("_slope"), F.lit(0.0))
    return g.select(*_b(by), "column", F.when(s > 0, "increasing").when(s < 0, "decreasing").otherwise("stable")
                    .alias("trend"), F.round(s, 6).alias("slope"), "points")


# Words of preferred category columns.
CATEGORY_WORDS = ("segment", "category", "region", "department", "gender", "group", "channel", "type")


def best_category(profile: DataFrame, columns: Sequence[str], *, preferred: Sequence[str] = CATEGORY_WORDS) -> DataFrame:
    """Categorical column with 2-12 distinct values (from P2 rows): the first in
    the order of ``columns`` whose name holds a preferred word, else the first."""
    hit = F.exists(F.array(*[F.lit(p) for p in preferred]), lambda p: F.contains(F.lower("column"), p))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    cand = profile.filter((F.col("unique_values") >= 2) & (F.col("unique_values") <= 12) & ~F.col("is_numeric")
                          & ~F.col("is_datetime"))
    return cand.orderBy(F.desc(hit.cast("int")), place).limit(1).select("column", "unique_values")


def kpi_by_segment(df: DataFrame, kpi: str, segment: str, *, k: int = 10) -> DataFrame:
    """Mean KPI per segment, top k (TakeOrderedAndProject)."""
    return (df.groupBy(F.col(q(segment)).alias("segment")).agg(F.avg(finite(F.col(q(kpi)))).alias("mean_value"))
            .orderBy(F.desc("mean_value"), F.asc("segment")).limit(k))


def kpi_over_time(df: DataFrame, kpi: str, time_col: str, *, by: Sequence[str] = ()) -> DataFrame:
    """T4: mean KPI per timestamp (sorting happens only at the sink)."""
    return (df.filter(F.col(q(time_col)).isNotNull()).groupBy(*_b(by), F.col(q(time_col)).alias("ts"))
            .agg(F.avg(finite(F.col(q(kpi)))).alias("mean_value")))


def monthly_rollup(df: DataFrame, date: str, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                   fill_empty: bool = True) -> DataFrame:
    """T5: sum of each numeric column per calendar month; months without rows
    between a group's first and last month are present with 0."""
    cols = list(columns) if columns is not None else [c for c in numeric_columns(df, exclude=by) if c != date]
    m = F.date_trunc("month", F.col(q(date))).cast("date")
    sums = (df.filter(F.col(q(date)).isNotNull()).groupBy(*_b(by), m.alias("month"))
            .agg(*[F.sum(finite(F.col(q(c)))).alias(c) for c in cols]))
    if not fill_empty:
        return sums
    span = sums.groupBy(*_b(by)).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    cal = span.select(*_b(by), F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("month"))
    keys = [*by, "month"]
    return cal.join(sums, keys, "left").select(*_b(by), "month", *[F.coalesce(F.col(q(c)), F.lit(0.0)).alias(c)
                                                                    for c in cols])


def top_by_sum(df: DataFrame, key: str, value: str, *, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Top k keys by summed value, per group."""
    g = df.groupBy(*_b(by), F.col(q(key)).alias("key")).agg(F.sum(finite(F.col(q(value)))).alias("total"))
    w = Window.partitionBy(*_b(by)).orderBy(F.desc("total"), F.asc("key"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
