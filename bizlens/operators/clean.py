"""Cleaning operators D1-D14.

Fill statistics (median, mean, mode, first date) are one grouped aggregate
over every column at once, joined back on the group keys; the joined side
has one row per group, so the planner broadcasts it when it is small and
shuffles otherwise (AQE measures it). Order-dependent fills (D7, D9) take
an explicit ``order_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import datetime_columns, finite, null_safe_join, numeric_columns, q, string_columns
from bizlens.session import cut_lineage


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _join_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return null_safe_join(df, stats, list(by), "left") if by else df.crossJoin(stats)


# D1-D4 ---------------------------------------------------------------------

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row duplicates (NULL equals NULL)."""
    return df.dropDuplicates()


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """One count per column in a single job, then a projection."""
    counts = df.agg(*[F.count(F.col(q(c))).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c] > 0]
    return df.select(*[F.col(q(c)) for c in keep])


def drop_empty_rows(df: DataFrame, *, subset: Sequence[str] | None = None) -> DataFrame:
    """D3: rows where every column is NULL."""
    return df.dropna(how="all", subset=list(subset) if subset else None)


def drop_incomplete_rows(df: DataFrame, *, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with any NULL (``handle_missing='drop'``)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


# D5-D7 fills ----------------------------------------------------------------

def fill_numeric(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                 method: str = "median", approx: bool = False) -> DataFrame:
    """NULLs in numeric columns become the group median (default), mean or 0.

    Medians are exact at any size: they come from the counts of the values
    (``operators.values``), so no task holds the values of a group.
    """
    from bizlens.operators.values import finite_numbers, quantiles
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    if not cols:
        return df
    if method == "zero":
        return df.fillna(0, subset=cols)
    if method == "median" and not approx:
        counts, _ = finite_numbers(df, cols, by=by)
        med, _ = quantiles(counts, [0.5], by=by)
        stats = med.groupBy(*_b(by)).agg(*[F.max(F.when(F.col("c") == i, F.col("q0"))).alias(f"__fill_{i}")
                                           for i in range(len(cols))])
    else:
        stat = F.avg if method == "mean" else (lambda v: F.percentile_approx(v, 0.5, 100000).cast("double"))
        stats = df.groupBy(*_b(by)).agg(*[stat(finite(F.col(q(c)))).alias(f"__fill_{i}") for i, c in enumerate(cols)])
    j = _join_stats(df, stats, by)
    return j.select(*[F.coalesce(F.col(q(c)), F.col(f"__fill_{cols.index(c)}")).cast(df.schema[c].dataType).alias(c)
                      if c in cols else F.col(q(c)) for c in df.columns])


def fill_categorical(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                     default: str = "unknown") -> DataFrame:
    """NULLs become the group mode (smallest among ties), else ``default``."""
    cols = list(columns) if columns is not None else string_columns(df, exclude=by)
    if not cols:
        return df
    from bizlens.operators.values import modes, value_counts
    found = modes(value_counts(df, cols, by=by), by=by)
    stats = found.groupBy(*_b(by)).agg(*[F.max(F.when(F.col("c") == i, F.col("mode"))).alias(f"__mode_{i}")
                                         for i in range(len(cols))])
    j = _join_stats(df, stats, by)
    return j.select(*[F.coalesce(F.col(q(c)), F.col(f"__mode_{cols.index(c)}"), F.lit(default)).alias(c)
                      if c in cols else F.col(q(c)) for c in df.columns])


def fill_datetime(df: DataFrame, *, order_by: Sequence[str], by: Sequence[str] = (),
                  columns: Sequence[str] | None = None) -> DataFrame:
    """NULL dates become the first non-NULL date in row order."""
    cols = list(columns) if columns is not None else datetime_columns(df, exclude=by)
    if not cols:
        return df
    okey = F.struct(*[F.col(q(c)) for c in order_by])
    stats = df.groupBy(*_b(by)).agg(*[F.min_by(F.col(q(c)), F.when(F.col(q(c)).isNotNull(), okey))
                                      .alias(f"__first_{i}") for i, c in enumerate(cols)])
    j = _join_stats(df, stats, by)
    return j.select(*[F.coalesce(F.col(q(c)), F.col(f"__first_{cols.index(c)}")).alias(c)
                      if c in cols else F.col(q(c)) for c in df.columns])


# D8 infinities ---------------------------------------------------------------

def replace_infinities(df: DataFrame, *, columns: Sequence[str] | None = None) -> DataFrame:
    """+-inf -> NULL in floating columns (NaN is left to the NULL rules)."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields
                                                      if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = F.lit(float("inf"))
    return df.select(*[F.when(F.abs(F.col(q(c))) == inf, F.lit(None).cast(df.schema[c].dataType))
                       .otherwise(F.col(q(c))).alias(c) if c in cols else F.col(q(c)) for c in df.columns])


def count_infinities(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """D8 counter: number of +-inf cells per group."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields
                                                      if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = F.lit(float("inf"))
    total = sum((F.sum((F.abs(F.col(q(c))) == inf).cast("long")) for c in cols), F.lit(0).cast("long"))
    return df.groupBy(*_b(by)).agg(F.coalesce(total, F.lit(0).cast("long")).alias("infinite_values"))


# D9 interpolation -----------------------------------------------------------

def interpolate(df: DataFrame, *, order_by: Sequence[str], by: Sequence[str] = (),
                columns: Sequence[str] | None = None) -> DataFrame:
    """Linear interpolation by row position inside each group, both directions.

    Interior gaps are linear between the neighbouring values; leading and trailing
    gaps take the nearest value; a column without any value stays NULL. NULL is a
    group of its own. All columns are filled in one pass over rows that are
    exchanged once (``plans.carry``), whatever the size of a group.
    """
    from bizlens.plans.carry import neighbours
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=list(by) + list(order_by))
    near = neighbours(df, list(by), list(order_by), cols)

    def filled(k: int) -> Column:
        pv, nv, pg, ng = (F.col(f"__{x}{k}") for x in ("pv", "nv", "pg", "ng"))
        line = F.when(pg + ng == 0, pv).otherwise(pv + (nv - pv) * pg / (pg + ng))
        return F.when(pv.isNotNull() & nv.isNotNull(), line).otherwise(F.coalesce(pv, nv))

    return near.select(*[filled(cols.index(c)).alias(c) if c in cols else F.col(q(c)) for c in df.columns])


# D10-D12 ---------------------------------------------------------------------

def normalize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip and lower; NULL stays NULL."""
    return df.select(*[F.lower(F.trim(F.col(q(c)))).alias(c) if c in columns else F.col(q(c)) for c in df.columns])


def merge_duplicate_dates(df: DataFrame, date: str, *, by: Sequence[str] = (),
                          order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per (group, date): numerics summed, other columns first in row order."""
    keys = list(by) + [date]
    nums = [c for c in numeric_columns(df) if c not in keys]
    others = [c for c in df.columns if c not in keys and c not in nums]
    okey = F.struct(*[F.col(q(c)) for c in (order_by or df.columns)])
    return df.groupBy(*_b(keys)).agg(
        *[F.sum(F.col(q(c))).alias(c) for c in nums],
        *[F.min_by(F.col(q(c)), okey).alias(c) for c in others])


def drop_bad_rows(df: DataFrame, date: str, target: str, *, date_format: str | None = None) -> DataFrame:
    """Parse the date (bad -> NULL), parse the target, drop rows missing either."""
    d = F.col(q(date))
    if not isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        d = (F.try_to_timestamp(d.cast("string"), F.lit(date_format)) if date_format
             else F.try_to_timestamp(d.cast("string"))).cast("timestamp_ntz")
    t = (F.col(q(target)).cast("string")).try_cast("double") if not isinstance(
        df.schema[target].dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)) else finite(F.col(q(target)))
    return (df.withColumn(date, d).withColumn(target, t).dropna(subset=[date, target]))


# D13 full clean / D14 quality report -----------------------------------------

def clean(df: DataFrame, *, by: Sequence[str] = (), order_by: Sequence[str] | None = None,
          handle_missing: str = "fill", numeric_fill: str = "median", text_columns: Sequence[str] = (),
          infer: bool = True) -> DataFrame:
    """Names -> duplicates -> types -> fills -> text -> empty columns.

    Two small jobs (type statistics, empty-column counts) then one lazy plan.
    """
    from bizlens.operators.schema import infer_types, standardize_columns
    out = standardize_columns(df, style="basic")
    # written once: the statistics below read it several times
    out = cut_lineage(drop_duplicates(out))
    if infer:
        out = infer_types(out)
    if handle_missing == "drop":
        out = drop_incomplete_rows(out)
    else:
        out = fill_numeric(out, by=by, method=numeric_fill)
        out = fill_categorical(out, by=by, columns=[c for c in string_columns(out, exclude=by)
                                                     if c not in text_columns])
        dts = datetime_columns(out, exclude=by)
        if dts:
            out = fill_datetime(out, by=by, order_by=order_by or out.columns, columns=dts)
    if text_columns:
        out = normalize_text(out, text_columns)
    return drop_empty_columns(out)


def quality_report(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Duplicates, empty rows/columns, missing before / imputed / after,
    infinities; score = 1 - missing share - min(0.05, duplicate share).

    Imputation follows the validator: numeric and text NULLs are filled
    when the group has at least one value in that column; date NULLs are
    not imputed. Everything comes from one aggregate keyed by whole rows
    (duplicates) and one grouped aggregate.
    """
    by = list(by)
    cols = [c for c in df.columns if c not in by]
    nums = [c for c in numeric_columns(df, exclude=by)]
    dts = datetime_columns(df, exclude=by)
    counted = df.groupBy(*[F.col(q(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    nullx = {c: (F.col(q(c)).isNull() | (F.isnan(F.col(q(c))) if c in nums and dict(df.dtypes)[c] in ("double", "float") else F.lit(False)))
             for c in cols}
    inf = F.lit(float("inf"))
    infs = [c for c in nums if dict(df.dtypes)[c] in ("double", "float")]
    all_null = F.lit(True)
    for c in cols:
        all_null = all_null & nullx[c]
    aggs = [F.sum(n).alias("initial_rows"), (F.sum(n) - F.count(F.lit(1))).alias("duplicates_removed"),
            F.sum(F.when(all_null, 1).otherwise(0)).alias("empty_rows_removed")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(F.when(~nullx[c], 1).otherwise(0)).alias(f"nn{i}"))
        aggs.append(F.sum(F.when(nullx[c] & ~all_null, 1).otherwise(0)).alias(f"nl{i}"))
    inf_total = sum((F.sum(F.when(F.abs(F.col(q(c))) == inf, 1).otherwise(0)) for c in infs), F.lit(0))
    aggs.append(inf_total.alias("infinite_values_replaced"))
    g = counted.groupBy(*_b(by)).agg(*aggs)
    # Distinct non-empty rows, columns that are not empty.
    rows_after = F.col("initial_rows") - F.col("duplicates_removed") - F.col("empty_rows_removed")
    empty_cols = sum((F.when(F.col(f"nn{i}") == 0, 1).otherwise(0) for i in range(len(cols))), F.lit(0))
    before = sum((F.when(F.col(f"nn{i}") > 0, F.col(f"nl{i}")).otherwise(0) for i in range(len(cols))), F.lit(0))
    after = sum((F.when((F.col(f"nn{i}") > 0) & F.lit(c in dts), F.col(f"nl{i}")).otherwise(0)
                 for i, c in enumerate(cols)), F.lit(0))
    kept_cols = F.lit(len(cols)) - empty_cols
    cells = rows_after * kept_cols
    miss_pen = F.when(cells > 0, after / cells).otherwise(0.0)
    dup_pen = F.least(F.lit(0.05), F.col("duplicates_removed") / F.greatest(F.col("initial_rows"), F.lit(1)))
    score = F.least(F.greatest(F.round(1.0 - miss_pen - dup_pen, 2), F.lit(0.0)), F.lit(1.0))
    return g.select(*_b(by), "initial_rows", "duplicates_removed", "empty_rows_removed",
                    empty_cols.cast("long").alias("empty_columns_removed"),
                    before.cast("long").alias("missing_values_before"),
                    (before - after).cast("long").alias("missing_values_imputed"),
                    after.cast("long").alias("missing_values_remaining"),
                    F.col("infinite_values_replaced").cast("long").alias("infinite_values_replaced"),
                    score.alias("quality_score"), (score >= 0.70).alias("is_clean"))
