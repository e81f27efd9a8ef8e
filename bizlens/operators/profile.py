"""Profiling operators P1-P12.

Per-column statistics come from one table of values and counts per (group,
column) (``operators.values``): distinct counts, moments, exact quantiles and top
values are aggregates of it, and no task holds the values of a group.
``approx=True`` switches to bounded-memory sketches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import (null_safe_join, datetime_columns, finite, numeric_columns, q,
                                     skewness_adjusted)
from bizlens.operators.values import distinct_values, named, summary, value_counts

# Canonical columns of each domain.
DOMAIN_CHECKS = {
    "financials": ["revenue", "expenses", "profit"],
    "customers": ["active_customers", "churn_rate", "new_customers"],
    "liquidity": ["cash_balance", "debt", "inventory"],
    "marketing": ["marketing_spend", "cac"],
}


def _bycols(by: Sequence[str]) -> list[Column]:
    return [F.col(q(b)) for b in by]


def _data_columns(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(by)]


def _null_test(df: DataFrame, c: str) -> Column:
    """pandas isnull: NULL, and NaN for floating columns."""
    dt = df.schema[c].dataType
    x = F.col(q(c))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def _width(df: DataFrame, c: str) -> int:
    """Bytes of a value of fixed width; 4 (an offset) for the others."""
    kind = df.schema[c].dataType
    return {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8,
            "timestamp_ntz": 8}.get(kind.simpleString(), 16 if isinstance(kind, T.DecimalType) else 4)


def long_numeric(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                 keep_nonfinite: bool = False) -> DataFrame:
    """(by..., column, value) with NaN and +-inf as NULL; no shuffle."""
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    sel = [*_bycols(by)] + [(F.col(q(c)).cast("double") if keep_nonfinite else finite(F.col(q(c)))).alias(c)
                            for c in cols]
    return df.select(*sel).unpivot(list(by), cols, "column", "value")


# ----------------------------------------------------------------------------
# P1 table profile, P8 missing, P9 duplicates
# ----------------------------------------------------------------------------

def table_profile(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, cells, missing cells and their percentage, and the size of the
    values in MB (fixed-width types by their width, text and binary by their bytes, an
    offset of 4 bytes and one bit of validity a cell)."""
    cols = _data_columns(df, by)
    missing = sum((F.sum(_null_test(df, c).cast("long")) for c in cols), F.lit(0).cast("long"))
    rows = F.count(F.lit(1))
    fixed = sum(_width(df, c) for c in cols) + len(cols) / 8
    text = [F.sum(F.coalesce(F.octet_length(F.col(q(c))), F.lit(0)).cast("long")) for c in cols if _width(df, c) == 4
            and isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    size = sum(text, F.lit(0).cast("long")) + rows * F.lit(float(fixed))
    g = df.groupBy(*_bycols(by)).agg(rows.alias("rows"), missing.alias("total_missing_values"), size.alias("_bytes"))
    k = len(cols)
    return g.select(
        *_bycols(by), "rows", F.lit(k).cast("long").alias("columns"),
        (F.col("rows") * k).alias("total_cells"), "total_missing_values",
        F.when(F.col("rows") > 0, F.round(F.col("total_missing_values") / (F.col("rows") * k) * 100.0, 2))
        .otherwise(0.0).alias("overall_missing_percentage"), F.round(F.col("_bytes") / (1024 * 1024), 4).alias("memory_mb"))


def missing_values(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """NULL (and NaN) count per column, one row per (group, column)."""
    cols = _data_columns(df, by)
    wide = df.groupBy(*_bycols(by)).agg(*[F.sum(_null_test(df, c).cast("long")).alias(c) for c in cols])
    return wide.unpivot(list(by), cols, "column", "missing")


def duplicate_rows(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows minus distinct rows (NULL equals NULL), per group.

    One aggregate keyed by the whole row (partial counts combine copies
    map-side), then a small aggregate per group.
    """
    cols = df.columns
    counted = df.groupBy(*[F.col(q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*_bycols(by)).agg(
        F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"))


# ----------------------------------------------------------------------------
# P2 column profile, P3/P5/P6/P12 numeric statistics, P4 datetime range
# ----------------------------------------------------------------------------

def column_profile(df: DataFrame, *, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Dtype, null count and %, distinct count and type flags per column."""
    cols = _data_columns(df, by)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(_null_test(df, c).cast("long")).alias(f"n{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(F.col(q(c))).cast("long").alias(f"d{i}"))
    wide = df.groupBy(*_bycols(by)).agg(*aggs)
    if not approx:
        found = distinct_values(value_counts(df, cols, by=by), by=by)
        found = found.groupBy(*_bycols(by)).agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("unique_values"))), F.lit(0))
                                                  .alias(f"d{i}") for i in range(len(cols))])
        wide = null_safe_join(wide, found, by, "left") if by else wide.join(found, how="left")
        wide = wide.fillna(0, subset=[f"d{i}" for i in range(len(cols))])
    structs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        is_bool = isinstance(dt, T.BooleanType)
        is_num = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                                 T.DoubleType, T.DecimalType))
        is_dt = isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(dt.simpleString()).alias("dtype"),
            F.col(f"n{i}").alias("null_count"),
            F.when(F.col("_rows") > 0, F.round(F.col(f"n{i}") / F.col("_rows") * 100.0, 4))
            .otherwise(0.0).alias("null_percentage"),
            F.col(f"d{i}").alias("unique_values"),
            F.lit(is_num).alias("is_numeric"), F.lit(is_bool).alias("is_boolean"),
            F.lit(is_dt).alias("is_datetime")))
    return wide.select(*_bycols(by), F.inline(F.array(*structs)))


def _quantiles(v: Column, probs: list[float], approx: bool) -> Column:
    if approx:
        return F.percentile_approx(v, probs, 100000)
    return F.percentile(v, F.array(*[F.lit(p) for p in probs]))


def _summary(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None, probs: Sequence[float], approx: bool, *,
             complete: bool = False) -> DataFrame:
    """(by..., column, n, mean, std, skewness, min, max, q0, ...): exact, or with sketched quantiles."""
    if not approx:
        return summary(df, probs, by=by, columns=columns, complete=complete)
    long = long_numeric(df, by=by, columns=columns)
    v = F.col("value")
    g = long.groupBy(*_bycols([*by, "column"])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), skewness_adjusted(v).alias("skewness"),
        F.min(v).alias("min"), F.max(v).alias("max"), _quantiles(v, list(probs), True).alias("_q"))
    g = g if complete else g.filter(F.col("n") > 0)
    return g.select("*", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))]).drop("_q")


def numeric_stats(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Mean, std (n-1), min, p25, median, p75, max, skewness; inf/NaN excluded."""
    g = _summary(df, by, columns, [0.25, 0.5, 0.75], approx)
    n = F.col("n")
    return g.select(
        *_bycols(by), "column", n.alias("count"), "mean", F.when(n > 1, F.col("std")).otherwise(0.0).alias("std"), "min",
        F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), "max",
        F.when(n > 2, F.coalesce("skewness", F.lit(0.0))).otherwise(0.0).alias("skewness"))


def describe(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
             approx: bool = False) -> DataFrame:
    """P5: count, mean, std, min, 25%, 50%, 75%, max with inf / NaN / undefined as 0."""
    g = _summary(df, by, columns, [0.25, 0.5, 0.75], approx, complete=True)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return g.select(*_bycols(by), "column", F.col("n").cast("double").alias("count"),
                    *[z(c).alias(name) for c, name in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q0", "p25"),
                                                       ("q1", "p50"), ("q2", "p75"), ("max", "max"))])


def distributions(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Mean, median, std, skewness, min, max to 4 places for columns with >3 values."""
    g = _summary(df, by, columns, [0.5], approx).withColumnRenamed("q0", "median")
    return g.filter(F.col("n") > 3).select(
        *_bycols(by), "column", *[F.round(F.col(c), 4).alias(c)
                                  for c in ["mean", "median", "std", "skewness", "min", "max"]])


def descriptive_stats(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                      approx: bool = False) -> DataFrame:
    """Mean, std (0 if undefined), min, max, median to 2 places."""
    g = _summary(df, by, columns, [0.5], approx).withColumnRenamed("q0", "median")
    return g.select(
        *_bycols(by), "column", F.round("mean", 2).alias("mean"),
        F.round(F.coalesce(F.col("std"), F.lit(0.0)), 2).alias("std"),
        F.round("min", 2).alias("min"), F.round("max", 2).alias("max"),
        F.round("median", 2).alias("median"))


def datetime_range(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Min and max of every datetime column."""
    cols = list(columns) if columns is not None else datetime_columns(df, exclude=by)
    sel = [*_bycols(by)] + [F.col(q(c)).cast("timestamp_ntz").alias(c) for c in cols]
    long = df.select(*sel).unpivot(list(by), cols, "column", "value")
    return long.groupBy(*_bycols(by), "column").agg(
        F.min("value").alias("min_date"), F.max("value").alias("max_date"))


# ----------------------------------------------------------------------------
# P7 categorical top values
# ----------------------------------------------------------------------------

def top_values(df: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The k most frequent values of each column, ties by value.

    NULL is not a value (it is reported by P8). ``row_number() <= k`` lets
    Spark apply a per-partition group limit before the window shuffle.
    """
    text = df.select(*_bycols(by), *[F.col(q(c)).cast("string").alias(c) for c in columns if c not in by])
    counts = named(value_counts(text, columns, by=by), columns, by=by) \
        .select(*_bycols(by), "column", F.col("txt").alias("value"), F.col("n").alias("count"))
    w = Window.partitionBy(*_bycols(by), "column").orderBy(F.desc("count"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


# ----------------------------------------------------------------------------
# P10 / P11 quality score
# ----------------------------------------------------------------------------

def domain_coverage(mapping: Mapping[str, str]) -> tuple[list[str], float]:
    """Mapped domains and the covered share (names only, no job)."""
    mapped = [d for d, fields in DOMAIN_CHECKS.items() if any(f in mapping for f in fields)]
    return mapped, len(mapped) / len(DOMAIN_CHECKS) * 100.0


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct rows with their multiplicity ``_n`` (NULL equals NULL): one
    aggregate keyed by the whole row; copies combine map-side."""
    return df.groupBy(*[F.col(q(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))


def quality_score(df: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = (),
                  counted: DataFrame | None = None) -> DataFrame:
    """P10: 0.35 completeness + 0.35 accuracy + 0.15 uniqueness + 0.15 coverage.

    One aggregate keyed by the whole row yields duplicates and NULL cells
    together (each distinct row carries its NULL count and multiplicity),
    then one small aggregate per group.
    """
    by = list(by)
    cols = _data_columns(df, by)
    k = len(cols)
    acc_col = mapping.get("accuracy_score") or next((c for c in df.columns if "accuracy" in c.lower()), None)
    counted = counted if counted is not None else distinct_counts(df)
    row_nulls = sum((_null_test(counted, c).cast("long") for c in cols), F.lit(0).cast("long"))
    aggs = [F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
            F.sum(row_nulls * F.col("_n")).alias("null_cells")]
    if acc_col:
        a = finite(F.col(q(acc_col)))
        aggs += [F.sum(a * F.col("_n")).alias("_acc_s"), F.sum(F.when(a.isNotNull(), F.col("_n"))).alias("_acc_n")]
    g = counted.groupBy(*_bycols(by)).agg(*aggs)
    _, coverage = domain_coverage(mapping)
    cells = F.col("rows") * k
    completeness = F.when(cells > 0, (cells - F.col("null_cells")) / cells * 100.0)
    uniqueness = F.greatest(F.lit(0.0), 100.0 - F.col("duplicate_rows") / F.col("rows") * 100.0)
    if acc_col:
        am = F.col("_acc_s") / F.col("_acc_n")
        accuracy = F.when(am <= 1.0, am * 100.0).otherwise(am)
    else:
        accuracy = completeness
    score = F.round(completeness * 0.35 + accuracy * 0.35 + uniqueness * 0.15 + F.lit(coverage) * 0.15, 1)
    return g.select(*_bycols(by), "rows", F.lit(k).cast("long").alias("columns"), "null_cells", "duplicate_rows",
                    F.round(completeness, 1).alias("completeness_pct"),
                    F.lit(round(coverage, 1)).alias("canonical_coverage_pct"),
                    F.when(cells > 0, score).otherwise(0.0).alias("data_quality_score"))
