"""One table of values and counts per (group, column), and what follows from it.

``value_counts`` turns every wanted column of every row into (group, column,
value) and counts equal ones, combining in the tasks before the one shuffle.
Distinct counts, modes, top values, moments and exact quantiles are then
aggregates of that table: no column has an aggregate of its own that would
multiply the rows, and no task holds the values of a group.

Columns are known by their place until the result is named, so the table is
narrow. Numbers are kept as doubles, other types as text; whole numbers that a
double may not hold exactly are kept as both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import is_numeric, null_safe_join, numeric_columns, q

_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _kept(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    num = F.col(q(c)).cast("double") if is_numeric(kind) else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if isinstance(kind, _EXACT) else F.col(q(c)).cast("string")
    return F.struct(num.alias("num"), text.alias("txt"))


def value_counts(df: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """(by..., c, num, txt, n): how often each value of ``columns`` occurs; ``c`` is the place
    of its column. NULL is no value; NaN is one."""
    cells = F.array(*[F.struct(F.lit(k).alias("c"), _kept(df, name).alias("v")) for k, name in enumerate(columns)])
    long = df.select(*_b(by), F.explode(cells).alias("x")).select(
        *_b(by), F.col("x.c").alias("c"), F.col("x.v.num").alias("num"), F.col("x.v.txt").alias("txt"))
    return long.where(F.col("num").isNotNull() | F.col("txt").isNotNull()) \
        .groupBy(*_b(by), "c", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def named(df: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """``c`` as the name of its column, after the groups."""
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("c"))
    return df.select(*_b(by), name.alias("column"), *[F.col(q(c)) for c in df.columns if c not in (*by, "c")])


def distinct_values(counts: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """(by..., c, unique_values, values): distinct and all values of each column."""
    return counts.groupBy(*_b(by), "c").agg(F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("values"))


def modes(counts: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """(by..., c, mode): the most frequent text of each column, the smallest among ties.

    The largest count comes first, as a hash aggregate; then only its values are compared."""
    top = counts.groupBy(*_b(by), "c").agg(F.max("n").alias("top"))
    met = null_safe_join(counts, top, [*by, "c"]).where(F.col("n") == F.col("top"))
    return met.groupBy(*_b(by), "c").agg(F.min("txt").alias("mode"))


def finite_numbers(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(by..., c, num, n) over the finite numbers of ``columns`` (all numeric ones), and the columns."""
    columns = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    cells = F.array(*[F.struct(F.lit(k).alias("c"), F.col(q(c)).cast("double").alias("num")) for k, c in enumerate(columns)])
    long = df.select(*_b(by), F.explode(cells).alias("x")).select(*_b(by), F.col("x.c").alias("c"), F.col("x.num").alias("num"))
    ok = F.col("num").isNotNull() & ~F.isnan("num") & (F.abs("num") != float("inf"))
    return long.where(ok).groupBy(*_b(by), "c", "num").agg(F.count(F.lit(1)).alias("n")), columns


def quantiles(counts: DataFrame, probs: Sequence[float], *, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """((by..., c, q0, q1, ...), the counts as sorted ranges): exact linearly interpolated quantiles.

    Running counts over the range-partitioned values give every value its ranks, and only
    the values that bracket a wanted rank (two a quantile) are kept."""
    from bizlens.plans.carry import running_sums, sorted_ranges
    keys = [*by, "c"]
    ranges = sorted_ranges(counts, keys, ["num"])
    total = ranges.groupBy(*_b(keys)).agg(F.sum("n").alias("total"))
    cum = null_safe_join(running_sums(ranges, keys, ["n"]), total, keys)
    before = F.col("cum_n") - F.col("n")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("cum_n"))

    ranks = [(F.col("total") - 1) * float(p) for p in probs]
    kept = cum.where(sum((F.when(holds(f(r)), 1).otherwise(0) for r in ranks for f in (F.floor, F.ceil)), F.lit(0)) > 0)
    aggs = [F.max(F.when(holds(f(r)), F.col("num"))).alias(f"{side}{i}")
            for i, r in enumerate(ranks) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = kept.groupBy(*_b(keys)).agg(F.first("total").alias("total"), *aggs)
    values = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]
    return found.select(*_b(keys), *[v.alias(f"q{i}") for i, v in enumerate(values)]), ranges


def summary(df: DataFrame, probs: Sequence[float], *, by: Sequence[str] = (), columns: Sequence[str] | None = None,
            complete: bool = False) -> DataFrame:
    """(by..., column, n, mean, std, skewness, min, max, q0, ...) of every numeric column's finite
    values, one row a column and group; with ``complete`` also for those without values (n = 0).

    Moments are taken around the mean in a second pass over the sorted counts."""
    counts, columns = finite_numbers(df, columns, by=by)
    keys = [*by, "c"]
    found, ranges = quantiles(counts, probs, by=by)
    first = ranges.groupBy(*_b(keys)).agg(F.sum("n").alias("cnt"), (F.sum(F.col("n") * F.col("num")) / F.sum("n")).alias("mean"),
                                          F.min("num").alias("min"), F.max("num").alias("max"))
    d = F.col("num") - F.col("mean")
    second = null_safe_join(ranges.select(*_b(keys), "num", "n"), first.select(*_b(keys), "mean"), keys).groupBy(*_b(keys)).agg(
        F.sum(F.col("n") * d * d).alias("m2"), F.sum(F.col("n") * d * d * d).alias("m3"))
    out = null_safe_join(null_safe_join(first, second, keys), found, keys)
    if complete:
        every = df.select(*_b(by)).distinct() if by else df.sparkSession.range(1).select()
        every = every.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(columns))])).alias("c"))
        out = null_safe_join(every, out, keys, "left")
    n = F.col("cnt").cast("double")
    m2 = F.when(F.col("min") == F.col("max"), 0.0).otherwise(F.col("m2"))  # no rounding where nothing varies
    g1 = F.when(m2 > 0, (F.col("m3") / n) / F.pow(m2 / n, F.lit(1.5)))
    out = out.select(*_b(keys), F.coalesce("cnt", F.lit(0)).alias("n"), "mean", F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
                     F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), "min", "max",
                     *[F.col(f"q{i}") for i in range(len(probs))])
    return named(out, columns, by=by)
