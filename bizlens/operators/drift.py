"""Distribution drift.

Both sides are tagged and unpivoted to (column, value, side); one aggregate
counts every distinct value per side; exact running sums over the
range-partitioned values (``plans.carry``) give both empirical CDFs, so

    KS = max |F1 - F2|  and  W1 = sum |F1 - F2| * (next value - value)

are two more grouped aggregates. No column is ever sorted inside one task.
The p-value is the asymptotic two-sample Kolmogorov distribution (with the
usual small-sample correction); it is inaccurate for very small samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exprs import div, finite, null_safe_join, q
from bizlens.plans.carry import running_sums, sorted_ranges


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Q_KS(lambda) = 2 sum_{j>=1} (-1)^(j-1) exp(-2 j^2 lambda^2), lambda = (en + 0.12 + 0.11/en) D."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam))
    p = F.when(lam < 1e-3, 1.0).otherwise(2.0 * s)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str], side: int) -> DataFrame:
    sel = [*_b(by)] + [finite(F.col(q(c))).alias(c) for c in columns]
    return (df.select(*sel).unpivot(list(by), list(columns), "column", "value")
            .filter(F.col("value").isNotNull()).withColumn("side", F.lit(side)))


def _of_side(k: int, c: str = "value"):
    return F.when(F.col("side") == k, F.col(c))


def _moments(k: int, name: str) -> list[Column]:
    return [F.sum((F.col("side") == k).cast("long")).alias(f"n{k}"), F.avg(_of_side(k)).alias(f"{name}_mean"),
            F.stddev_samp(_of_side(k)).alias(f"{name}_std")]


def _compare(counts: DataFrame, moments: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """The drift rows from (keys..., value, c1, c2) and the moments of both sides."""
    keys = list(keys)
    cdf = running_sums(sorted_ranges(counts, keys, ["value"]), keys, ["c1", "c2"], next_of="value")
    cdf = null_safe_join(cdf, moments.select(*_b(keys), "n1", "n2"), keys)
    diff = F.abs(div(F.col("cum_c1"), F.col("n1")) - div(F.col("cum_c2"), F.col("n2")))  # NULL where a side is empty
    stats = cdf.groupBy(*_b(keys)).agg(
        F.max(diff).alias("ks_statistic"),
        F.coalesce(F.sum(diff * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("wasserstein_distance"))
    j = null_safe_join(moments, stats, keys)
    valid = (F.col("n1") > 0) & (F.col("n2") > 0)
    p = F.when(valid, ks_pvalue(F.col("ks_statistic"), F.col("n1").cast("double"), F.col("n2").cast("double")))
    return j.select(*_b(keys), "n1", "n2", F.col("ks_statistic"), p.alias("ks_pvalue"), "wasserstein_distance",
                    "reference_mean", "current_mean", "reference_std", "current_std",
                    (valid & (p < alpha)).alias("drift_detected"))


def column_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (),
                 alpha: float = 0.05) -> DataFrame:
    """G1: one row per (group, column): KS statistic, p-value, Wasserstein
    distance, both means and deviations, and the drift flag (p < alpha)."""
    keys = [*by, "column"]
    both = _long(baseline, columns, by, 1).unionByName(_long(current, columns, by, 2))
    moments = both.groupBy(*_b(keys)).agg(*_moments(1, "reference"), *_moments(2, "current"))
    counts = both.groupBy(*_b(keys), "value").agg(
        F.sum((F.col("side") == 1).cast("long")).alias("c1"), F.sum((F.col("side") == 2).cast("long")).alias("c2"))
    return _compare(counts, moments, keys, alpha)


def store_baseline(baseline: DataFrame, columns: Sequence[str], path: str, *, by: Sequence[str] = ()) -> None:
    """Write what drift needs of a baseline once: its values with their counts, range-partitioned
    on (group, column, value), and its moments."""
    keys = [*by, "column"]
    rows = _long(baseline, columns, by, 1)
    counts = rows.groupBy(*_b(keys), "value").agg(F.count(F.lit(1)).alias("c1"))
    order = [*_b(keys), F.col("value")]
    counts.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/counts")
    rows.groupBy(*_b(keys)).agg(*_moments(1, "reference")).write.mode("overwrite").parquet(f"{path}/moments")


def drift_from_baseline(path: str, current: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (),
                        alpha: float = 0.05) -> DataFrame:
    """G1 against a stored baseline, whose rows are not read again: the counts of the new
    rows are merged with the stored ones."""
    spark, keys = current.sparkSession, [*by, "column"]
    rows = _long(current, columns, by, 2)
    none = F.lit(0).cast("long")
    new = rows.groupBy(*_b(keys), "value").agg(F.count(F.lit(1)).alias("c2"))
    counts = spark.read.parquet(f"{path}/counts").withColumn("c2", none).unionByName(new.withColumn("c1", none)) \
        .groupBy(*_b(keys), "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    parts = spark.read.parquet(f"{path}/moments").unionByName(rows.groupBy(*_b(keys)).agg(*_moments(2, "current")),
                                                              allowMissingColumns=True)
    names = ["n1", "reference_mean", "reference_std", "n2", "current_mean", "current_std"]
    moments = parts.groupBy(*_b(keys)).agg(*[F.max(c).alias(c) for c in names]).fillna(0, subset=["n1", "n2"])  # two rows a key
    return _compare(counts, moments, keys, alpha)


def drift_summary(drift: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Columns checked, drifted, percentage and the overall flag."""
    g = drift.groupBy(*_b(by)).agg(F.count(F.lit(1)).cast("int").alias("total_columns_checked"),
                                   F.sum(F.col("drift_detected").cast("int")).cast("int").alias("drifted_columns"))
    return g.select(*_b(by), F.lit(True).alias("success"), (F.col("drifted_columns") > 0).alias("drift_detected"),
                    F.round(F.col("drifted_columns") / F.col("total_columns_checked") * 100.0, 2).alias("drift_percentage"),
                    "total_columns_checked", "drifted_columns")


def seasonality_shift(baseline: DataFrame, current: DataFrame, date: str, value: str, *,
                      by: Sequence[str] = (), threshold_pct: float = 20.0) -> DataFrame:
    """G3 (our definition): mean by calendar month on each side and the relative shift."""
    def side(df, s):
        return df.select(*_b(by), F.month(F.col(q(date))).alias("month_of_year"), finite(F.col(q(value))).alias("v"),
                         F.lit(s).alias("side"))
    both = side(baseline, 1).unionByName(side(current, 2))
    g = both.groupBy(*_b(by), "month_of_year").agg(
        F.avg(F.when(F.col("side") == 1, F.col("v"))).alias("baseline_mean"),
        F.avg(F.when(F.col("side") == 2, F.col("v"))).alias("current_mean"))
    shift = F.when(F.col("baseline_mean") != 0,
                   (F.col("current_mean") - F.col("baseline_mean")) / F.abs(F.col("baseline_mean")) * 100.0)
    return g.select(*_b(by), "month_of_year", "baseline_mean", "current_mean", shift.alias("shift_pct"),
                    F.coalesce(F.abs(shift) > threshold_pct, F.lit(False)).alias("shifted"))
