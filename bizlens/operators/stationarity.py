"""Stationarity screen (D15): augmented Dickey-Fuller test per series.

Every (group, column) series is unpivoted and numbered whole by a
range-partitioned global row number; blocks of ``BLOCK`` consecutive rows (plus
the few rows before each) build the lags by a bounded window, so a series of any
length is spread over many tasks. The cross-products of the regression are
summed per (group, column) in one grouped aggregate, and the normal equations
(one small matrix a series) are solved with NumPy: lag chosen by AIC over
0..maxlag on a common sample, the statistic is the t-value of the lagged level,
and the p-value is MacKinnon's (1994) response-surface approximation for a model
with a constant. Values are centred and scaled first, which changes none of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import finite, null_safe_join, numeric_columns, q
from bizlens.plans.order import global_row_number

# Columns never tested, and MacKinnon (1994) coefficients for
# one variable with a constant (tau_max, tau_min, tau_star, small-p and
# large-p polynomials, lowest order first).
EXCLUDED_COLUMNS = {"id", "business_id", "customer_id", "user_id", "account_id", "transaction_id", "record_id"}
BLOCK = 4096
TAU_MAX_C = 2.74
TAU_MIN_C = -18.83
TAU_STAR_C = -1.61
TAU_C_SMALLP = [2.1659, 1.4412, 0.038269]
TAU_C_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def mackinnon_p(stat: float) -> float:
    if stat > TAU_MAX_C:
        return 1.0
    if stat < TAU_MIN_C:
        return 0.0
    coef = TAU_C_SMALLP if stat <= TAU_STAR_C else TAU_C_LARGEP
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def _fit(m: np.ndarray, lags: int) -> tuple[float, float, np.ndarray, int]:
    """(ssr, beta of the level, inverse, regressors) from the cross-products of
    [const, level, differences by lag ..., target]."""
    k = 2 + lags
    inverse = np.linalg.pinv(m[:k, :k], hermitian=True)
    beta = inverse @ m[:k, -1]
    return max(float(m[-1, -1] - beta @ m[:k, -1]), 1e-300), float(beta[1]), inverse, k


def adf(m: np.ndarray, first: np.ndarray, maxlag: int) -> tuple[float, float, int, int]:
    """(statistic, p-value, used lag, observations) with AIC lag selection.

    ``m``: cross-products over the rows that have ``maxlag`` lagged differences;
    ``first``: the values of the ``maxlag + 1`` positions before those rows."""
    n = m[0, 0]
    best_aic, best_lag = math.inf, 0
    for lag in range(0, maxlag + 1):
        ssr, _, _, k = _fit(m, lag)
        aic = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0) + 2.0 * k
        if aic < best_aic:
            best_aic, best_lag = aic, lag
    m = m.copy()
    dx = np.diff(first)
    for t in range(best_lag, len(dx)):  # rows that the shorter lag adds
        row = np.zeros(len(m))
        row[[0, 1, -1]] = 1.0, first[t], dx[t]
        row[2:2 + best_lag] = dx[t - best_lag:t][::-1]
        m += np.outer(row, row)
    ssr, beta, inverse, k = _fit(m, best_lag)
    n = int(round(m[0, 0]))
    se = math.sqrt(max(ssr / max(n - k, 1) * inverse[1, 1], 1e-300))
    stat = beta / se
    return stat, mackinnon_p(stat), best_lag, n


def stationarity(df: DataFrame, *, order_by: Sequence[str], by: Sequence[str] = (),
                 columns: Sequence[str] | None = None, max_lag: int = 12,
                 min_points: int = 20) -> DataFrame:
    """One row per (group, column) with ADF statistic, p-value, used lag,
    observations and ``is_stationary`` (p < 0.05) of the whole series. Columns named
    like ids are skipped; series with < ``min_points`` values or one distinct value too."""
    by = list(by)
    cols = list(columns) if columns is not None else [
        c for c in numeric_columns(df, exclude=by + list(order_by)) if c.lower() not in EXCLUDED_COLUMNS]
    okeys = [f"__o{i}" for i in range(len(order_by))]
    sel = [*[F.col(q(b)) for b in by], *[F.col(q(c)).alias(k) for c, k in zip(order_by, okeys)],
           *[finite(F.col(q(c))).cast("double").alias(c) for c in cols]]
    long = (df.select(*sel).unpivot([*by, *okeys], cols, "column", "value").filter(F.col("value").isNotNull()))
    group = [*by, "column"]
    g = [F.col(q(c)) for c in group]
    rows = global_row_number(long, [*group, *okeys], name="__rn")
    stats = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.min("__rn").alias("__r0"), F.avg("value").alias("__mean"),
                                 F.min("value").alias("__lo"), F.max("value").alias("__hi")) \
        .where((F.col("__n") >= min_points) & (F.col("__lo") < F.col("__hi"))) \
        .withColumn("__lags", F.least(F.lit(max_lag), F.greatest(F.lit(1), F.floor(F.col("__n") / 4).cast("int"))))
    rows = null_safe_join(rows, stats, group).withColumn(
        "__x", (F.col("value") - F.col("__mean")) / (F.col("__hi") - F.col("__lo")))
    # each block also gets the last rows of the block before it
    back = max_lag + 1
    block = F.floor(F.col("__rn") / BLOCK)
    rows = rows.select(*g, "__x", "__rn", "__lags", (F.col("__rn") - F.col("__r0")).alias("__pos"), block.alias("__own"),
                       F.explode(F.when(F.col("__rn") % BLOCK >= BLOCK - back, F.array(block, block + 1))
                                 .otherwise(F.array(block))).alias("__block"))
    w = Window.partitionBy("__block").orderBy("__rn")
    rows = rows.select("*", *[F.lag("__x", k).over(w).alias(f"__x{k}") for k in range(1, back + 1)]) \
        .where(F.col("__own") == F.col("__block"))
    x = [F.col("__x"), *[F.col(f"__x{k}") for k in range(1, back + 1)]]
    z = [F.lit(1.0), x[1], *[F.when(F.col("__lags") >= k, x[k] - x[k + 1]).otherwise(0.0) for k in range(1, max_lag + 1)],
         x[0] - x[1]]
    whole = F.col("__pos") > F.col("__lags")
    terms = rows.where(whole).select(*g, "__lags", F.array(*z).alias("z")) \
        .select(*g, "__lags", "z", F.posexplode("z").alias("i", "zi"))
    sums = terms.groupBy(*g, "__lags", "i").agg(*[F.sum(F.col("z")[j] * F.col("zi")).alias(f"s{j}") for j in range(len(z))])
    # one row a regressor and at most max_lag + 1 first values: bounded lists
    sums = sums.groupBy(*g, "__lags").agg(F.sort_array(F.collect_list(
        F.struct("i", F.array(*[f"s{j}" for j in range(len(z))]).alias("s")))).alias("m"))
    first = rows.where(~whole).groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("__pos", "__x"))).alias("first"))
    keys = [f"__g{i}" for i in range(len(group))]
    both = null_safe_join(sums, first, group).select(*[c.alias(k) for c, k in zip(g, keys)], "__lags",
                                                     F.col("m.s").alias("m"), F.col("first.__x").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [adf(np.array([list(r) for r in m]), np.array(f), int(k))
                   for m, f, k in zip(pdf["m"], pdf["first"], pdf["__lags"])]
            out = pdf[keys].copy()
            for j, name in enumerate(("adf_statistic", "p_value", "used_lag", "observations")):
                out[name] = [r[j] for r in got]
            out["is_stationary"] = [r[1] < 0.05 for r in got]
            yield out

    schema = T.StructType([*[T.StructField(k, both.schema[k].dataType) for k in keys],
                           T.StructField("adf_statistic", T.DoubleType()),
                           T.StructField("p_value", T.DoubleType()), T.StructField("used_lag", T.IntegerType()),
                           T.StructField("observations", T.IntegerType()), T.StructField("is_stationary", T.BooleanType())])
    return both.mapInPandas(run, schema).withColumnsRenamed(dict(zip(keys, group)))
