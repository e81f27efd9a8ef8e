"""M7: seasonal ARIMA (1,1,1)(1,1,0)s with an 80 % band, fitted by two regressions.

With d = (1 - B)(1 - B^s) y the model is

    d_t = a d_{t-1} + b d_{t-s} + c d_{t-s-1} + m e_{t-1} + e_t

(c is free; the product form has c = -a b). The innovations e are not observed,
so they come from a first regression of d on its lags 1, 2, s, s + 1 (Hannan and
Rissanen); the second regression has their lag among its columns. Both need only
the sums of products per series, one ``groupBy`` each, and solve a system of
four equations in column expressions.

The forecast runs the recursion forward and undoes the differences. Its error
after h steps has the variance sigma^2 (1 + psi_1^2 + ... + psi_{h-1}^2), where
psi is the response of the same recursion to a single innovation.

Series too short for the second regression repeat their last season (or their
last value) and have no band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import null_safe_join, q
from bizlens.functions.linalg import normal_sql, products_sql
from bizlens.operators.forecast import Z_SCORES, Forecaster

PARAMETERS = ["ar", "sar", "mix", "ma"]
_FIRST = ["f1", "f2", "fs", "fs1"]


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def _regress(rows: DataFrame, x: Sequence[str], y: str, out: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., *out, n): least squares of ``y`` on ``x`` in every group, over rows that have all of them."""
    ok = F.col(y).isNotNull()
    for c in x:
        ok = ok & F.col(c).isNotNull()
    sums = rows.where(ok).groupBy(*_b(by)).agg(*[F.expr(e).alias(c) for c, e in products_sql(x, y, tag="p")],
                                               F.count(F.lit(1)).alias("n_obs"))
    steps = [f"{e} AS {c}" for c, e in normal_sql(len(x), out, tag="p")]
    return sums.selectExpr("*", *steps).select(*_b(by), *out, "n_obs")


def _join(rows: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    return null_safe_join(rows, params, list(by), "left") if by else rows.crossJoin(params)


class SeasonalARIMA(Forecaster):
    """Forecasts and bands of every series (by..., ts, y) at once."""

    def __init__(self, season: int = 12, *, level: float = 0.80, min_rows: int = 8):
        super().__init__(f"seasonal_arima_{season}")
        self.season, self.level, self.min_rows = season, level, min_rows

    def fit(self, train: DataFrame, by: Sequence[str]) -> DataFrame:
        """One row a series: parameters, sigma2, the last innovation and the last values."""
        s, by = self.season, list(by)
        w = Window.partitionBy(*_b(by)).orderBy("ts")  # a series is a period aggregate

        def lag(c: str, k: int) -> Column:
            return F.lag(c, k).over(w)

        rows = train.select(*_b(by), "ts", "y", (F.row_number().over(w) - 1).alias("t"),
                            (F.col("y") - lag("y", 1) - lag("y", s) + lag("y", s + 1)).alias("d"))
        rows = rows.select("*", lag("d", 1).alias("d1"), lag("d", 2).alias("d2"), lag("d", s).alias("ds"),
                           lag("d", s + 1).alias("ds1"))
        rows = _join(rows, _regress(rows, ["d1", "d2", "ds", "ds1"], "d", _FIRST, by).drop("n_obs"), by)
        rows = rows.withColumn("e", F.expr("d - (f1 * d1 + f2 * d2 + fs * ds + fs1 * ds1)")).drop(*_FIRST)
        rows = rows.withColumn("e1", lag("e", 1))
        rows = _join(rows, _regress(rows, ["d1", "ds", "ds1", "e1"], "d", PARAMETERS, by), by)
        rows = rows.withColumn("r", F.expr("d - (ar * d1 + sar * ds + mix * ds1 + ma * e1)"))
        n = F.count(F.lit(1)).over(Window.partitionBy(*_b(by)))
        last = F.when(F.col("t") >= F.col("n") - (s + 1), F.struct("t", "y", "d"))  # s + 1 values a series
        model = rows.withColumn("n", n).groupBy(*_b(by)).agg(
            *[F.max(c).alias(c) for c in PARAMETERS], F.max("n_obs").alias("n_obs"), F.sum(F.col("r") * F.col("r")).alias("rss"),
            F.max(F.when(F.col("t") == F.col("n") - 1, F.col("r"))).alias("last_e"),
            F.sort_array(F.collect_list(last)).alias("tail"))
        fitted = F.coalesce(F.col("n_obs") >= self.min_rows, F.lit(False))
        return model.select(*_b(by), *PARAMETERS, fitted.alias("fitted"), "last_e",
                            F.when(fitted, F.col("rss") / F.greatest(F.lit(1), F.col("n_obs") - 4)).alias("sigma2"),
                            F.col("tail.y").alias("ys"), F.col("tail.d").alias("ds"))

    def _run(self, ys: Column, ds: Column, first: Column, steps: int) -> Column:
        """``ys`` carried on for ``steps`` periods; ``first`` is added to the first difference."""
        s = self.season

        def at(c: Column, k: int) -> Column:
            return F.try_element_at(c, F.lit(-k))  # rows without a fit may be met before they are filtered out

        def step(acc: Column, h: Column) -> Column:
            y, d = acc["y"], acc["d"]
            new = (F.col("ar") * at(d, 1) + F.col("sar") * at(d, s) + F.col("mix") * at(d, s + 1)
                   + F.when(h == 1, first).otherwise(0.0))
            return F.struct(F.concat(y, F.array(at(y, 1) + at(y, s) - at(y, s + 1) + new)).alias("y"),
                            F.concat(d, F.array(new)).alias("d"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(ys.alias("y"), ds.alias("d")), step)["y"]

    def predict_bands(self, model: DataFrame, horizon: int, by: Sequence[str]) -> DataFrame:
        """(by..., step, forecast, lower_bound, upper_bound)."""
        s, z = self.season, Z_SCORES[self.level]
        fit = model.where("fitted").withColumn("path", self._run(F.col("ys"), F.col("ds"), F.col("ma") * F.col("last_e"), horizon))
        quiet = F.array_repeat(F.lit(0.0), s)  # nothing before the innovation of size one
        one = F.concat(quiet, F.array(F.lit(1.0)))
        psi = F.slice(self._run(one, one, F.col("ma"), horizon), s + 1, horizon)
        fit = fit.withColumn("psi", psi).select(*_b(by), "sigma2", "psi", F.slice("path", s + 2, horizon).alias("path"))
        out = fit.select(*_b(by), "sigma2", "psi", F.posexplode("path").alias("p", "forecast"))
        var = F.aggregate(F.slice("psi", F.lit(1), F.col("p") + 1), F.lit(0.0), lambda a, x: a + x * x) * F.col("sigma2")
        half = z * F.sqrt(var)
        out = out.select(*_b(by), (F.col("p") + 1).alias("step"), "forecast", (F.col("forecast") - half).alias("lower_bound"),
                         (F.col("forecast") + half).alias("upper_bound"))
        step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
        short = model.where("NOT fitted").select(*_b(by), "ys", step)
        m = F.least(F.size("ys"), F.lit(s))
        whole = F.size("ys") >= s  # a whole season, else the last value
        back = F.when(whole, F.element_at("ys", -(m - (F.col("step") - 1) % m))).otherwise(F.element_at("ys", -1))
        none = F.lit(None).cast("double")
        return out.unionByName(short.select(*_b(by), "step", back.alias("forecast"), none.alias("lower_bound"), none.alias("upper_bound")))

    def predict(self, model: DataFrame, horizon: int, by: Sequence[str]) -> DataFrame:
        return self.predict_bands(model, horizon, by).select(*_b(by), "step", "forecast")
