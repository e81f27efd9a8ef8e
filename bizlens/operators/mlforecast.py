"""Spark ML forecasters.

ONE global model is trained over every series: the features are lags 1-3
of the target, the seasonal position (sin / cos of the month), the trend
index and the series id (indexed), so a thousand companies cost one fit,
not a thousand. Forecasting is recursive: the state per series is its
last three values; each step predicts one period for all series at once and
shifts the state. The state (one row per series) is checkpointed to the
shared folder every ``checkpoint_every`` steps (default: each step), so
step k does not recompute steps 1..k-1.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exprs import q
from bizlens.functions.linalg import normal_sql, products_sql
from bizlens.operators.forecast import Forecaster
from bizlens.session import checkpoint_dir, cut_lineage

FEATURES = ["y_lag_1", "y_lag_2", "y_lag_3", "sin_month", "cos_month", "t", "series_idx"]
LAGS = 3


def _series_key(by: Sequence[str]):
    return F.concat_ws("\u0001", *[F.col(q(b)).cast("string") for b in by]) if by else F.lit("all")


def _month_features(ts):
    m = F.month(ts)
    return [F.sin(2 * math.pi * m / 12.0).alias("sin_month"), F.cos(2 * math.pi * m / 12.0).alias("cos_month")]


def training_frame(series: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows with their lag features (series windows are small period aggregates)."""
    w = Window.partitionBy(*[F.col(q(b)) for b in by]).orderBy("ts")
    base = series.select(*[F.col(q(b)) for b in by], "ts", "y", _series_key(by).alias("series_key"))
    out = base.select("*", *[F.lag("y", k).over(w).alias(f"y_lag_{k}") for k in range(1, LAGS + 1)],
                      (F.row_number().over(w) - 1).cast("double").alias("t"), *_month_features(F.col("ts")))
    return out.dropna(subset=[f"y_lag_{k}" for k in range(1, LAGS + 1)])


@dataclass
class _Fitted:
    model: PipelineModel
    state: DataFrame  # (by..., series_key, ts, t, hist array<double> of the last LAGS values)


def series_state(train: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a series: its last ``LAGS`` values, last date and length."""
    w = Window.partitionBy(*[F.col(q(b)) for b in by]).orderBy(F.desc("ts"))
    last = (train.select(*[F.col(q(b)) for b in by], "ts", "y", _series_key(by).alias("series_key"))
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= LAGS))  # LAGS rows per series
    n = train.groupBy(*[F.col(q(b)) for b in by]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    state = last.groupBy(*[F.col(q(b)) for b in by], "series_key").agg(
        F.max("ts").alias("ts"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda e: e["y"]).alias("hist"))
    state = state.join(n, list(by)) if by else state.crossJoin(n)
    return state.withColumnRenamed("n", "t")


class SparkMLForecaster(Forecaster):
    """Shared fit / recursive predict; subclasses choose the regressor."""

    def __init__(self, name: str, regressor, *, checkpoint_every: int = 1):
        super().__init__(name)
        self.regressor = regressor
        self.checkpoint_every = checkpoint_every

    def fit(self, train: DataFrame, by: Sequence[str]):
        # Boosting runs many jobs over the same rows: cut the lineage once so no
        # iteration re-derives the series from the source tables.
        tf = cut_lineage(training_frame(train, by=by))
        pipe = Pipeline(stages=[
            StringIndexer(inputCol="series_key", outputCol="series_idx", handleInvalid="keep"),
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip"),
            self.regressor.copy()])
        model = pipe.fit(tf)
        return _Fitted(model, series_state(train, by))

    def forecast_step(self, fitted: _Fitted, feats: DataFrame) -> DataFrame:
        """``feats`` with the forecast of one period for every series, as ``forecast``."""
        return fitted.model.transform(feats).withColumnRenamed("prediction", "forecast")

    def predict(self, fitted: _Fitted, horizon: int, by: Sequence[str], *, keep: Sequence[str] = ("forecast",)) -> DataFrame:
        """(by..., step, *keep): what ``forecast_step`` gives for each period."""
        state = fitted.state
        outs = []
        for step in range(1, horizon + 1):
            nts = F.add_months(F.col("ts").cast("date"), 1).cast("timestamp_ntz")
            feats = state.select("*", nts.alias("next_ts"),
                                 *[F.element_at("hist", -k).alias(f"y_lag_{k}") for k in range(1, LAGS + 1)],
                                 *_month_features(nts))
            pred = self.forecast_step(fitted, feats).select(
                *[F.col(q(b)) for b in by], "series_key", F.col("next_ts").alias("ts"), "t", "hist", *keep)
            if step % self.checkpoint_every == 0:
                pred = cut_lineage(pred)  # one row a series; both the result and the next step read it
            outs.append(pred.select(*[F.col(q(b)) for b in by], F.lit(step).alias("step"), *keep))
            state = pred.select(*[F.col(q(b)) for b in by], "series_key", "ts", (F.col("t") + 1).alias("t"),
                                F.slice(F.concat("hist", F.array("forecast")), -LAGS, LAGS).alias("hist"))
        out = outs[0]
        for o in outs[1:]:
            out = out.unionByName(o)
        return out


def forest_table(model, spark) -> DataFrame:
    """A fitted Spark ML forest as a node table, one row a tree: ``tree`` and ``nodes``, an array
    by node number of (prediction, left, right, split); a leaf has no children (-1).

    The table is the forest's own stored form; a tree has at most 2 ** (depth + 1) nodes."""
    path = os.path.join(checkpoint_dir(spark), "models", f"forest-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    node = F.struct(n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"),
                    n["rightChild"].alias("right"), n["split"].alias("split"))
    return spark.read.parquet(os.path.join(path, "data")).groupBy(F.col("treeID").alias("tree")) \
        .agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def _next_node(nodes, x, k):
    """The node after ``k`` on the way of ``x`` (a leaf: itself)."""
    node = F.get(nodes, k)
    split, told = node["split"], node["split"]["leftCategoriesOrThreshold"]
    value = F.get(x, split["featureIndex"])
    left = F.when(split["numCategories"] < 0, value <= F.get(told, F.lit(0))).otherwise(F.array_contains(told, value))
    return F.when(node["left"] < 0, k).when(left, node["left"]).otherwise(node["right"])


class RandomForest(SparkMLForecaster):
    """M5 with a band from the spread of its trees.

    The forest is a table of node arrays (one row a tree); every series meets
    every tree and an expression walks its nodes, which gives one forecast a
    tree. Their mean is the forest's forecast, ``z`` times their standard
    deviation the half width of the band."""

    def __init__(self, regressor, *, z: float = 1.96, checkpoint_every: int = 1):
        super().__init__("random_forest", regressor, checkpoint_every=checkpoint_every)
        self.z = z

    def forecast_step(self, fitted: _Fitted, feats: DataFrame) -> DataFrame:
        forest = fitted.model.stages[-1]
        if not hasattr(fitted, "trees"):
            fitted.trees = cut_lineage(forest_table(forest, feats.sparkSession))
        every = feats
        for stage in fitted.model.stages[:-1]:
            every = stage.transform(every)
        x = F.array(*[F.col(c).cast("double") for c in FEATURES])
        # a fixed number of trees: each row meets all of them, on the tree's number
        every = every.drop("features").withColumn("x", x).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(len(forest.trees) - 1))))
        met = every.join(F.broadcast(fitted.trees), "tree")
        depth = F.sequence(F.lit(1), F.lit(forest.getMaxDepth()))
        node = F.aggregate(depth, F.lit(0), lambda k, _: _next_node(F.col("nodes"), F.col("x"), k))
        each = F.get("nodes", node)["prediction"]
        keys = [F.col(q(c)) for c in feats.columns]
        g = met.withColumn("each", each).groupBy(*keys).agg(F.avg("each").alias("forecast"), F.stddev_pop("each").alias("spread"))
        return g.withColumn("lower_bound", F.col("forecast") - self.z * F.col("spread")) \
            .withColumn("upper_bound", F.col("forecast") + self.z * F.col("spread"))

    def predict_bands(self, fitted: _Fitted, horizon: int, by: Sequence[str]) -> DataFrame:
        return self.predict(fitted, horizon, by, keep=("forecast", "lower_bound", "upper_bound"))


def random_forest(*, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForest:
    """M5: 100 trees of depth 10."""
    return RandomForest(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed,
                                              featuresCol="features", labelCol="y"))


def gradient_boosting(*, iters: int = 150, rate: float = 0.03, depth: int = 5, seed: int = 42) -> SparkMLForecaster:
    """M6: 150 boosting rounds at learning rate 0.03."""
    # The training frame is already checkpointed; per-round checkpoints of the
    # boosting state would only add writes for a period-level table.
    return SparkMLForecaster("gradient_boosting", GBTRegressor(maxIter=iters, stepSize=rate, maxDepth=depth, seed=seed,
                                                               featuresCol="features", labelCol="y",
                                                               checkpointInterval=-1))


def feature_importance(fitted: _Fitted) -> DataFrame:
    """M8: importances normalised to 1, descending."""
    reg = fitted.model.stages[-1]
    imp = reg.featureImportances.toArray().tolist()
    total = sum(imp) or 1.0
    rows = sorted(((f, v / total) for f, v in zip(FEATURES, imp)), key=lambda r: -r[1])
    return fitted.state.sparkSession.createDataFrame(rows, "feature string, importance double")


def multi_target_series(df: DataFrame, date: str, targets: Sequence[str], *, by: Sequence[str] = (),
                        period: str = "month") -> DataFrame:
    """Every target becomes one more series key, so all targets run in one job."""
    ts = F.date_trunc(period, F.col(q(date))).cast("timestamp_ntz")
    long = df.select(*[F.col(q(b)) for b in by], ts.alias("ts"),
                     *[F.col(q(t)).cast("double").alias(t) for t in targets]).unpivot(
        [*by, "ts"], list(targets), "target", "v")
    return (long.filter(F.col("ts").isNotNull() & F.col("v").isNotNull())
            .groupBy(*[F.col(q(b)) for b in by], "target", "ts").agg(F.round(F.sum("v"), 2).alias("y")))


def train_tenant_model(df: DataFrame, features: Sequence[str], label: str, tenant: str, *,
                       path: str | None = None, trees: int = 50, depth: int = 8) -> tuple[PipelineModel, str]:
    """One forest over all tenants (tenant as an indexed feature), saved to the
    shared checkpoint folder; ``update`` is a refit on the new data."""
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=tenant, outputCol="_tenant_idx", handleInvalid="keep"),
        VectorAssembler(inputCols=[*features, "_tenant_idx"], outputCol="features", handleInvalid="skip"),
        RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=42)])
    model = pipe.fit(df)
    path = path or os.path.join(checkpoint_dir(df.sparkSession), "models", f"tenant-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    return model, path


def load_tenant_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Per-tenant linear models that take new data -----------------------------

def tenant_statistics(df: DataFrame, features: Sequence[str], label: str, tenant: str) -> DataFrame:
    """(tenant, n, sums of products): all that a least-squares model per tenant needs.
    Rows without the label or a feature do not count; sums are combined before the shuffle."""
    names = ["_x0", *[f"_x{k + 1}" for k in range(len(features))]]
    rows = df.select(F.col(q(tenant)).alias("tenant"), F.lit(1.0).alias("_x0"),
                     *[F.col(q(c)).cast("double").alias(n) for c, n in zip(features, names[1:])],
                     F.col(q(label)).cast("double").alias("_y")).dropna(subset=[*names, "_y"])
    return rows.groupBy("tenant").agg(*[F.expr(e).alias(c) for c, e in products_sql(names, "_y", tag="p")],
                                      F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count(F.lit(1)).alias("n"))


def _version(spark, root: str) -> int:
    """The last complete version below ``root`` (0: none)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max([0, *[int(name[1:]) for name in done if name[0] == "v"]])


def update_tenant_models(df: DataFrame, features: Sequence[str], label: str, tenant: str, *, path: str | None = None) -> str:
    """M23 update: add ``df`` to the statistics below ``path`` (none yet: start them) as a
    new version. Old rows are not read again, and tenants without new rows keep their sums.
    A failed update leaves the last version as it was."""
    spark = df.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), "models", f"tenants-{uuid.uuid4().hex}")
    last = _version(spark, path)
    stats = tenant_statistics(df, features, label, tenant)
    if last:
        both = spark.read.parquet(f"{path}/v{last}").unionByName(stats)
        sums = [c for c in stats.columns if c != "tenant"]
        stats = both.groupBy("tenant").agg(*[F.sum(c).alias(c) for c in sums])
    stats.write.mode("overwrite").parquet(f"{path}/v{last + 1}")
    return path


def tenant_models(spark, path: str, features: Sequence[str]) -> DataFrame:
    """(tenant, n, intercept, one coefficient a feature, r2): the models of the last version."""
    stats = spark.read.parquet(f"{path}/v{_version(spark, path)}")
    out = ["intercept", *[f"b_{c}" for c in features]]
    fit = stats.selectExpr("*", *[f"{e} AS {c}" for c, e in normal_sql(len(out), [q(c) for c in out], tag="p")])
    told = sum((F.col(q(c)) * F.col(f"p{k}y") for k, c in enumerate(out)), F.lit(0.0))
    total = F.col("yy") - F.col("p0y") * F.col("p0y") / F.col("n")
    r2 = F.when(total > 0, 1.0 - (F.col("yy") - told) / total)
    return fit.select("tenant", "n", *[F.col(q(c)) for c in out], r2.alias("r2"))
