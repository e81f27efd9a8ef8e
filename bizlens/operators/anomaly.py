"""Anomalies (A1-A5).

A1/A2: per-group mean and sample deviation (one aggregate), joined back on
the group key and filtered - no sort of the data. A3: a distributed
isolation forest (Liu, Ting and Zhou, 2008) for every group: trees are grown
on bounded subsamples in ``applyInPandas`` (one task group a tree), chunks of
a group's rows meet its forest in a cogroup and are scored once, and the
contamination cut is an exact percentile of scores with six decimals.
A4/A5 are rules over KPI rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.exprs import finite, q
from bizlens.session import cut_lineage

# Metric labels of the z-score rules.
REVENUE_LABEL = "Revenue Dropped Significantly"
EXPENSE_LABEL = "Expense Spike Detected"


def _b(by: Sequence[str]) -> list[Column]:
    return [F.col(q(c)) for c in by]


def zscore_outliers(df: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = (),
                    date: str | None = None, min_points: int = 3) -> DataFrame:
    """A1 + A2: revenue z < -2 and expenses z > 2 against the group mean and
    sample deviation (>= 3 values, deviation > 0), with severity."""
    parts = []
    for key, label, lower in (("revenue", REVENUE_LABEL, True), ("expenses", EXPENSE_LABEL, False)):
        c = mapping.get(key)
        if not c or c not in df.columns:
            continue
        v = finite(F.col(q(c)))
        stats = df.groupBy(*_b(by)).agg(F.avg(v).alias("_mu"), F.stddev_samp(v).alias("_sd"),
                                        F.count(v).alias("_n"))
        stats = stats.filter((F.col("_n") >= min_points) & (F.col("_sd") > 0))
        # one row per group: the planner broadcasts it when small, shuffles otherwise
        j = df.join(stats, list(by)) if by else df.crossJoin(stats)
        z = (v - F.col("_mu")) / F.col("_sd")
        cond = (z < -2.0) if lower else (z > 2.0)
        az = F.abs(z)
        sev = F.when((az > 3.0) | (F.lit(lower) & (v < F.col("_mu") * 0.5)), "Critical") \
            .when(az > 2.5, "High").when(az > 2.0, "Medium").otherwise("Low")
        parts.append(j.filter(v.isNotNull() & cond).select(
            *_b(by), *( [F.col(q(date)).alias("date")] if date else []),
            F.lit("statistical_outlier").alias("type"), sev.alias("severity"), F.lit(label).alias("metric"),
            F.round(v, 2).alias("value"), F.round("_mu", 2).alias("historical_average"),
            F.round(z, 4).alias("z_score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpi_alerts(kpis: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A4: current ratio < 1 -> Critical liquidity risk; churn > 10 -> High retention risk."""
    cr, ch = F.col("current_ratio"), F.col("churn_rate")
    alerts = F.array(
        F.when(cr.isNotNull() & (cr < 1.0), F.struct(F.lit("liquidity_risk").alias("type"),
                                                     F.lit("Critical").alias("severity"),
                                                     F.lit("Current Ratio").alias("metric"), cr.alias("value"))),
        F.when(ch.isNotNull() & (ch > 10.0), F.struct(F.lit("retention_risk").alias("type"),
                                                      F.lit("High").alias("severity"),
                                                      F.lit("Customer Churn").alias("metric"), ch.alias("value"))))
    return kpis.select(*_b(by), F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("a")).select(
        *_b(by), "a.*")


def opportunities(kpis: DataFrame, *, by: Sequence[str] = (), has_marketing: bool = False) -> DataFrame:
    """A5: growth > 5; expense ratio above / below 70 %; marketing present; default."""
    g = F.col("revenue_growth")
    rev, exp = F.col("total_revenue"), F.col("total_expenses")
    ratio = F.when(rev > 0, exp / rev)
    ops = F.array(
        F.when(g > 5.0, F.lit("scale_acquisition")),
        F.when(ratio > 0.70, F.lit("restructure_costs")).when(ratio.isNotNull(), F.lit("reinvest_margin")),
        F.when(F.lit(has_marketing), F.lit("optimize_cac")))
    present = F.filter(ops, lambda x: x.isNotNull())
    final = F.when(F.size(present) > 0, present).otherwise(F.array(F.lit("retention_workflows")))
    return kpis.select(*_b(by), F.posexplode(final).alias("ordinal", "opportunity"))


# ----------------------------------------------------------------------------
# A3 isolation forest
# ----------------------------------------------------------------------------

def _c_factor(n: float) -> float:
    """Average unsuccessful-search path length in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes as (feature, threshold, left, right, size); leaves have feature -1."""
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        idx = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if depth >= max_depth or len(rows) <= 1:
            return idx
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return idx
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = rows[rows[:, f] < thr]
        right = rows[rows[:, f] >= thr]
        nodes[idx][0], nodes[idx][1] = f, thr
        nodes[idx][2] = build(left, depth + 1)
        nodes[idx][3] = build(right, depth + 1)
        return idx

    build(x, 0)
    return [tuple(n) for n in nodes]


def _path_lengths(x: np.ndarray, tree: Sequence[Sequence[float]]) -> np.ndarray:
    feat = np.array([t[0] for t in tree], dtype=np.int64)
    thr = np.array([t[1] for t in tree], dtype=np.float64)
    left = np.array([t[2] for t in tree], dtype=np.int64)
    right = np.array([t[3] for t in tree], dtype=np.int64)
    size = np.array([t[4] for t in tree], dtype=np.float64)
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x), dtype=np.float64)
    active = feat[node] >= 0
    while active.any():
        i = np.where(active)[0]
        f = feat[node[i]]
        go_left = x[i, f] < thr[node[i]]
        node[i] = np.where(go_left, left[node[i]], right[node[i]])
        depth[i] += 1
        active = feat[node] >= 0
    return depth + np.array([_c_factor(s) for s in size[node]])


def tree_places(rows: DataFrame, xcols: Sequence[str], *, trees: int, subsample: int, seed: int) -> DataFrame:
    """(__if_g, __if_tree, __if_rank, *xcols): the places of every tree, at most ``subsample`` each.

    ``rows`` are the different rows of a group with their count ``__if_w`` and the group's size
    ``__if_n``. A row's number of places over all trees is its expectation, the fraction decided
    by hash. Whole rounds give every tree the same; the rest goes to different trees, by a stride
    without a factor in common with ``trees``. A row has at most 1.5 x ``subsample`` places a tree."""
    key = F.xxhash64("__if_g", *xcols, F.lit(seed))
    want = F.lit(float(trees)) * F.col("__if_w") * F.least(F.lit(1.0), F.lit(1.5 * subsample) / F.col("__if_n"))
    unit = F.pmod(F.xxhash64("__if_h", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    strides = F.array(*[F.lit(s) for s in range(1, trees + 1) if math.gcd(s, trees) == 1])
    rest = F.transform(F.sequence(F.lit(0), (F.col("__if_k") % trees).cast("int")), lambda i: F.pmod(
        F.pmod("__if_h", F.lit(trees)) + i * F.col("__if_s"), F.lit(trees)).cast("int"))
    rest = F.slice(rest, F.lit(1), (F.col("__if_k") % trees).cast("int"))  # the sequence has one more
    each = (rows.withColumn("__if_h", key).withColumn("__if_k", F.floor(want + unit).cast("long")).where("__if_k > 0")
            .withColumn("__if_s", F.get(strides, F.pmod(F.xxhash64("__if_h", F.lit(2)), F.size(strides)).cast("int")))
            .withColumn("__if_rest", rest).withColumn("__if_round", F.floor(F.col("__if_k") / trees).cast("int")))
    every = F.when(F.col("__if_round") > 0, F.sequence(F.lit(0), F.lit(trees - 1))).otherwise(F.col("__if_rest"))
    each = each.withColumn("__if_tree", F.explode(every))
    count = F.col("__if_round") + F.array_contains("__if_rest", F.col("__if_tree")).cast("int")
    each = each.withColumn("__if_place", F.explode(F.sequence(F.lit(1), count)))
    each = each.withColumn("__if_rank", F.xxhash64("__if_h", "__if_tree", "__if_place", F.lit(3)))
    lowest = Window.partitionBy("__if_g", "__if_tree").orderBy("__if_rank", *xcols)
    return each.withColumn("__if_at", F.row_number().over(lowest)).where(F.col("__if_at") <= subsample) \
        .select("__if_g", "__if_tree", "__if_rank", *xcols)


def isolation_forest(df: DataFrame, features: Sequence[str], *, by: Sequence[str] = (), trees: int = 100,
                     subsample: int = 256, contamination: float = 0.05, seed: int = 42, min_rows: int = 10,
                     chunk_rows: int = 250_000) -> DataFrame:
    """A3: anomaly score in [0, 1] and ``is_outlier`` for the top ``contamination``
    share of every group of ``by``, each with a forest of its own.

    A row has the same chance of a place in each tree, at any size, copies included: equal
    rows are counted first, and a count's places are spread over the trees by hash. 1.5 x
    ``subsample`` places a tree are expected, and a tree keeps the ``subsample`` with the lowest
    hash, chosen in Spark, so no task grows a tree on more. Rows and forests meet in chunks of
    about ``chunk_rows`` rows of a group. NULL features count as 0. Groups below ``min_rows``
    rows, or without a feature that varies, have no score and no outlier; scores equal to the
    cut are no outliers. Columns of ``df`` may have any names but those that begin with
    ``__if_``.
    """
    xcols = [f"__if_x{i}" for i in range(len(features))]
    group = F.to_json(F.struct(*_b(by))) if by else F.lit("")
    base = cut_lineage(df.select("*", *[F.coalesce(finite(F.col(q(c))), F.lit(0.0)).alias(x) for c, x in zip(features, xcols)],
                                 group.alias("__if_g"), F.monotonically_increasing_id().alias("__if_row")))
    varies = [F.max(x) > F.min(x) for x in xcols]
    size = base.groupBy("__if_g").agg(F.count(F.lit(1)).alias("__if_n"), reduce(lambda a, b: a | b, varies).alias("__if_v")) \
        .where(F.col("__if_v") & (F.col("__if_n") >= min_rows)).drop("__if_v")
    max_depth = int(math.ceil(math.log2(max(subsample, 2))))
    places = tree_places(base.groupBy("__if_g", *xcols).agg(F.count(F.lit(1)).alias("__if_w")).join(size, "__if_g"), xcols,
                         trees=trees, subsample=subsample, seed=seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__if_rank", *xcols])
        tree = int(pdf["__if_tree"].iloc[0])
        nodes = _grow_tree(pdf[xcols].to_numpy(dtype=np.float64), np.random.default_rng(seed + tree), max_depth)
        return pd.DataFrame({"__if_g": [pdf["__if_g"].iloc[0]], "__if_tree": [tree],
                             "nodes": [[list(map(float, n)) for n in nodes]]})

    # one row a (group, tree), of at most 2 x subsample nodes
    forest = cut_lineage(places.groupBy("__if_g", "__if_tree").applyInPandas(
        grow, "__if_g string, __if_tree int, nodes array<array<double>>"))
    chunks = F.ceil(F.col("__if_n") / chunk_rows).cast("int")
    rows = base.join(size, "__if_g", "left") \
        .withColumn("__if_chunk", F.pmod("__if_row", F.coalesce(chunks, F.lit(1))).cast("int"))
    parts = size.select("__if_g", chunks.alias("__if_chunks"))
    models = forest.join(parts, "__if_g").select("__if_g", "__if_tree", "nodes",
                                                 F.explode(F.sequence(F.lit(0), F.col("__if_chunks") - 1)).alias("__if_chunk"))
    schema = T.StructType([*df.schema.fields, T.StructField("__if_g", T.StringType()), T.StructField("anomaly_score", T.DoubleType())])

    def score(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[f.name for f in schema.fields[:-1]]]
        if not len(pdf) or not len(model):
            return out.assign(anomaly_score=np.full(len(pdf), np.nan))
        x = pdf[xcols].to_numpy(dtype=np.float64)
        e = sum(_path_lengths(x, np.stack(t)) for t in model.sort_values("__if_tree")["nodes"]) / len(model)
        mean = _c_factor(min(subsample, int(pdf["__if_n"].iloc[0])))
        return out.assign(anomaly_score=np.round(np.power(2.0, -e / mean), 6))

    scored = rows.groupBy("__if_g", "__if_chunk").cogroup(models.groupBy("__if_g", "__if_chunk")).applyInPandas(score, schema)
    value = F.col("anomaly_score")
    scored = cut_lineage(scored.withColumn("anomaly_score", F.when(~F.isnan(value), value)))
    # scores have six decimals, so the exact percentile holds a bounded number of values
    cut = scored.groupBy("__if_g").agg(F.percentile("anomaly_score", 1.0 - contamination).alias("__if_cut"))
    return scored.join(cut, "__if_g").select(*[F.col(q(c)) for c in df.columns], "anomaly_score",
                                             F.coalesce(value > F.col("__if_cut"), F.lit(False)).alias("is_outlier"))
