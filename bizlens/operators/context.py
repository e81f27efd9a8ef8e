"""Business context detection (C14).

Consumes the tidy outputs of type partition (C9) and ranked pairs (R2) -
small per-dataset rows - and names only. Domain by keyword priority (sales
> customer > finance > operations), KPI by keyword score plus suffix bonus, then
the target, the chart category and a confidence of 1 less penalties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exprs import is_datetime, is_numeric, numeric_columns

# Domain keywords in priority order, KPI keyword scores, suffix bonuses, penalties.
DOMAIN_KEYWORDS = [
    ("sales", ["revenue", "sales", "profit", "income", "orders", "purchase", "marketing"]),
    ("customer", ["customer", "client", "segment", "gender", "user", "age"]),
    ("finance", ["expense", "cost", "budget", "cash", "finance", "margin"]),
    ("operations", ["delivery", "operations", "shipment", "efficiency", "process", "time"]),
]
KPI_SCORES = {"revenue": 100, "sales": 95, "profit": 92, "income": 90, "earnings": 88, "margin": 85,
              "conversion": 82, "purchase": 80, "orders": 78, "growth": 70, "retention": 68, "score": 65,
              "amount": 62, "value": 60, "spend": 45, "expense": 40, "cost": 38, "visits": 30, "traffic": 28,
              "clicks": 25, "impressions": 20}
SUFFIX_BONUS = {"_revenue": 15, "_profit": 12, "_sales": 10}
PENALTIES = {"general": 0.2, "no_kpi": 0.3, "no_target": 0.2, "no_correlations": 0.1}


def kpi_score(name: str) -> int:
    n = name.lower()
    hits = [v for k, v in KPI_SCORES.items() if k in n]
    return (max(hits) if hits else 0) + sum(b for s, b in SUFFIX_BONUS.items() if n.endswith(s))


def business_context(df: DataFrame, types: DataFrame, pairs: DataFrame, *, target: str | None = None,
                     importance: DataFrame | None = None) -> DataFrame:
    """One row: domain, kpi, target, category, confidence (types: C9 rows; pairs: R2 rows;
    importance: R3 rows).

    Target: the analysis' own ``target`` if numeric, else the KPI, else the strongest driver,
    else the second (then the first) column of the top pair, else the last numeric column.
    Category: of the categorical columns with 2 to 12 values the first, in the order of the
    table, whose name holds a preferred word, else the first. Distinct values are counted for
    the categorical columns only, in one value-count table."""
    from bizlens.operators.relate import CATEGORY_WORDS
    from bizlens.operators.values import distinct_values, value_counts
    cols = [c.lower() for c in df.columns]
    domain = next((d for d, kws in DOMAIN_KEYWORDS if any(k in c for c in cols for k in kws)), "general")
    numeric = numeric_columns(df)
    scored = sorted(((kpi_score(c), -i, c) for i, c in enumerate(numeric)), reverse=True)
    kpi = scored[0][2] if scored and scored[0][0] > 0 else (numeric[0] if numeric else None)
    chosen = target if target in numeric else kpi
    texts = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and not is_datetime(f.dataType)]
    spark = df.sparkSession
    one = spark.range(1).select()
    found = spark.createDataFrame([], "c int, unique_values long")
    if texts:
        found = distinct_values(value_counts(df, texts)).select("c", "unique_values")
    name = F.get(F.array(*[F.lit(c) for c in texts]).cast("array<string>"), F.col("c"))
    word = F.exists(F.array(*[F.lit(w) for w in CATEGORY_WORDS]), lambda w: F.contains(F.lower("column"), w))
    cand = found.where(F.col("unique_values").between(2, 12)).select("c", name.alias("column")) \
        .join(types.where(F.col("kind") == "categorical").select("column"), "column")
    category = cand.agg(F.min(F.struct((~word).alias("plain"), "c", "column"))["column"].alias("category"))
    first = pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                      F.min(F.when(F.col("rank") == 1, F.struct("feature_1", "feature_2"))).alias("top"))
    told = F.array(*[F.lit(c) for c in numeric]).cast("array<string>")
    pick = [F.lit(chosen).cast("string")]
    if importance is not None:
        first = first.crossJoin(importance.agg(F.max(F.struct("importance", (-F.col("rank")).alias("r"), "feature"))["feature"]
                                               .alias("driver")))  # one row each
        pick.append(F.col("driver"))
    pick += [F.when(F.array_contains(told, F.col(f"top.{f}")), F.col(f"top.{f}")) for f in ("feature_2", "feature_1")]
    pick.append(F.lit(numeric[-1] if numeric else None).cast("string"))
    conf = 1.0 - (PENALTIES["general"] if domain == "general" else 0) - (PENALTIES["no_kpi"] if not kpi else 0)
    out = one.crossJoin(category).crossJoin(first).withColumn("target", F.coalesce(*pick))
    loss = F.when(F.col("target").isNull(), PENALTIES["no_target"]).otherwise(0.0) \
        + F.when(F.col("n_pairs") == 0, PENALTIES["no_correlations"]).otherwise(0.0)
    return out.select(F.lit(domain).alias("domain"), F.lit(kpi).alias("kpi"), "target", "category",
                      F.round(F.greatest(F.lit(0.0), F.lit(conf) - loss), 2).alias("confidence"))
