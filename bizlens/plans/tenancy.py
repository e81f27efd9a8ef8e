"""Tenancy relations derived from ``customer`` and ``orders`` with fixed arithmetic.

users = customers; every block of five customer keys is one tenant owned by
its first key; memberships carry a plan from the market segment and an
expiry from the key (some missing, some expired, one block exactly at
``AS_OF``); subscriptions are the orders of every customer (plan from
priority, status from order status, currency from the key). The same
relations are given as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.plans.views import table

AS_OF = "2001-06-01 00:00:00"

# Plan ladder, USD prices and feature lists (lowest plan first).
PLAN_ORDER = ["Starter", "Professional", "Agency", "Enterprise"]
PLAN_PRICES_USD = {"Starter": 0, "Professional": 30, "Agency": 50, "Enterprise": 100}
USD_TO_NGN = 800
PLAN_FEATURES = {
    "Starter": ["Data Upload", "Analysis", "Visualization", "Conclusions"],
    "Professional": ["Data Upload", "Analysis", "Visualization", "Conclusions", "AI Predictions",
                     "Revenue Forecast", "AI Chatbot", "PDF Reports"],
    "Agency": ["Data Upload", "Analysis", "Visualization", "Conclusions", "AI Predictions",
               "Revenue Forecast", "AI Chatbot", "PDF Reports", "Budget Optimizer", "Growth Strategy Generator"],
    "Enterprise": ["Data Upload", "Analysis", "Visualization", "Conclusions", "AI Predictions",
                   "Revenue Forecast", "AI Chatbot", "PDF Reports", "Budget Optimizer",
                   "Growth Strategy Generator", "Multi-Client Dashboards", "API Access", "Autonomous AI Consultant"],
}

SEGMENT_PLAN = {"AUTOMOBILE": "Starter", "BUILDING": "Professional", "FURNITURE": "Agency",
                "HOUSEHOLD": "Enterprise", "MACHINERY": "Professional"}
PRIORITY_PLAN = {"1-URGENT": "Enterprise", "2-HIGH": "Agency", "3-MEDIUM": "Professional"}
STATUS_MAP = {"F": "active", "O": "pending", "P": "failed"}


def _map(col, mapping: dict, default):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("int").alias("id"),
                    F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 5 == 0)
    tid = (F.col("c_custkey") / 5).cast("int")
    return c.select(tid.alias("id"), F.concat(F.lit("tenant_"), tid.cast("string")).alias("name"),
                    F.col("c_custkey").cast("int").alias("owner_id"),
                    F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 365 as int))")
                    .alias("created_at"))


def user_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 11 != 0)
    k = F.col("c_custkey")
    expiry = F.when(k % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 400 as int))"))
    return c.select(k.cast("int").alias("id"), k.cast("int").alias("user_id"), (k / 5).cast("int").alias("tenant_id"),
                    F.when(k % 5 == 0, "owner").when(k % 5 == 1, "admin").otherwise("member").alias("role"),
                    _map(F.col("c_mktsegment"), SEGMENT_PLAN, "Starter").alias("subscription_plan"),
                    expiry.alias("subscription_expiry"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    plan = _map(F.col("o_orderpriority"), PRIORITY_PLAN, "Starter")
    ngn = F.col("o_custkey") % 3 == 0
    price = _map(plan, PLAN_PRICES_USD, 0)
    return o.select(F.col("o_orderkey").cast("int").alias("id"), (F.col("o_custkey") / 5).cast("int").alias("tenant_id"),
                    F.col("o_custkey").cast("int").alias("user_tenant_id"), plan.alias("plan"),
                    _map(F.col("o_orderstatus"), STATUS_MAP, "pending").alias("status"),
                    F.concat(F.lit("tx-"), F.col("o_orderkey").cast("string")).alias("tx_ref"),
                    F.when(ngn, "NGN").otherwise("USD").alias("currency"),
                    F.when(ngn, price * USD_TO_NGN).otherwise(price).cast("int").alias("amount"),
                    F.col("o_orderdate").alias("start_date"),
                    F.expr("o_orderdate + make_interval(0, 0, 0, 30)").alias("expiry_date"))


def plans(spark: SparkSession) -> DataFrame:
    """(plan, rank, price_usd) - a fixed four-row table."""
    return spark.createDataFrame([(p, i, PLAN_PRICES_USD[p]) for i, p in enumerate(PLAN_ORDER)],
                                 "plan string, rank int, price_usd int")


def features(spark: SparkSession) -> DataFrame:
    """(feature, min_rank): the lowest plan rank that lists the feature (fixed, 13 rows)."""
    first: dict[str, int] = {}
    for i, p in enumerate(PLAN_ORDER):
        for f in PLAN_FEATURES[p]:
            first.setdefault(f, i)
    return spark.createDataFrame(sorted(first.items()), "feature string, min_rank int")


def _case(col: str, mapping: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


USERS_SQL = "(SELECT CAST(c_custkey AS INTEGER) AS id, 'user' || c_custkey || '@example.com' AS email FROM customer)"
TENANTS_SQL = """(SELECT CAST(c_custkey // 5 AS INTEGER) AS id, 'tenant_' || (c_custkey // 5) AS name,
    CAST(c_custkey AS INTEGER) AS owner_id, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
    FROM customer WHERE c_custkey % 5 = 0)"""
USER_TENANT_SQL = f"""(SELECT CAST(c_custkey AS INTEGER) AS id, CAST(c_custkey AS INTEGER) AS user_id,
    CAST(c_custkey // 5 AS INTEGER) AS tenant_id,
    CASE WHEN c_custkey % 5 = 0 THEN 'owner' WHEN c_custkey % 5 = 1 THEN 'admin' ELSE 'member' END AS role,
    {_case('c_mktsegment', SEGMENT_PLAN, 'Starter')} AS subscription_plan,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 400 AS INTEGER)) END
        AS subscription_expiry
    FROM customer WHERE c_custkey % 11 <> 0)"""
_PLAN_SQL = _case("o_orderpriority", PRIORITY_PLAN, "Starter")
_PRICE_SQL = "CASE " + " ".join(f"WHEN ({_PLAN_SQL}) = '{p}' THEN {v}" for p, v in PLAN_PRICES_USD.items()) + " ELSE 0 END"
SUBSCRIPTIONS_SQL = f"""(SELECT CAST(o_orderkey AS INTEGER) AS id, CAST(o_custkey // 5 AS INTEGER) AS tenant_id,
    CAST(o_custkey AS INTEGER) AS user_tenant_id, {_PLAN_SQL} AS plan, {_case('o_orderstatus', STATUS_MAP, 'pending')} AS status,
    'tx-' || o_orderkey AS tx_ref, CASE WHEN o_custkey % 3 = 0 THEN 'NGN' ELSE 'USD' END AS currency,
    CAST(CASE WHEN o_custkey % 3 = 0 THEN ({_PRICE_SQL}) * {USD_TO_NGN} ELSE ({_PRICE_SQL}) END AS INTEGER) AS amount,
    o_orderdate AS start_date, o_orderdate + INTERVAL 30 DAY AS expiry_date FROM orders)"""
PLANS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', {i}, {PLAN_PRICES_USD[p]})" for i, p in enumerate(PLAN_ORDER)) + ") t(plan, rank, price_usd))"


def _features_sql() -> str:
    first: dict[str, int] = {}
    for i, p in enumerate(PLAN_ORDER):
        for f in PLAN_FEATURES[p]:
            first.setdefault(f, i)
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{f}', {r})" for f, r in sorted(first.items())) + \
        ") t(feature, min_rank))"


FEATURES_SQL = _features_sql()
