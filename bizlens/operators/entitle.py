"""Membership, plan and entitlement joins.

The reference resolves these with one database query per row; here each is
a single join. Membership tables grow with the user count and are joined
by key (the planner measures them; AQE picks broadcast or shuffle). Only
the fixed plan / feature / price tables (a handful of rows) are broadcast
explicitly, including the one non-equi join (B5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_memberships(tenants: DataFrame, user_tenant: DataFrame) -> DataFrame:
    """B1: tenant x membership inner equi-join, for every user at once."""
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    return user_tenant.join(t, "tenant_id").select("user_id", "tenant_id", "tenant_name", "role")


def user_tenants(users: DataFrame, user_tenant: DataFrame, tenants: DataFrame) -> DataFrame:
    """B2: user -> tenants with role and plan (one three-way join)."""
    u = users.select(F.col("id").alias("user_id"), "email")
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    return (u.join(user_tenant, "user_id").join(t, "tenant_id")
            .select("user_id", "email", "tenant_id", "tenant_name", "role", "subscription_plan"))


def tenant_members(tenants: DataFrame, user_tenant: DataFrame, users: DataFrame) -> DataFrame:
    """Tenant -> members with e-mail and role."""
    u = users.select(F.col("id").alias("user_id"), "email")
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    return t.join(user_tenant, "tenant_id").join(u, "user_id").select("tenant_id", "tenant_name", "user_id", "email", "role")


def effective_plan(users: DataFrame, user_tenant: DataFrame, *, as_of: str) -> DataFrame:
    """Missing membership, missing plan or expiry before ``as_of`` -> Starter."""
    u = users.select(F.col("id").alias("user_id"))
    j = u.join(user_tenant, "user_id", "left")
    expired = F.col("subscription_expiry") < F.lit(as_of).cast("timestamp_ntz")
    plan = (F.when(F.col("id").isNull(), "Starter").when(expired, "Starter")
            .otherwise(F.coalesce(F.col("subscription_plan"), F.lit("Starter"))))
    return j.select("user_id", "tenant_id", plan.alias("effective_plan"))


def entitlements(plans_of_users: DataFrame, plans: DataFrame, features: DataFrame, *,
                 plan_col: str = "effective_plan") -> DataFrame:
    """A plan includes every lower plan's features (rank join, broadcast nested loop)."""
    p = plans.select(F.col("plan").alias(plan_col), "rank")
    ranked = plans_of_users.join(F.broadcast(p), plan_col)  # 4 fixed rows
    return ranked.join(F.broadcast(features), F.col("min_rank") <= F.col("rank")).drop("min_rank")


def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """Newest start date per tenant (ties: highest id); ``max_by`` keeps it one aggregate."""
    key = F.struct("start_date", "id")
    return subscriptions.groupBy("tenant_id").agg(
        F.max_by(F.struct("id", "plan", "status", "start_date"), key).alias("s")).select("tenant_id", "s.*")


def plan_prices(spark_plans: DataFrame, *, usd_to_ngn: int = 800) -> DataFrame:
    """(plan, currency, price): USD and NGN (x rate)."""
    usd = spark_plans.select("plan", F.lit("USD").alias("currency"), F.col("price_usd").alias("price"))
    ngn = spark_plans.select("plan", F.lit("NGN").alias("currency"), (F.col("price_usd") * usd_to_ngn).alias("price"))
    return usd.unionByName(ngn)


def price_subscriptions(subscriptions: DataFrame, prices: DataFrame) -> DataFrame:
    """List price of every subscription in its currency (broadcast 8-row price table)."""
    return subscriptions.join(F.broadcast(prices), ["plan", "currency"]).select(
        "id", "tenant_id", "plan", "currency", "price", (F.col("amount") == F.col("price")).alias("amount_matches"))
