"""Input views built from the driver's TPC-H-like tables.

Each view has a Spark builder and the equivalent DuckDB SQL text so that a
query and its oracle read the same rows. Variants punch holes, add text or
extreme values with fixed arithmetic on keys, identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Row order of the business view: every column, so ties never depend on the plan.
BV_ORDER = ["date", "region", "segment", "product", "customer", "revenue", "expenses", "quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcasting
    # them is bounded regardless of the scale factor.
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", "r_name"))


def _lines(spark: SparkSession, sf_dir: str, extra: bool) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer")
    pa = table(spark, sf_dir, "part")
    geo = _geo(spark, sf_dir)
    # customer x geo is small next to lineitem; the planner picks broadcast vs
    # shuffle join for customer / part from measured sizes (AQE), so nothing
    # here broadcasts a table that grows with the scale factor unchecked.
    cust = cu.join(F.broadcast(geo), cu.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_mktsegment", "r_name", *(["c_acctbal"] if extra else []))
    # Lineitem crosses the network at most twice, and narrow: to part, then to the orders, which
    # have met their customers by themselves. Joined to one table after the other it would cross
    # three times, with the text columns of the joins before.
    orders = od.join(cust, od.o_custkey == cust.c_custkey)
    return li.join(pa, li.l_partkey == pa.p_partkey).join(orders, li.l_orderkey == od.o_orderkey)


def business_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, region, segment, product, customer, revenue, expenses, quantity."""
    j = _lines(spark, sf_dir, extra=False)
    return j.select(
        F.col("o_orderdate").alias("date"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("p_brand").alias("product"),
        F.col("o_custkey").alias("customer"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.lit(0.6) * F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("expenses"),
        F.col("l_quantity").alias("quantity"),
    )


def finance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business view plus invented balance-sheet and customer columns.

    marketing = 4 % of list price; cash = account balance + 10 000;
    debt = part retail price; inventory = 10 x quantity; churn = discount
    (a 0-1 rate); new_customers = 1 on an order's first line.
    """
    j = _lines(spark, sf_dir, extra=True)
    return j.select(
        F.col("o_orderdate").alias("date"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("p_brand").alias("product"),
        F.col("o_custkey").alias("customer"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.lit(0.6) * F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("expenses"),
        F.col("l_quantity").alias("quantity"),
        (F.lit(0.04) * F.col("l_extendedprice")).alias("marketing"),
        (F.col("c_acctbal") + F.lit(10000.0)).alias("cash"),
        F.col("p_retailprice").alias("debt"),
        (F.lit(10.0) * F.col("l_quantity")).alias("inventory"),
        F.col("l_discount").alias("churn"),
        F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.0).alias("new_customers"),
    )


FINANCE_MAPPING = {
    "date": "date", "revenue": "revenue", "expenses": "expenses",
    "marketing_spend": "marketing", "cash_balance": "cash", "debt": "debt",
    "inventory": "inventory", "churn_rate": "churn", "new_customers": "new_customers",
}


def balance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finance view plus the columns of the other KPI branches: gross profit and cost of goods
    (45 % of expenses), active and churned customers, acquisition cost, equity and debt to equity."""
    exp, ch = F.col("expenses"), F.col("churn")
    return finance_view(spark, sf_dir).select(
        "*", (F.col("revenue") - 0.45 * exp).alias("gross_profit"), (0.45 * exp).alias("cogs"),
        (F.col("inventory") + 100.0).alias("active"), F.when(ch > 0.08, 1.0).otherwise(0.0).alias("churned"),
        (200.0 * ch + 20.0).alias("cost_per_customer"), (1.5 * F.col("debt") + 100.0).alias("equity"),
        (F.col("debt") / 1000.0).alias("leverage"))


BUSINESS_MAPPING = {"date": "date", "revenue": "revenue", "expenses": "expenses"}


def view_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business view with NULLs punched by customer-key arithmetic."""
    bv = business_view(spark, sf_dir)
    k = F.col("customer")
    return bv.select(
        F.when(k % 17 == 0, None).otherwise(F.col("date")).alias("date"),
        "region",
        F.when(k % 11 == 0, None).otherwise(F.col("segment")).alias("segment"),
        "product", "customer",
        F.when(k % 7 == 0, None).otherwise(F.col("revenue")).alias("revenue"),
        F.when(k % 5 == 3, None).otherwise(F.col("expenses")).alias("expenses"),
        F.when(k % 13 == 1, None).otherwise(F.col("quantity")).alias("quantity"),
        F.lit(None).cast("double").alias("empty"),
    )


def view_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business view with the rows of every 11th customer repeated once."""
    bv = business_view(spark, sf_dir)
    return bv.unionByName(bv.filter(F.col("customer") % 11 == 0))


def view_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue with NaN, +-inf, zero and negative values."""
    bv = business_view(spark, sf_dir)
    k = F.col("customer")
    rev = (F.when(k % 13 == 0, F.lit(float("nan")))
           .when(k % 17 == 0, F.lit(float("inf")))
           .when(k % 19 == 0, F.lit(float("-inf")))
           .when(k % 23 == 0, F.lit(0.0))
           .when(k % 29 == 0, -F.col("revenue"))
           .otherwise(F.col("revenue")))
    return bv.withColumn("revenue", rev)


def _money_text(c):
    # Whole cents by floor, then integer text: identical in every engine.
    cents = F.floor(F.abs(c) * 100).cast("bigint")
    amount = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                      F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(c < 0, F.concat(F.lit("($"), amount, F.lit(")"))).otherwise(
        F.concat(F.lit("$"), amount))


def view_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business view as text, see :func:`text_of`."""
    return text_of(business_view(spark, sf_dir))


def text_of(bv: DataFrame) -> DataFrame:
    """Numbers and dates as text: money with $ and accounting negatives,
    discount as a percent, dates in four formats chosen by key, 10 % junk."""
    k = F.col("customer")
    d = F.col("date")
    date_txt = (F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
                .when(k % 4 == 1, F.date_format(d, "MM/dd/yyyy"))
                .when(k % 4 == 2, F.date_format(d, "dd-MM-yyyy"))
                .otherwise(F.date_format(d, "yyyy/MM/dd")))
    signed = F.when(k % 29 == 0, -F.col("revenue")).otherwise(F.col("revenue"))
    junk = k % 10 == 0
    return bv.select(
        F.when(junk, F.lit("n/a")).otherwise(date_txt).alias("date_txt"),
        F.date_format(d, "yyyy-MM-dd").alias("iso_txt"),
        "region", "segment", "product", "customer",
        F.when(junk, F.lit("--")).otherwise(_money_text(signed)).alias("revenue_txt"),
        F.col("quantity").cast("bigint").cast("string").alias("quantity_txt"),
        F.concat(F.col("quantity").cast("bigint").cast("string"), F.lit("%")).alias("rate_txt"),
    )


# ----------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side).
# ----------------------------------------------------------------------------

BV_SQL = """(SELECT o.o_orderdate AS date, r.r_name AS region, c.c_mktsegment AS segment,
       p.p_brand AS product, o.o_custkey AS customer,
       l.l_extendedprice * (1 - l.l_discount) AS revenue,
       0.6 * l.l_extendedprice * (1 + l.l_tax) AS expenses,
       l.l_quantity AS quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey)"""

FV_SQL = """(SELECT o.o_orderdate AS date, r.r_name AS region, c.c_mktsegment AS segment,
       p.p_brand AS product, o.o_custkey AS customer,
       l.l_extendedprice * (1 - l.l_discount) AS revenue,
       0.6 * l.l_extendedprice * (1 + l.l_tax) AS expenses,
       l.l_quantity AS quantity,
       0.04 * l.l_extendedprice AS marketing,
       c.c_acctbal + 10000.0 AS cash,
       p.p_retailprice AS debt,
       10.0 * l.l_quantity AS inventory,
       l.l_discount AS churn,
       CASE WHEN l.l_linenumber = 1 THEN 1.0 ELSE 0.0 END AS new_customers
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey)"""

BALANCE_SQL = f"""(SELECT *, revenue - 0.45 * expenses AS gross_profit, 0.45 * expenses AS cogs,
       inventory + 100.0 AS active, CASE WHEN churn > 0.08 THEN 1.0 ELSE 0.0 END AS churned,
       200.0 * churn + 20.0 AS cost_per_customer, 1.5 * debt + 100.0 AS equity, debt / 1000.0 AS leverage
FROM {FV_SQL} fv0)"""

HOLES_SQL = f"""(SELECT CASE WHEN customer % 17 = 0 THEN NULL ELSE date END AS date, region,
       CASE WHEN customer % 11 = 0 THEN NULL ELSE segment END AS segment, product, customer,
       CASE WHEN customer % 7 = 0 THEN NULL ELSE revenue END AS revenue,
       CASE WHEN customer % 5 = 3 THEN NULL ELSE expenses END AS expenses,
       CASE WHEN customer % 13 = 1 THEN NULL ELSE quantity END AS quantity,
       CAST(NULL AS DOUBLE) AS empty
FROM {BV_SQL} bv0)"""

DUPS_SQL = f"""(SELECT * FROM {BV_SQL} d0 UNION ALL SELECT * FROM {BV_SQL} d1 WHERE customer % 11 = 0)"""

EXTREME_SQL = f"""(SELECT date, region, segment, product, customer,
       CASE WHEN customer % 13 = 0 THEN 'nan'::DOUBLE
            WHEN customer % 17 = 0 THEN 'inf'::DOUBLE
            WHEN customer % 19 = 0 THEN '-inf'::DOUBLE
            WHEN customer % 23 = 0 THEN 0.0
            WHEN customer % 29 = 0 THEN -revenue
            ELSE revenue END AS revenue,
       expenses, quantity
FROM {BV_SQL} bv0)"""

TEXT_SQL = f"""(SELECT CASE WHEN customer % 10 = 0 THEN 'n/a'
            WHEN customer % 4 = 0 THEN strftime(date, '%Y-%m-%d')
            WHEN customer % 4 = 1 THEN strftime(date, '%m/%d/%Y')
            WHEN customer % 4 = 2 THEN strftime(date, '%d-%m-%Y')
            ELSE strftime(date, '%Y/%m/%d') END AS date_txt,
       strftime(date, '%Y-%m-%d') AS iso_txt,
       region, segment, product, customer,
       CASE WHEN customer % 10 = 0 THEN '--'
            WHEN (CASE WHEN customer % 29 = 0 THEN -revenue ELSE revenue END) < 0
            THEN '($' || CAST(CAST(floor(abs(revenue) * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
                 || lpad(CAST(CAST(floor(abs(revenue) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ')'
            ELSE '$' || CAST(CAST(floor(abs(revenue) * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
                 || lpad(CAST(CAST(floor(abs(revenue) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS revenue_txt,
       CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity_txt,
       CAST(CAST(quantity AS BIGINT) AS VARCHAR) || '%' AS rate_txt
FROM {BV_SQL} bv0)"""
