"""Tenant views: the given customer and order tables as three tenants would name and type them.

They show what the given tables alone cannot: nulls, type mismatches and naming noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# file name -> (source table, columns as SQL). The same text runs in Spark and in the oracle.
TENANT_VIEWS = {
    "customers_us.parquet": (
        "customer",
        "c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id, "
        "c_acctbal AS account_balance, c_mktsegment AS market_segment",
    ),
    "eu_customers.parquet": (
        "customer",
        "c_custkey AS customerId, c_name AS customerName, c_nationkey AS nationId, "
        "c_acctbal AS accountBalance, c_mktsegment AS segment",
    ),
    "customersAsia.parquet": (
        "customer",
        "cast(c_custkey AS string) AS cust_id, c_name AS cust_name, cast(c_nationkey AS string) AS nation_id, "
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS acct_bal, "
        "nullif(c_mktsegment, 'BUILDING') AS segment",
    ),
    "orders_us.parquet": (
        "orders",
        "o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, "
        "o_totalprice AS total_price, o_orderstatus AS status, o_orderpriority AS priority",
    ),
    "eu_orders.parquet": (
        "orders",
        "o_orderkey AS orderId, o_custkey AS customerId, o_orderdate AS orderDate, "
        "o_totalprice AS orderTotal, o_orderstatus AS orderState, o_orderpriority AS priority",
    ),
    "ordersAsia.parquet": (
        "orders",
        "o_orderkey AS orderID, o_custkey AS cust_id, cast(o_orderdate AS string) AS orderDt, "
        "cast(o_totalprice AS string) AS total_price, nullif(o_orderstatus, 'F') AS status, "
        "o_orderpriority AS priority",
    ),
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def given_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tenant_views(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    sources = {name: given_table(spark, folder, name) for name in ("customer", "orders")}
    return {
        name: sources[source].selectExpr(*_columns(columns)) for name, (source, columns) in TENANT_VIEWS.items()
    }


def _columns(listed: str) -> list[str]:
    """The items of a select list; commas inside parentheses do not separate."""
    items, depth, start = [], 0, 0
    for i, char in enumerate(listed):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            items.append(listed[start:i].strip())
            start = i + 1
    return items + [listed[start:].strip()]
