"""Warehouse questions: canned aggregate templates over the star schema, and profiling.

The templates are plain DataFrame aggregates; facts shrink to their group keys before
dimension names are joined, so a join never carries fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

def amount() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c: Column) -> Column:
    return F.round(c, 2)


def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, d, "orders").groupBy(month).agg(F.count("*").alias("order_count"), money(F.sum("o_totalprice")).alias("revenue")).orderBy("month")


def revenue_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("order_count"), F.sum(amount()).alias("amount"))
    names = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return facts.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("supplier"), "order_count", money(F.col("amount")).alias("revenue")).orderBy(F.col("revenue").desc(), "supplier")


def delayed_by_supplier_region(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").where(F.lower("l_linestatus") == "o").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "r_name")
    return (
        late.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_name").alias("supplier"), F.col("r_name").alias("region"))
        .agg(F.sum("n").alias("delayed_count"))
        .orderBy(F.col("delayed_count").desc(), "supplier", "region")
    )


def top_products(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    facts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(amount()).alias("amount"), F.sum("l_quantity").alias("total_qty"))
    best = facts.orderBy(money(F.col("amount")).desc(), "l_partkey").limit(n)
    return best.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product"), money(F.col("amount")).alias("revenue"), "total_qty")


def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("order_count"), money(F.sum("o_totalprice")).alias("total_revenue")).orderBy(F.col("order_count").desc(), "status")


def revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    by_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("amount"), F.count("*").alias("n"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return (
        by_customer.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(money(F.sum("amount")).alias("revenue"), F.sum("n").alias("order_count"))
        .orderBy(F.col("revenue").desc())
    )


def priority_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("order_count"), money(F.avg("o_totalprice")).alias("avg_order_value")).orderBy(F.col("order_count").desc(), "priority")


def average_order_by_region(spark: SparkSession, d: str) -> DataFrame:
    wide = revenue_by_region(spark, d)
    return wide.select("region", money(F.col("revenue") / F.col("order_count")).alias("avg_order_value"))


def recent_orders(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(n).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_orderpriority")


def known_values(df: DataFrame, most: int = 12, columns: list[str] | None = None) -> DataFrame:
    """(column, value) of the text columns with 1 to ``most`` distinct non-null values.

    Each task keeps at most its distinct values; columns with many are dropped on an approximate
    count first, with a margin, so only few values are ever counted exactly.
    """
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string")
    guess = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if 0 < guess[c] <= 2 * most + 4]
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in few])).alias("x")).select("x.*").where(F.col("value").isNotNull()).distinct()
    kept = pairs.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("column")
    return pairs.join(kept, "column").select("column", "value")


def schema_description(df: DataFrame, name: str) -> DataFrame:
    """One row a column, with the table's row count."""
    fields = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(i + 1).alias("position")) for i, f in enumerate(df.schema.fields)])
    return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table"), F.explode(fields).alias("f"), "row_count").select("table", "f.position", "f.column", "f.type", "row_count")


def known_values_all(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "orders", "part", "lineitem"):
        rows = known_values(table(spark, d, name)).select(F.lit(name).alias("table"), "column", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def describe_orders(spark: SparkSession, d: str) -> DataFrame:
    return schema_description(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "orders")


def entity_filter(df: DataFrame, columns: list[str], needle: str, most: int = 200) -> DataFrame:
    """Rows that hold ``needle`` in one of the columns; the needle is data, never SQL text."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.lower(F.col(c)), F.lower(F.lit(needle)))
    return df.where(hit).orderBy(*df.columns).limit(most)


def low_card_sql(table_: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{table_}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {table_}" for c in columns)
    return parts


AMOUNT_SQL = "l_extendedprice * (1 - l_discount)"

QUERIES = {
    "monthly_trend": monthly_trend,
    "revenue_by_supplier": revenue_by_supplier,
    "delayed_by_supplier_region": delayed_by_supplier_region,
    "top_products": top_products,
    "status_distribution": status_distribution,
    "revenue_by_region": revenue_by_region,
    "priority_breakdown": priority_breakdown,
    "average_order_by_region": average_order_by_region,
    "recent_orders": recent_orders,
    "known_values": known_values_all,
    "schema_description": describe_orders,
    "entity_filter": lambda spark, d: entity_filter(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "build"),
}

ORACLES = {
    "monthly_trend": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1",
    "revenue_by_supplier": f"SELECT s_name AS supplier, count(*) AS order_count, round(sum({AMOUNT_SQL}), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
    "delayed_by_supplier_region": "SELECT s_name AS supplier, r_name AS region, count(*)::BIGINT AS delayed_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(l_linestatus) = 'o' GROUP BY 1, 2",
    "top_products": f"SELECT l_partkey AS product_id, p_name AS product, round(sum({AMOUNT_SQL}), 2) AS revenue, sum(l_quantity) AS total_qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue DESC, product_id LIMIT 10",
    "status_distribution": "SELECT o_orderstatus AS status, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY 1",
    "revenue_by_region": "SELECT r_name AS region, round(sum(o_totalprice), 2) AS revenue, count(*)::BIGINT AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "priority_breakdown": "SELECT o_orderpriority AS priority, count(*) AS order_count, round(avg(o_totalprice), 2) AS avg_order_value FROM orders GROUP BY 1",
    "average_order_by_region": "SELECT r_name AS region, round(round(sum(o_totalprice), 2) / count(*), 2) AS avg_order_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "recent_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "known_values": 'WITH v AS (SELECT DISTINCT * FROM ('
    + " UNION ALL ".join(low_card_sql(t, c) for t, c in {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "lineitem": ["l_returnflag", "l_linestatus"]}.items())
    + ') WHERE value IS NOT NULL) SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY "table", "column") <= 12',
    "schema_description": "SELECT * FROM (VALUES ('orders', 1, 'o_orderkey', 'bigint'), ('orders', 2, 'o_orderstatus', 'string'), ('orders', 3, 'o_totalprice', 'double')) AS t(\"table\", position, \"column\", \"type\") CROSS JOIN (SELECT count(*) AS row_count FROM orders)",
    "entity_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 200",
}
