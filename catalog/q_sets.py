"""U, O1, O3, W8: unions, duplicates, ordering, numbering."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import table
from postlens.operators import sets as U


@query("u01_union_tagged", "SELECT 'element' AS category, n_name AS name FROM nation UNION ALL SELECT 'job', r_name FROM region WHERE r_name <> 'ASIA'")
def _(spark, folder):
    elements = table(spark, folder, "nation").select(F.lit("element").alias("category"), F.col("n_name").alias("name"))
    return U.union_tagged(elements, table(spark, folder, "region").select(F.col("r_name").alias("name")), excluded="ASIA")


@query("o01_sort_by_name", "SELECT 'part' AS category, p_name AS name FROM part UNION ALL SELECT 'job', s_name FROM supplier WHERE s_name <> 'Supplier#000000003'")
def _(spark, folder):
    elements = table(spark, folder, "part").select(F.lit("part").alias("category"), F.col("p_name").alias("name"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    return U.union_tagged(elements, suppliers, excluded="Supplier#000000003").orderBy("name")


@query("u03_union_missing_columns", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return U.union_missing_columns(a, b)


@query("u04_union_replace_subset", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("done"))
    return U.union_replace_subset(orders, F.col("o_orderstatus") == "F", done)


@query("u05_drop_duplicate_rows", "SELECT DISTINCT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem)")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return U.drop_duplicate_rows(lines.unionByName(lines))


@query("u06_drop_duplicate_keys", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def _(spark, folder):
    return U.first_per_key(table(spark, folder, "part").select("p_name", "p_partkey"), ["p_name"], [F.asc("p_partkey")])


@query("u07_accumulate_snapshots", """
SELECT o_custkey, o_orderpriority, max(o_orderdate)::DATE::VARCHAR AS stamp, bool_or(o_orderstatus = 'O' AND o_orderdate = m) AS today FROM
(SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority) AS m FROM orders) GROUP BY o_custkey, o_orderpriority""")
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"), (F.col("o_orderstatus") == "O").alias("today"))
    return U.accumulate_snapshots(rows.filter(~F.col("today")), rows.filter("today"), ["o_custkey", "o_orderpriority"], "stamp")


TYPES = ("PROMO", "ECONOMY", "STANDARD")


@query("o03_sort_custom_order", """
SELECT p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END::BIGINT AS ord FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD')""")
def _(spark, folder):
    rows = U.sort_custom_order(table(spark, folder, "part").select("p_partkey", "p_type"), "p_type", TYPES)
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query("w08_number_rows_in_order", """
SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END, p_name, p_partkey) - 1 AS seq
FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD')""")
def _(spark, folder):
    rows = U.sort_custom_order(table(spark, folder, "part").select("p_partkey", "p_type", "p_name"), "p_type", TYPES)
    return U.number_rows(rows, ["ord", "p_name", "p_partkey"]).select("p_partkey", "seq")
