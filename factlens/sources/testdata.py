"""Fact tables derived from the star-schema tables: independent order facts and declared revision lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ident import stable_id
from factlens.schema import DIMENSIONS


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instant fact an order, with planted leaks, scale errors, overwritten revisions and copies."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    lag = (7 + F.pmod(k, F.lit(40))).cast("int")
    filed = F.date_add(day, (lag + F.when(k % 113 == 0, 400).otherwise(0)).cast("int"))
    money = F.col("o_totalprice").cast("decimal(18,2)")
    base = _read(spark, sf_dir, "orders").select(
        k.alias("k"), F.concat(F.lit("C"), F.col("o_custkey")).alias("entity_id"), F.lit(None).cast("string").alias("entity_name"), F.lit("orders").alias("concept_namespace"), F.lit("TotalPrice").alias("concept"),
        F.when(k % 151 == 0, money * 1000).otherwise(money).cast("decimal(28,6)").alias("value"), F.lit("USD").alias("unit"), F.array().cast(DIMENSIONS).alias("dimensions"),
        F.lit("instant").alias("period_type"), F.lit(None).cast("date").alias("period_start"), day.alias("period_end"), filed.alias("filed_on"),
        F.when(k % 97 == 0, day).when(k % 113 == 0, F.date_add(day, lag)).otherwise(filed).alias("available_on"),
        F.col("o_orderpriority").alias("form"), F.concat(F.lit("A"), k).alias("accession_number"), F.lit("orders").alias("source_name"), F.lit("testdata/orders").alias("source_locator"), F.concat(F.lit("o-"), k).alias("source_row_key"),
    )
    kinds = F.when(k % 211 == 0, F.array(F.lit("orders"), F.lit("orders-copy"))).otherwise(F.array(F.lit("orders")))
    both = base.withColumnRenamed("k", "o_orderkey").withColumn("kind", F.explode(kinds))
    return both.withColumn("record_id", stable_id("rec", F.col("kind"), k)).select("record_id", *[c for c in base.columns if c != "k"])


def lineages_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision lineages: line items of one order and line number, by ship date."""
    items, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    # Dealt by order, the rows lie as the window and the join need them: one shuffle for both.
    ranked = items.repartition("l_orderkey").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.row_number().over(w).alias("seq"))
    lineage = F.concat(F.lit("L"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    key = F.concat(lineage, F.lit("#r"), F.col("seq"))
    day = F.col("l_shipdate").cast("date")
    return ranked.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        stable_id("rec", "lineitem", key).alias("record_id"), F.concat(F.lit("C"), F.col("o_custkey")).alias("entity_id"), F.lit(None).cast("string").alias("entity_name"), F.lit("lineitem").alias("concept_namespace"), F.lit("ExtendedPrice").alias("concept"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("decimal(28,6)").alias("value"), F.lit("USD").alias("unit"), F.array().cast(DIMENSIONS).alias("dimensions"), F.lit("instant").alias("period_type"), F.lit(None).cast("date").alias("period_start"),
        F.col("o_orderdate").cast("date").alias("period_end"), day.alias("filed_on"), day.alias("available_on"), F.lit("LI").alias("form"), F.concat(F.lit("A-"), key).alias("accession_number"), F.lit("lineitem").alias("source_name"), F.lit("testdata/lineitem").alias("source_locator"), key.alias("source_row_key"),
    )


#: The same tables in SQL, as common table expressions `facts` and `lineages`.
FACTS_SQL = """
ord AS (SELECT o_orderkey AS k, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS m, o_orderpriority FROM orders),
base AS (SELECT k, 'C' || o_custkey AS entity_id, 'orders' AS concept_namespace, 'TotalPrice' AS concept, CAST(CASE WHEN k % 151 = 0 THEN m * 1000 ELSE m END AS DECIMAL(28,6)) AS value, 'USD' AS unit, 'instant' AS period_type,
  d AS period_end, CAST(d + CAST(7 + k % 40 + CASE WHEN k % 113 = 0 THEN 400 ELSE 0 END AS INTEGER) AS DATE) AS filed_on,
  CAST(CASE WHEN k % 97 = 0 THEN d WHEN k % 113 = 0 THEN d + CAST(7 + k % 40 AS INTEGER) ELSE d + CAST(7 + k % 40 AS INTEGER) END AS DATE) AS available_on,
  o_orderpriority AS form, 'A' || k AS accession_number, 'orders' AS source_name, 'testdata/orders' AS source_locator, 'o-' || k AS source_row_key FROM ord),
facts AS (SELECT 'rec_' || left(sha256(kind || '|' || k), 16) AS record_id, base.* EXCLUDE (k, kind) FROM (SELECT base.*, unnest(CASE WHEN k % 211 = 0 THEN ['orders', 'orders-copy'] ELSE ['orders'] END) AS kind FROM base) AS base)
"""
LINEAGES_SQL = """
li AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq FROM lineitem),
lineages AS (SELECT 'L' || l_orderkey || '-' || l_linenumber AS lineage_id, CAST(seq AS BIGINT) AS seq, 'rec_' || left(sha256('lineitem|L' || l_orderkey || '-' || l_linenumber || '#r' || seq), 16) AS record_id, 'C' || o_custkey AS entity_id,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,6)) AS value, CAST(o_orderdate AS DATE) AS period_end, d AS filed_on, d AS available_on FROM li JOIN orders ON l_orderkey = o_orderkey)
"""
