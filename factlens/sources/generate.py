"""Derived inputs: expectations, and the performance corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import stable_id
from factlens.schema import DIMENSIONS


def customer_expectations(spark: SparkSession, sf_dir: str, days: tuple[str, ...], context: str = "random") -> DataFrame:
    """An expectation for each customer and day, due after 60 days."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(F.array(*map(F.lit, days))).alias("d"))
    return rows.select(
        F.concat_ws("-", F.lit("exp"), "c_custkey", "d").alias("expected_observation_id"), F.lit(context).alias("context"), F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.lit("orders").alias("concept_namespace"), F.lit("TotalPrice").alias("concept"), F.lit("USD").alias("unit"),
        F.array().cast(DIMENSIONS).alias("dimensions"), F.lit("instant").alias("period_type"), F.lit("orders").alias("source_name"), F.lit("testdata/orders").alias("source_locator"), F.lit(None).cast("date").alias("period_start"),
        F.col("d").cast("date").alias("period_end"), F.date_add(F.col("d").cast("date"), 60).alias("expected_by"),
    )


def _fact(entity: Column, concept: Column, period_end: Column, value: Column, filed: Column, available: Column, name: str) -> list[Column]:
    key = F.concat_ws("-", entity, concept, period_end.cast("string"))
    text = {"entity_name": entity, "concept_namespace": F.lit(name), "concept": concept, "unit": F.lit("USD"), "form": F.lit("10-Q"), "accession_number": F.concat(F.lit("A-"), key), "source_name": F.lit(name), "source_locator": F.lit(f"generated/{name}"), "source_row_key": key}
    return [stable_id("rec", name, key).alias("record_id"), entity.alias("entity_id"), *[c.alias(n) for n, c in text.items()], value.cast("decimal(28,6)").alias("value"), F.array().cast(DIMENSIONS).alias("dimensions"), F.lit("instant").alias("period_type"), F.lit(None).cast("date").alias("period_start"), period_end.alias("period_end"), filed.alias("filed_on"), available.alias("available_on")]


def performance_facts(entities: DataFrame, periods: int = 20, start: str = "2000-03-31") -> DataFrame:
    """Facts of `periods` quarters of 91 days for each row of `entities` (i: a number); filed after 30 days and available after 2 more."""
    rows = entities.select(F.col("i").cast("long").alias("i")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    end = F.date_add(F.lit(start).cast("date"), F.col("p") * 91)
    return rows.select(*_fact(F.concat(F.lit("E"), "i"), F.lit("Revenue"), end, 1000 + 10 * F.col("p") + F.col("i"), F.date_add(end, 30), F.date_add(end, 32), "performance"))


def performance_corpus(spark: SparkSession, entities: int, periods: int = 20, start: str = "2000-03-31") -> DataFrame:
    """performance_facts of as many entities as are asked for."""
    return performance_facts(spark.range(entities).withColumnRenamed("id", "i"), periods, start)
