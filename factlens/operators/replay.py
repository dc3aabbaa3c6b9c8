"""Replay: undo a fault from its manifest, and what is left different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.operators.inject import LATER


def _restore(corrupted: DataFrame, manifest: DataFrame, changes: dict[str, Column]) -> DataFrame:
    marked = corrupted.join(manifest, corrupted["record_id"] == manifest["injected_record_id"], "left")
    hit = F.col("injected_record_id").isNotNull()
    return marked.select(*[F.when(hit, changes[c]).otherwise(corrupted[c]).alias(c) if c in changes else corrupted[c] for c in corrupted.columns])


def replay(family: str, corrupted: DataFrame, manifest: DataFrame) -> DataFrame:
    back = {"record_id": F.col("original_record_id")}
    if family == "lookahead":
        return _restore(corrupted, manifest, back | {"available_on": F.col("original_available_on")})
    if family == "unit_drift":
        return _restore(corrupted, manifest, back | {"value": F.col("original_value")})
    if family == "revision_overwrite":
        return _restore(corrupted, manifest, back | {c: F.col(f"original.{c}") for c in LATER})
    if family == "duplicate":
        return corrupted.join(manifest.select(F.col("injected_record_id").alias("record_id")), "record_id", "left_anti")
    if family == "missing":
        return corrupted.unionByName(manifest.select(*corrupted.columns))
    raise ValueError(f"unknown family {family}")


def residual(clean: DataFrame, repaired: DataFrame) -> DataFrame:
    """Rows of one side only, both ways, counting copies: zero and zero after an exact replay. One aggregation, no pairing."""
    tagged = clean.withColumn("_side", F.lit(1)).unionByName(repaired.withColumn("_side", F.lit(-1)))
    net = tagged.groupBy(*clean.columns).agg(F.sum("_side").alias("net"))
    return net.agg(F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("only_clean"), F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("only_repaired"))
