"""Schemas of facts, audit input and findings, and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.DecimalType(28, 6)
DIMENSIONS = T.ArrayType(T.StructType([T.StructField("axis", T.StringType()), T.StructField("member", T.StringType())]))
FACT = T.StructType(
    [T.StructField(n, T.StringType(), n == "entity_name") for n in ("record_id", "entity_id", "entity_name", "concept_namespace", "concept")]
    + [T.StructField("value", VALUE, False), T.StructField("unit", T.StringType(), False), T.StructField("dimensions", DIMENSIONS, False), T.StructField("period_type", T.StringType(), False)]
    + [T.StructField(n, T.DateType(), n == "period_start") for n in ("period_start", "period_end", "filed_on", "available_on")]
    + [T.StructField(n, T.StringType(), n in ("form", "accession_number")) for n in ("form", "accession_number", "source_name", "source_locator", "source_row_key")]
)
#: What detectors may see. An allow-list: a new fact column stays out until it is named here.
AUDIT_COLUMNS = ("record_id", "entity_id", "concept_namespace", "concept", "value", "unit", "dimensions", "period_type", "period_start", "period_end", "filed_on", "available_on", "form", "accession_number", "source_name", "source_locator")
ECONOMIC_KEY = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type", "period_start", "period_end")
FINGERPRINT = ("entity_id", "concept_namespace", "concept", "value", "unit", "dimensions", "period_type", "period_start", "period_end", "filed_on", "available_on", "accession_number", "source_name", "source_locator")
TOKENS = ("record_id", "entity_id", "concept_namespace", "concept", "unit", "source_name", "source_locator", "source_row_key")


def is_token(c: Column) -> Column:
    """Trimmed, 1 to 512 characters, no control characters."""
    # Plain text is settled by one look at it; whatever else it holds is looked at by rule.
    return c.isNotNull() & (c.rlike(r"^[!-~]{1,512}\z") | F.length(c).between(1, 512) & ~c.rlike(r"(?U)^\s|\s$") & ~c.rlike(r"[\x00-\x1f\x7f]"))


def fact_errors(facts: DataFrame) -> DataFrame:
    """(record_id, error) of facts that break a rule of their schema; the first broken rule is named."""
    error = F.coalesce(
        *[F.when(~is_token(F.col(c)), F.lit(f"{c}.invalid_token")) for c in TOKENS],
        F.when(F.col("value").isNull(), F.lit("value.missing")),
        F.when(~F.col("period_type").isin("instant", "duration"), F.lit("period_type.invalid")),
        F.when((F.col("period_type") == "instant") & F.col("period_start").isNotNull(), F.lit("period_start.not_allowed")),
        F.when((F.col("period_type") == "duration") & (F.col("period_start").isNull() | (F.col("period_start") > F.col("period_end"))), F.lit("period_start.invalid")),
        F.when(F.size(F.array_distinct(F.col("dimensions.axis"))) < F.size("dimensions"), F.lit("dimensions.repeated_axis")),
    )
    return facts.select("record_id", error.alias("error")).filter("error IS NOT NULL")
