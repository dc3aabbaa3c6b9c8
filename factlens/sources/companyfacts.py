"""Nested company-facts JSON (taxonomy, concept, unit, entries): flattened with a reason for every entry left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ident import stable_id
from factlens.schema import DIMENSIONS
from factlens.sources.mapping import DATE, DECIMAL

ENTRY = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string,frame:string>"
#: Numbers are text, so no digit is lost.
SCHEMA = f"cik string, entityName string, facts map<string, map<string, struct<label:string, description:string, units:map<string, array<{ENTRY}>>>>>"


@dataclass(frozen=True)
class Rules:
    taxonomies: tuple[str, ...]
    concepts: tuple[str, ...]
    units: tuple[str, ...]
    forms: tuple[str, ...]
    filed: tuple[str, str]


def flatten(raw: DataFrame, rules: Rules) -> DataFrame:
    """One row for each entry of `raw` (json) with `reason`: null if it is accepted, else why it is not, in a fixed order."""
    # The parser would turn long numbers into doubles, so they are quoted first.
    quoted = F.regexp_replace("json", r'(?<!\\)("val"\s*:\s*)(-?[0-9][0-9.eE+-]*)', '$1"$2"')
    doc = raw.select(F.from_json(quoted, SCHEMA).alias("d"))
    rows = (
        doc.select("d.cik", "d.entityName", F.explode("d.facts").alias("taxonomy", "concepts"))
        .select("cik", "entityName", "taxonomy", F.explode("concepts").alias("concept", "c"))
        .select("cik", "entityName", "taxonomy", "concept", F.explode("c.units").alias("unit", "entries"))
        .select("cik", "entityName", "taxonomy", "concept", "unit", F.explode("entries").alias("e"))
    )
    filed = F.when(F.col("e.filed").rlike(DATE), F.try_to_date("e.filed", "yyyy-MM-dd"))
    end = F.when(F.col("e.end").rlike(DATE), F.try_to_date("e.end", "yyyy-MM-dd"))
    start = F.when(F.col("e.start").rlike(DATE), F.try_to_date("e.start", "yyyy-MM-dd"))
    bad = [
        (~F.col("taxonomy").isin(*rules.taxonomies), "taxonomy_not_allowed"),
        (~F.col("concept").isin(*rules.concepts), "concept_not_allowed"),
        (~F.col("unit").isin(*rules.units), "unit_not_allowed"),
        (~F.coalesce(F.col("e.form").isin(*rules.forms), F.lit(False)), "form_not_allowed"),
        (filed.isNull() | ~filed.between(*[F.lit(x).cast("date") for x in rules.filed]), "filed_out_of_range"),
        (end.isNull() | (F.col("e.start").isNotNull() & (start.isNull() | (start > end))), "period_shape"),
        (~F.coalesce(F.col("e.val").rlike(DECIMAL), F.lit(False)), "value_not_decimal"),
    ]
    return rows.withColumns({"reason": F.coalesce(*[F.when(b, F.lit(r)) for b, r in bad]), "start_on": start, "end_on": end, "filed": filed})


def facts(flat: DataFrame) -> DataFrame:
    """Accepted entries as facts; the nth copy of an identical entry gets the ordinal n. available_on is the filing date."""
    ok = flat.filter("reason IS NULL").withColumn("entry", F.to_json(F.struct("cik", "taxonomy", "concept", "unit", "e")))
    # Copies are identical, so their order does not matter.
    ok = ok.withColumn("ordinal", F.row_number().over(Window.partitionBy("entry").orderBy("entry")))
    key = F.concat(F.substring(F.sha2("entry", 256), 1, 32), F.lit("-"), "ordinal")
    kind = F.when(F.col("start_on").isNull(), "instant").otherwise("duration")
    return ok.select(
        stable_id("rec", "companyfacts", key).alias("record_id"), F.lpad("cik", 10, "0").alias("entity_id"), F.col("entityName").alias("entity_name"), F.col("taxonomy").alias("concept_namespace"), "concept",
        F.col("e.val").try_cast("decimal(28,6)").alias("value"), "unit", F.array().cast(DIMENSIONS).alias("dimensions"), kind.alias("period_type"), F.col("start_on").alias("period_start"), F.col("end_on").alias("period_end"), F.col("filed").alias("filed_on"), F.col("filed").alias("available_on"),
        F.col("e.form").alias("form"), F.col("e.accn").alias("accession_number"), F.lit("companyfacts").alias("source_name"), F.lit("companyfacts").alias("source_locator"), key.alias("source_row_key"),
    )


def exclusions(flat: DataFrame) -> DataFrame:
    return flat.filter("reason IS NOT NULL").select("reason", "taxonomy", "concept", "unit", F.col("e.accn").alias("accession_number"))
