"""Point-in-time snapshots: visibility, revision lineages, the trust boundary."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.schema import AUDIT_COLUMNS, ECONOMIC_KEY

LINEAGE = r"(?s)^(.+)#r([1-9][0-9]*)$"


def visible(as_of: date | str) -> Column:
    """available_on <= as_of, inclusive."""
    return F.col("available_on") <= F.lit(str(as_of)).cast("date")


def with_lineage(facts: DataFrame) -> DataFrame:
    """lineage_id and seq of declared revisions; null for independent records."""
    key = F.col("source_row_key")
    # Most keys name no revision: a plain search settles them.
    known = key.contains("#r") & key.rlike(LINEAGE)
    return facts.withColumns({"lineage_id": F.when(known, F.regexp_extract(key, LINEAGE, 1)), "seq": F.when(known, F.regexp_extract(key, LINEAGE, 2).try_cast("long"))})


def lineage_violations(facts: DataFrame) -> DataFrame:
    """(lineage_id, violation) over all members of every lineage, the ones not yet visible too."""
    own = with_lineage(facts).filter("lineage_id IS NOT NULL")
    w = Window.partitionBy("lineage_id").orderBy("seq", "record_id")
    before = own.withColumns({"p_seq": F.lag("seq").over(w), "p_av": F.lag("available_on").over(w), "p_filed": F.lag("filed_on").over(w), "key": F.xxhash64(*ECONOMIC_KEY), "p_key": F.lag(F.xxhash64(*ECONOMIC_KEY)).over(w)})
    bad = F.array_compact(F.array(
        F.when(F.col("seq") == F.col("p_seq"), F.lit("duplicate_sequence")),
        F.when(F.col("key") != F.col("p_key"), F.lit("mixed_economic_key")),
        F.when(F.col("available_on") < F.col("p_av"), F.lit("available_on_decreases")),
        F.when(F.col("filed_on") < F.col("p_filed"), F.lit("filed_on_decreases")),
    ))
    return before.select("lineage_id", F.explode(bad).alias("violation")).groupBy("lineage_id", "violation").agg(F.count("*").alias("members"))


class AmbiguousHistory(ValueError):
    """A revision lineage contradicts itself."""


def assert_lineages(facts: DataFrame) -> None:
    """An action of its own, before any filter on visibility."""
    if (bad := lineage_violations(facts).limit(1).collect()):
        raise AmbiguousHistory(f"{bad[0].lineage_id}: {bad[0].violation}")


def snapshot(facts: DataFrame, as_of: date | str, check: bool = False) -> DataFrame:
    """Visible independent records, as they are, and the latest visible revision of every lineage."""
    if check:
        assert_lineages(facts)
    seen = with_lineage(facts).filter(visible(as_of))
    latest = Window.partitionBy("lineage_id").orderBy(F.desc("seq"), "record_id")
    revised = seen.filter("lineage_id IS NOT NULL").withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r")
    return seen.filter("lineage_id IS NULL").unionByName(revised)


def sanitize(facts: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The audit input: allowed columns only, after those that keep several audits apart."""
    return facts.select(*scope, *AUDIT_COLUMNS)
