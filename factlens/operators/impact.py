"""Research figures and how far a fault moved them: clean, corrupted, repaired."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.operators.pit import snapshot, visible
from factlens.operators.ranks import total_rank


def states(**by_state: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("state", F.lit(s)) for s, df in by_state.items()])


def availability_count(facts: DataFrame, research_date: date | str) -> DataFrame:
    return facts.groupBy("state").agg(F.count_if(visible(research_date)).cast("decimal(38,6)").alias("figure"))


def aggregate_value(facts: DataFrame) -> DataFrame:
    return facts.groupBy("state").agg(F.sum("value").cast("decimal(38,6)").alias("figure"))


def record_count(facts: DataFrame) -> DataFrame:
    return facts.groupBy("state").agg(F.count("*").cast("decimal(38,6)").alias("figure"))


def cohort_mean(expectations: DataFrame, facts: DataFrame, as_of: date | str, several: str = "raise") -> DataFrame:
    """Sum over count of observed due expectations, per state, in decimals; null where none is observed.

    Several facts that meet one expectation are an error of the data: they raise, as which one counts is not known. With `several`
    "count" every one of them is an observation of its own: the mean is that of all facts that were expected.
    """
    if several not in ("raise", "count"):
        raise ValueError(f"several must be raise or count, not {several}")
    due = expectations.filter(F.col("expected_by") <= F.lit(str(as_of)).cast("date"))
    key = ["entity_id", "concept_namespace", "concept", "unit", "period_end"]
    seen = facts.filter(visible(as_of)).join(due.select(*key, "expected_observation_id"), key)
    each = seen.groupBy("state", "expected_observation_id").agg(F.first("value").alias("value"), F.count("*").alias("n")) if several == "raise" else seen.withColumn("n", F.lit(1))
    once = each.withColumn("value", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("several facts meet "), "expected_observation_id")).cast("decimal(28,6)")))
    mean = once.groupBy("state").agg((F.sum("value") / F.count("*").cast("decimal(20,0)")).cast("decimal(38,6)").alias("figure"))
    return facts.select("state").distinct().join(mean, "state", "left")


def impact(figures: DataFrame) -> DataFrame:
    """One row: clean, corrupted, repaired, delta, relative change (null over zero) and whether the repair is exact."""
    at = {s: F.max(F.when(F.col("state") == s, F.col("figure"))).alias(s) for s in ("clean", "corrupted", "repaired")}
    row = figures.agg(*at.values())
    delta = F.col("corrupted") - F.col("clean")
    return row.select("clean", "corrupted", "repaired", delta.cast("decimal(38,6)").alias("delta"), F.round(F.try_divide(delta.cast("double"), F.abs(F.col("clean")).cast("double")), 9).alias("relative"), (delta != 0).alias("changed"), (F.col("clean") == F.col("repaired")).alias("exact_restoration"))


def growth_ranking(facts: DataFrame, prior: tuple[str, str], current: tuple[str, str], top: int | None = None) -> DataFrame:
    """Growth of the sum of an entity between two ranges of period_end, ranked without ties by growth, then entity; a zero or absent prior is excluded.

    Without `top` every entity is ranked, range by range.
    """
    role = F.when(F.col("period_end").between(*[F.lit(x).cast("date") for x in prior]), "prior").when(F.col("period_end").between(*[F.lit(x).cast("date") for x in current]), "current")
    sums = facts.withColumn("role", role).filter("role IS NOT NULL").groupBy("entity_id").agg(*[F.sum(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ("prior", "current")])
    growth = F.round((F.col("current") - F.col("prior")).cast("double") / F.abs(F.col("prior")).cast("double"), 9)
    rows = sums.filter("prior != 0 AND current IS NOT NULL").select("entity_id", growth.alias("growth"))
    if top is None:
        return total_rank(rows, ["-growth", "entity_id"]).withColumn("rank", F.col("rank") + 1)
    rows = rows.orderBy(F.desc("growth"), "entity_id").limit(top)  # before the one-partition window
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("growth"), "entity_id")).cast("long"))


def ranking_change(clean: DataFrame, other: DataFrame) -> DataFrame:
    """Entities of either ranking whose rank or membership changed."""
    a, b = clean.select("entity_id", F.col("rank").alias("clean_rank")), other.select("entity_id", F.col("rank").alias("other_rank"))
    return a.join(b, "entity_id", "full_outer").filter(~F.col("clean_rank").eqNullSafe(F.col("other_rank")))


@dataclass(frozen=True)
class GrowthContext:
    """One concept in one unit, and the two periods that are compared; an instant has no start. Dates as text."""

    concept_namespace: str
    concept: str
    unit: str
    period_type: str
    prior: tuple[str | None, str]
    current: tuple[str | None, str]

    def fits(self) -> Column:
        """Facts of the context without dimensions."""
        own = [F.col(c) == getattr(self, c) for c in ("concept_namespace", "concept", "unit", "period_type")]
        return reduce(Column.__and__, own) & (F.size("dimensions") == 0)

    def role(self) -> Column:
        """prior, current or null: both ends of the period must be equal, an absent start to an absent one."""
        same = lambda p: F.col("period_start").eqNullSafe(F.lit(p[0]).cast("date")) & F.col("period_end").eqNullSafe(F.lit(p[1]).cast("date"))
        return F.when(same(self.prior), "prior").when(same(self.current), "current")


class VintageConflict(ValueError):
    """A frozen state holds what was not known on its day."""


def frozen_vintage(historical: DataFrame, frozen_on: date | str, history: DataFrame, research_on: date | str, context: GrowthContext) -> DataFrame:
    """An earlier state as it was, and the current period's facts as they were known later: what a researcher of that day compares.

    `historical` is a snapshot (clean, corrupted or repaired) as of `frozen_on`. Raises if that day is not before `research_on`, or
    if the snapshot already holds facts of the current period.
    """
    if str(frozen_on) >= str(research_on):
        raise VintageConflict(f"frozen on {frozen_on}, which is not before {research_on}")
    current = context.fits() & (context.role() == "current")
    if (bad := historical.filter(current).select("record_id").first()) is not None:
        raise VintageConflict(f"{bad.record_id}: the frozen state holds the current period")
    return historical.unionByName(snapshot(history, research_on).filter(current).select(*historical.columns))


def inconsistent(snapshot_facts: DataFrame, historical: DataFrame) -> DataFrame:
    """Record ids whose rows in a stored snapshot are not the rows of the one built from history, copies counted."""
    columns = sorted(historical.columns)
    tagged = snapshot_facts.select(*columns, F.lit(1).alias("_side")).unionByName(historical.select(*columns, F.lit(-1).alias("_side")))
    return tagged.groupBy(*columns).agg(F.sum("_side").alias("_net")).filter("_net != 0").select("record_id").distinct()
