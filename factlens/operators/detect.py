"""Detectors: they read audit input alone and return findings."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ident import stable_id
from factlens.functions.ratios import ratio_at_least, symmetric_ratio
from factlens.operators.pit import visible
from factlens.operators.series import comparable_series, duplicate_groups, nearest_nonzero

FACTORS = (100, 1000, 1_000_000)
RULES = {
    "lookahead": "temporal.period_end_available_before_filing",
    "unit_drift": "value.scale_discontinuity",
    "duplicate": "occurrence.exact_duplicate",
    "revision_overwrite": "revision.later_vintage_in_earlier_state",
    "missing": "observation.expected_but_missing",
}


def _as_of(d: date | str) -> Column:
    return F.lit(str(d)).cast("date")


def lookahead(audit: DataFrame, as_of: date | str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows available on their period's end although filed later: a pure filter, no shuffle."""
    leaked = F.datediff("filed_on", "available_on")
    severity = F.when(leaked >= 30, "high").when(leaked >= 14, "medium").otherwise("low")
    hit = (F.col("available_on") == F.col("period_end")) & (F.col("available_on") < F.col("filed_on")) & visible(as_of)
    return audit.filter(hit).select(*scope, "record_id", "entity_id", leaked.cast("long").alias("leaked_days"), severity.alias("severity"), F.lit("proven_by_contract").alias("confidence"))


def revision_overwrite(audit: DataFrame, as_of: date | str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows visible before they were filed."""
    hit = F.col("accession_number").isNotNull() & visible(as_of) & (F.col("filed_on") > _as_of(as_of))
    return audit.filter(hit).select(*scope, "record_id", "entity_id", "accession_number", "filed_on", "available_on", F.lit("high").alias("severity"), F.lit("proven_by_contract").alias("confidence"))


def exact_duplicates(audit: DataFrame, as_of: date | str, scope: tuple[str, ...] = ()) -> DataFrame:
    """One finding for each group of two or more rows of equal fingerprint."""
    groups = duplicate_groups(audit, as_of, scope, least=2)
    return groups.select(*scope, "entity_id", "record_ids", F.concat_ws("|", "record_ids").alias("affected"), "members", F.lit("medium").alias("severity"), F.lit("proven_by_contract").alias("confidence"))


def unit_drift(audit: DataFrame, as_of: date | str, threshold: int = 50, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows far from all nearest neighbours that a scale factor brings back near all of them; the best factor is named."""
    near = nearest_nonzero(comparable_series(audit, as_of, scope=scope), scope)
    v, sides = F.col("value"), (F.col("previous_value"), F.col("next_value"))
    gate = [n.isNull() | ratio_at_least(v, n, threshold) for n in sides]
    options = []
    for factor in FACTORS:
        f = F.lit(factor).cast("decimal(9,0)")
        for rank, name in enumerate(("divide", "multiply")):
            # value / factor against n is value against n * factor: no division, no lost digit.
            left = v if name == "divide" else v * f
            after = [(n * f if name == "divide" else n) for n in sides]
            valid = (after[0].isNull() | ~ratio_at_least(left, after[0], threshold)) & (after[1].isNull() | ~ratio_at_least(left, after[1], threshold))
            ratios = [F.coalesce(symmetric_ratio(left, n), F.lit(0.0)) for n in after]
            options.append(F.when(valid, F.struct(F.greatest(*ratios).alias("worst"), (ratios[0] + ratios[1]).alias("total"), F.lit(factor).alias("factor"), F.lit(rank).alias("rank"), F.lit(name).alias("operation"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    found = near.filter(gate[0] & gate[1]).withColumn("best", best).filter("best IS NOT NULL")
    severity = F.when(F.col("best.factor") == 100, "low").when(F.col("best.factor") == 1000, "medium").otherwise("high")
    both = F.col("previous_value").isNotNull() & F.col("next_value").isNotNull()
    return found.select(*scope, "record_id", "entity_id", F.col("best.factor").cast("long").alias("factor"), F.col("best.operation").alias("operation"), severity.alias("severity"), F.when(both, "strong").otherwise("suspicious").alias("confidence"))


EXPECTED_KEY = ("entity_id", "concept_namespace", "concept", "unit", "period_type", "period_end", "source_name", "source_locator")
CONTEXT_SEVERITY = {"random": "low", "periodic_gap": "medium", "entity_dependent": "medium", "concept_dependent": "medium", "survivorship": "high", "source_outage": "high"}


def missing_observations(audit: DataFrame, expectations: DataFrame, as_of: date | str) -> DataFrame:
    """Due expectations without a visible row, with the nearest visible rows before and after as support."""
    return with_support(absent_observations(audit, expectations, as_of), audit.filter(visible(as_of)))


def absent_observations(audit: DataFrame, expectations: DataFrame, as_of: date | str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Due expectations without a visible row; `scope`: columns of both that keep rows apart."""
    due = expectations.filter(F.col("expected_by") <= _as_of(as_of))
    seen = audit.filter(visible(as_of))
    match = [F.col(f"e.{c}") == F.col(f"a.{c}") for c in (*scope, *EXPECTED_KEY)] + [F.col("e.period_start").eqNullSafe(F.col("a.period_start")), F.col("e.dimensions") == F.col("a.dimensions")]
    return due.alias("e").join(seen.alias("a"), reduce(Column.__and__, match), "left_anti")


def with_support(absent: DataFrame, seen: DataFrame) -> DataFrame:
    """As-of join both ways: one shuffle of both sides on the series, then running last and first."""
    series = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type", "source_name", "source_locator")
    asks = absent.select(*series, "period_end", F.col("expected_observation_id").alias("ask"), "context", F.lit(None).cast("string").alias("record_id"))
    rows = seen.select(*series, "period_end", F.lit(None).cast("string").alias("ask"), F.lit(None).cast("string").alias("context"), "record_id")
    w = Window.partitionBy(*series).orderBy("period_end", "record_id")
    near = asks.unionByName(rows).withColumns({
        "previous_end": F.last(F.when(F.col("record_id").isNotNull(), F.col("period_end")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_end": F.first(F.when(F.col("record_id").isNotNull(), F.col("period_end")), True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).filter("ask IS NOT NULL")
    severity = F.coalesce(*[F.when(F.col("context") == c, F.lit(s)) for c, s in CONTEXT_SEVERITY.items()], F.lit("low"))
    return near.select(F.col("ask").alias("expected_observation_id"), "entity_id", "period_end", "previous_end", "next_end", severity.alias("severity"), F.lit("proven_by_explicit_expectation").alias("confidence"))


DETECTORS = {"lookahead": lookahead, "unit_drift": unit_drift, "duplicate": exact_duplicates, "revision_overwrite": revision_overwrite}


def run_detectors(audit: DataFrame, as_of: date | str, names: tuple[str, ...] = tuple(DETECTORS), scope: tuple[str, ...] = (), options: dict[str, dict] | None = None) -> DataFrame:
    """All findings of the named detectors in one schema: finding_id, detector, rule_id, affected, severity, confidence.

    scope: columns of `audit` that keep its rows apart (a case id: many audits in one plan); the findings carry them first. options:
    further arguments of a detector, by its name.
    """
    if unknown := set(names) - set(DETECTORS):
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    parts = []
    for name in names:
        found = DETECTORS[name](audit, as_of, scope=scope, **(options or {}).get(name, {}))
        affected = F.col("affected") if name == "duplicate" else F.col("record_id")
        parts.append(found.select(*scope, stable_id("find", name, affected).alias("finding_id"), F.lit(name).alias("detector"), F.lit(RULES[name]).alias("rule_id"), affected.alias("affected"), "entity_id", "severity", "confidence"))
    return reduce(DataFrame.unionByName, parts)
