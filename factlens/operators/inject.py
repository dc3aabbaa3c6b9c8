"""Fault injectors: (corrupted facts, manifest). The manifest is private; detectors never see it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ident import stable_id
from factlens.operators.pit import visible
from factlens.operators.ranks import first_of_groups
from factlens.operators.series import NoEligibleTarget, adjacent_revisions, comparable_series, duplicate_groups, select_targets, selection_digest

FRACTIONS = {"lookahead": ("0.02", "0.05", "0.10"), "unit_drift": ("0.02", "0.05", "0.10"), "duplicate": ("0.01", "0.05", "0.15"), "revision_overwrite": ("0.02", "0.05", "0.10"), "missing": ("0.10", "0.25", "0.50")}
SEVERITIES = ("low", "medium", "high")
MINIMUM_LAG = (7, 14, 30)
SCALE = (100, 1000, 1_000_000)
MINIMUM_SIZE = (1, 5, 20)
MOST = 10_000


def _level(severity: str) -> int:
    return SEVERITIES.index(severity)


def _new_id(family: str, seed: int) -> Column:
    return stable_id("rec", family, str(seed), F.col("record_id"))


def _targets(eligible: DataFrame, family: str, severity: str, seed: int, most: int) -> DataFrame:
    """The rows to corrupt; without an eligible one it raises, so that no injection does nothing unseen."""
    return select_targets(eligible, "record_id", family, seed, FRACTIONS[family][_level(severity)], most)


def _replace(facts: DataFrame, manifest: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Facts with the manifest's rows replaced; the other side of the join is the manifest, whose size is its target count."""
    marked = facts.join(manifest, facts["record_id"] == manifest["original_record_id"], "left")
    hit = F.col("original_record_id").isNotNull()
    return marked.select(*[F.when(hit, changes[c]).otherwise(facts[c]).alias(c) if c in changes else facts[c] for c in facts.columns])


def eligible_lookahead(facts: DataFrame, research_date: date | str, severity: str) -> DataFrame:
    day = F.lit(str(research_date)).cast("date")
    return facts.filter((F.col("available_on") == F.col("filed_on")) & (F.col("period_end") <= day) & (F.col("available_on") > day) & (F.datediff("filed_on", "period_end") >= MINIMUM_LAG[_level(severity)]))


def inject_lookahead(facts: DataFrame, research_date: date | str, severity: str, seed: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """available_on becomes period_end."""
    picked = _targets(eligible_lookahead(facts, research_date, severity), "lookahead", severity, seed, most)
    manifest = picked.select(F.col("record_id").alias("original_record_id"), _new_id("lookahead", seed).alias("injected_record_id"), "target_rank", F.col("available_on").alias("original_available_on"), F.datediff("filed_on", "period_end").cast("long").alias("leaked_days"))
    return _replace(facts, manifest, {"record_id": F.col("injected_record_id"), "available_on": F.col("period_end")}), manifest


def eligible_unit_drift(facts: DataFrame, as_of: date | str) -> DataFrame:
    return comparable_series(facts, as_of).filter("value != 0")


def inject_unit_drift(facts: DataFrame, as_of: date | str, severity: str, seed: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """value times 100, 1000 or 1000000; the unit stays."""
    factor = SCALE[_level(severity)]
    picked = _targets(eligible_unit_drift(facts, as_of), "unit_drift", severity, seed, most)
    manifest = picked.select(F.col("record_id").alias("original_record_id"), _new_id("unit_drift", seed).alias("injected_record_id"), "target_rank", F.col("value").alias("original_value"), F.lit(factor).cast("long").alias("factor"))
    return _replace(facts, manifest, {"record_id": F.col("injected_record_id"), "value": (F.col("original_value") * F.col("factor").cast("decimal(9,0)")).cast("decimal(28,6)")}), manifest


def eligible_duplicate(facts: DataFrame, as_of: date | str) -> DataFrame:
    single = duplicate_groups(facts, as_of).filter("members = 1").select(F.element_at("record_ids", 1).alias("record_id"))
    return facts.join(single, "record_id", "left_semi")


def inject_duplicate(facts: DataFrame, as_of: date | str, severity: str, seed: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """A copy under a new id is appended."""
    picked = _targets(eligible_duplicate(facts, as_of), "duplicate", severity, seed, most)
    copies = picked.withColumns({"copied": F.col("record_id"), "record_id": _new_id("duplicate", seed)})
    manifest = copies.select(F.col("copied").alias("original_record_id"), F.col("record_id").alias("injected_record_id"), "target_rank", F.concat_ws("|", F.array_sort(F.array("copied", "record_id"))).alias("affected"))
    return facts.unionByName(copies.select(*facts.columns)), manifest


LATER = ("value", "filed_on", "form", "accession_number", "source_name", "source_locator", "source_row_key")


def eligible_revision_overwrite(history: DataFrame, as_of: date | str, severity: str) -> DataFrame:
    """(record_id, what a later revision changes, later) of the pairs that a fault may take: no other columns are shuffled or stored for it."""
    pairs = adjacent_revisions(history, as_of, MINIMUM_SIZE[_level(severity)])
    return pairs.select("record_id", *LATER, F.struct(*[F.col(f"later.{c}").alias(c) for c in LATER]).alias("later"))


def inject_revision_overwrite(snapshot: DataFrame, history: DataFrame, as_of: date | str, severity: str, seed: int, most: int = MOST, eligible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A visible revision gets what its next, not yet visible, revision says; available_on stays. `eligible`: the pairs, where they are at hand."""
    pairs = eligible_revision_overwrite(history, as_of, severity) if eligible is None else eligible
    picked = _targets(pairs, "revision_overwrite", severity, seed, most)
    manifest = picked.select(F.col("record_id").alias("original_record_id"), _new_id("revision_overwrite", seed).alias("injected_record_id"), "target_rank", F.struct(*LATER).alias("original"), F.col("later").alias("new"))
    return _replace(snapshot, manifest, {"record_id": F.col("injected_record_id")} | {c: F.col(f"new.{c}") for c in LATER}), manifest


GROUPS = {"entity_dependent": ("entity_id",), "survivorship": ("entity_id",), "concept_dependent": ("concept_namespace", "concept"), "source_outage": ("source_name", "source_locator")}
MECHANISMS = ("random", "periodic_gap", *GROUPS)
#: Mechanisms that take a group as a whole.
WHOLE = ("survivorship", "source_outage")


def interior(seen: DataFrame) -> DataFrame:
    """The rows of series without the first and the last by period."""
    key = ("entity_id", "concept_namespace", "concept", "unit", "dimensions", "period_type")
    up, down = Window.partitionBy(*key).orderBy("period_end", "record_id"), Window.partitionBy(*key).orderBy(F.desc("period_end"), F.desc("record_id"))
    return seen.withColumns({"first": F.row_number().over(up) > 1, "last": F.row_number().over(down) > 1}).filter("first AND last").drop("first", "last")


def chosen(seen: DataFrame, group: tuple[str, ...], seed: int) -> DataFrame:
    """The one group of the least hash of its key; ties by the key."""
    least = F.min(F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), *group), 256).alias("h"), *group))
    return seen.select(*group).distinct().agg(least.alias("g")).filter("g IS NOT NULL").select(*[f"g.{c}" for c in group])


def inject_missing(facts: DataFrame, as_of: date | str, mechanism: str, severity: str, seed: int, most: int = MOST, bound_whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows go: at random, from the interior of series, of one entity, of one concept, of one entity whole, or of one source whole.

    A group that goes as a whole is never cut: if it has more than `most` rows, it raises, or, without `bound_whole`, goes whatever its size.
    """
    if mechanism not in MECHANISMS:
        raise ValueError(f"unknown mechanism {mechanism}")
    seen = facts.filter(visible(as_of))
    if mechanism == "periodic_gap":
        seen = interior(seen)
    elif mechanism in GROUPS:
        seen = seen.join(F.broadcast(chosen(seen, GROUPS[mechanism], seed)), list(GROUPS[mechanism]), "left_semi")  # one row
    if mechanism in WHOLE:
        if bound_whole and (n := seen.count()) > most:
            raise NoEligibleTarget(f"{mechanism} would remove {n} rows; {most} are allowed")
        picked = seen.withColumn("target_rank", F.lit(None).cast("long"))
    else:
        picked = _targets(seen, "missing", severity, seed, most)
    manifest = picked.select(*facts.columns, "target_rank")
    return facts.join(manifest.select("record_id"), "record_id", "left_anti"), manifest


def missing_targets(facts: DataFrame, as_of: date | str, mechanisms: tuple[str, ...], severity: str, seed: int, most: int = MOST, bound_whole: bool = True) -> DataFrame:
    """(mechanism, record_id) of the rows that inject_missing takes by each mechanism, in one plan; raises as it does.

    Each visible row says by which mechanisms it may go, in one pass; then every mechanism takes its first rows by digest.
    """
    if unknown := set(mechanisms) - set(MECHANISMS):
        raise ValueError(f"unknown mechanisms {sorted(unknown)}")
    seen = facts.filter(visible(as_of))
    tagged = seen.withColumn("_m", F.array_compact(F.array(F.lit("random") if "random" in mechanisms else F.lit(None).cast("string"))))
    if "periodic_gap" in mechanisms:
        inner = interior(seen).select("record_id", F.lit("periodic_gap").alias("_p"))
        tagged = tagged.join(inner, "record_id", "left").withColumn("_m", F.when(F.col("_p").isNotNull(), F.array_append("_m", F.col("_p"))).otherwise(F.col("_m"))).drop("_p")
    for m in (m for m in GROUPS if m in mechanisms):
        one = chosen(seen, GROUPS[m], seed).withColumn("_p", F.lit(m))
        tagged = tagged.join(F.broadcast(one), list(GROUPS[m]), "left").withColumn("_m", F.when(F.col("_p").isNotNull(), F.array_append("_m", F.col("_p"))).otherwise(F.col("_m"))).drop("_p")
    pool = tagged.select("record_id", F.explode("_m").alias("mechanism"))
    counts = pool.groupBy("mechanism").agg(F.count("*").alias("n"))
    part = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(FRACTIONS["missing"][_level(severity)]).cast("decimal(9,4)")).cast("long"))
    fail = F.raise_error(F.concat("mechanism", F.lit(f" would remove more than {most} rows"))).cast("long")
    whole = F.when(F.col("n") > most, fail).otherwise(F.col("n")) if bound_whole else F.col("n")
    wanted = F.when(F.col("mechanism").isin(*WHOLE), whole).otherwise(F.least(F.lit(most).cast("long"), part))
    asked = pool.join(F.broadcast(counts.select("mechanism", wanted.alias("wanted"))), "mechanism").withColumn("digest", selection_digest("missing", seed, F.col("record_id")))
    return first_of_groups(asked, ["mechanism"], "digest", "record_id", "wanted").select("mechanism", "record_id")
