"""Benchmark cases in one plan: inject, audit, score and repair every case of a grid at once.

All cases of all families are rows of the same tables, with the case id as a further key. What is eligible does not depend on the
seed, so it is found once a family and severity; every case takes its first rows by digest from it (ranks.first_of_groups). Detectors
work within an entity, so a fault changes findings of its entity alone: only rows of touched entities are copied for a case,
and findings of the others are counted on the clean facts, once. The number of jobs does not grow with the cases.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest, stable_id
from factlens.functions.ratios import relative_size_at_least
from factlens.operators.detect import run_detectors
from factlens.operators.inject import FRACTIONS, LATER, MINIMUM_LAG, MINIMUM_SIZE, MOST, SCALE, SEVERITIES, eligible_duplicate, eligible_lookahead, eligible_unit_drift
from factlens.operators.pit import sanitize, snapshot, visible
from factlens.operators.ranks import first_of_groups
from factlens.operators.series import adjacent_revisions
from factlens.schema import AUDIT_COLUMNS
from factlens.sources.sinks import work_folder

FAMILIES = ("lookahead", "unit_drift", "duplicate", "revision_overwrite")
#: Names of touched entities that are broadcast: they are bounded by the targets of all cases; with more, a shuffle finds their rows.
BROADCAST_NAMES = 1_000_000
CASE = ("case_id", "fault_profile", "severity", "seed", "kind")


class UnknownFamily(ValueError):
    """A case of no family."""


@dataclass(frozen=True)
class Dispatched:
    """results: a row a case. manifest (private): a row a fault. findings: of all cases, with the case id."""

    results: DataFrame
    manifest: DataFrame
    findings: DataFrame


def _severities(**least) -> Column:
    """The severities whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(ok, F.lit(s)) for s, ok in least.items()]))


def eligible(clean: DataFrame, history: DataFrame, as_of: date | str, family: str) -> DataFrame:
    """(fault_profile, severities, record_id, entity_id, later): the rows a fault of a family may take, and at which severities."""
    everything = F.array(*map(F.lit, SEVERITIES))
    none = F.lit(None).cast(history.select(F.struct(*LATER).alias("s")).schema["s"].dataType)
    if family == "lookahead":
        # The mildest severity asks for the least lag; the others for more of the same rows.
        lag = F.datediff("filed_on", "period_end")
        rows = eligible_lookahead(clean, as_of, "low").select("record_id", "entity_id", _severities(**{s: lag >= MINIMUM_LAG[i] for i, s in enumerate(SEVERITIES)}).alias("severities"), none.alias("later"))
    elif family == "unit_drift":
        rows = eligible_unit_drift(clean, as_of).select("record_id", "entity_id", everything.alias("severities"), none.alias("later"))
    elif family == "duplicate":
        rows = eligible_duplicate(clean, as_of).select("record_id", "entity_id", everything.alias("severities"), none.alias("later"))
    elif family == "revision_overwrite":
        pairs = adjacent_revisions(history, as_of, MINIMUM_SIZE[0])
        size = {s: relative_size_at_least(F.col("value"), F.col("later.value"), MINIMUM_SIZE[i]) for i, s in enumerate(SEVERITIES)}
        rows = pairs.select("record_id", "entity_id", _severities(**size).alias("severities"), F.struct(*[F.col(f"later.{c}").alias(c) for c in LATER]).alias("later"))
    else:
        raise UnknownFamily(family)
    return rows.select(F.lit(family).alias("fault_profile"), "severities", "record_id", "entity_id", "later")


def _by_family(of: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("fault_profile") == kv[0], F.lit(kv[1])), of.items(), F.when(F.lit(False), F.lit("")))


def _fraction() -> Column:
    each = [((f, s), FRACTIONS[f][i]) for f in FAMILIES for i, s in enumerate(SEVERITIES)]
    return reduce(lambda c, kv: c.when((F.col("fault_profile") == kv[0][0]) & (F.col("severity") == kv[0][1]), F.lit(kv[1]).cast("decimal(9,4)")), each, F.when(F.lit(False), F.lit("0").cast("decimal(9,4)")))


def _injected(of: Column, case: str = "") -> Column:
    """What stable_id gives for the record of a case."""
    return stable_id("rec", F.col(f"{case}fault_profile"), F.col(f"{case}seed").cast("string"), of)


def corrupt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of facts, each with its case and, where it is a target (`is_target`), its fault applied; a duplicate keeps its original beside it."""
    hit, is_ = F.col("is_target"), lambda f: F.col("fault_profile") == f
    factor = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], F.lit(kv[1])), zip(SEVERITIES, SCALE, strict=True), F.when(F.lit(False), F.lit(1))).cast("decimal(9,0)")
    changed = {
        "record_id": F.when(hit, _injected(F.col("record_id"))).otherwise(F.col("record_id")),
        "available_on": F.when(hit & is_("lookahead"), F.col("period_end")).otherwise(F.col("available_on")),
        "value": F.when(hit & is_("unit_drift"), (F.col("value") * factor).cast("decimal(28,6)")).when(hit & is_("revision_overwrite"), F.col("later.value")).otherwise(F.col("value")),
    }
    changed |= {c: F.when(hit & is_("revision_overwrite"), F.col(f"later.{c}")).otherwise(F.col(c)) for c in LATER if c != "value"}
    faulty = rows.select(*CASE, F.col("record_id").alias("clean_id"), "is_target", *[changed.get(c, F.col(c)).alias(c) for c in columns])
    kept = rows.filter(hit & is_("duplicate")).select(*CASE, F.col("record_id").alias("clean_id"), F.lit(False).alias("is_target"), *columns)
    return faulty.unionByName(kept)


def repair(corrupted: DataFrame, originals: DataFrame, columns: list[str]) -> DataFrame:
    """Corrupted rows of all cases with every fault undone from its original (case_id, record_id and the columns): copies go, others are put back."""
    # Each family's inverse puts back exactly what its fault changed; originals holds only those columns' values.
    undone = ("available_on", *LATER)
    back = originals.select("case_id", F.col("record_id").alias("clean_id"), F.struct(*undone).alias("was"))
    # Only faults meet their originals; all other rows, which are most of them, are not shuffled.
    faulty = corrupted.filter("is_target AND fault_profile != 'duplicate'").join(back, ["case_id", "clean_id"], "left")
    rows = faulty.unionByName(corrupted.filter("NOT is_target").withColumn("was", F.lit(None).cast(back.schema["was"].dataType)))
    of = {"lookahead": ("available_on",), "unit_drift": ("value",), "revision_overwrite": LATER}
    put = lambda c: [F.col("fault_profile") == f for f, cs in of.items() if c in cs]
    cols = []
    for c in columns:
        if c == "record_id":
            cols.append(F.when(F.col("is_target"), F.col("clean_id")).otherwise(F.col(c)).alias(c))
        elif ok := put(c):
            cols.append(F.when(F.col("is_target") & reduce(Column.__or__, ok), F.col(f"was.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return rows.select("case_id", *cols)


def dispatch(spark: SparkSession, cases: DataFrame, facts: DataFrame, history: DataFrame, as_of: date | str, most: int = MOST) -> Dispatched:
    """Runs every case (case_id, fault_profile, severity, seed, kind: `fault` or `clean_control`, and any other columns).

    `facts` are the clean facts of look-ahead, unit-drift and duplicate cases, `history` the revisions of revision-overwrite ones, whose
    clean facts are its snapshot. A case takes ceiling(eligible * fraction) targets, one at least, `most` at most; one without an
    eligible row is `no_target` and is audited as it is. All four detectors see every case; a finding counts as true if the case's own
    detector gives it for exactly the rows of one fault (and, for unit drift, with its factor). A clean control injects nothing:
    its findings are false. `changed`: whether the family's research figure moved; `restored`: whether the repair gives the clean
    rows back, copies counted. A case of no family raises. Case ids must be unique; a grid without cases gives empty results.
    """
    root = work_folder(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    known = F.col("fault_profile").isin(*FAMILIES) & F.col("kind").isin("fault", "clean_control")
    if (bad := cases.filter(~known | known.isNull()).first()) is not None:
        raise UnknownFamily(f"{bad.case_id}: {bad.fault_profile}")
    columns = list(AUDIT_COLUMNS) + ["source_row_key"]
    snap = snapshot(history, as_of).select(*columns)
    # Every step below reads the clean rows: they are derived once.
    clean = stored(facts.select(F.lit("facts").alias("dataset"), *columns).unionByName(snap.select(F.lit("history").alias("dataset"), *columns)), "clean")
    dataset = F.when(F.col("fault_profile") == "revision_overwrite", F.lit("history")).otherwise(F.lit("facts"))
    grid = F.broadcast(cases.select(*CASE).withColumn("dataset", dataset))  # configuration: a row a case

    pool = stored(reduce(DataFrame.unionByName, [eligible(facts, history, as_of, f) for f in FAMILIES]), "eligible")
    counts = pool.select("fault_profile", F.explode("severities").alias("severity")).groupBy("fault_profile", "severity").agg(F.count("*").alias("eligible"))
    wanted = F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("eligible").cast("decimal(20,0)") * _fraction()).cast("long")))
    sized = grid.join(F.broadcast(counts), ["fault_profile", "severity"], "left").withColumns({"eligible": F.coalesce("eligible", F.lit(0)), "wanted": F.when(F.col("kind") == "fault", F.coalesce(wanted, F.lit(0))).otherwise(F.lit(0))})
    digest = F.sha2(F.concat(F.lit('{"eligibility_unit_id":"'), F.col("record_id"), F.lit('","namespace":"'), F.col("fault_profile"), F.lit('","seed":'), F.col("seed"), F.lit("}")), 256)
    asked = sized.filter("wanted > 0").withColumnRenamed("fault_profile", "family")
    entries = pool.join(F.broadcast(asked), (F.col("fault_profile") == F.col("family")) & F.array_contains("severities", F.col("severity"))).withColumn("digest", digest)
    targets = first_of_groups(entries, ["case_id"], "digest", "record_id", "wanted").select(*CASE, "dataset", "record_id", "entity_id", "later", "target_rank")
    targets = stored(targets, "targets")

    # Rows of touched entities are found once, by names that are few beside the clean rows, before they are copied for the cases.
    touched = stored(targets.select("case_id", "dataset", "entity_id").distinct(), "touched")
    names = stored(touched.select("dataset", "entity_id").distinct(), "entities")
    few = names.count() <= BROADCAST_NAMES
    near = stored(clean.join(F.broadcast(names) if few else names, ["dataset", "entity_id"], "left_semi"), "near")
    of_case = near.join(touched, ["dataset", "entity_id"]).join(grid.drop("dataset"), "case_id")
    marked = of_case.join(targets.select("case_id", "record_id", "later", F.lit(True).alias("is_target")), ["case_id", "record_id"], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    marked = stored(marked, "marked")
    corrupted = corrupt(marked, columns)

    scoped = stored(run_detectors(corrupted.select("case_id", *AUDIT_COLUMNS), as_of, scope=("case_id",)), "case_findings")
    plain = stored(run_detectors(clean.select("dataset", *AUDIT_COLUMNS), as_of, scope=("dataset",)), "clean_findings")
    # Findings of entities that a case leaves alone are those of the clean facts.
    untouched = plain.join(F.broadcast(cases.select(*CASE).withColumn("dataset", dataset).select("case_id", "dataset")), "dataset").join(touched.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti")
    findings = scoped.unionByName(untouched.select(*scoped.columns))

    expected = targets.select("case_id", "fault_profile", "severity", "record_id", _injected(F.col("record_id")).alias("new_id"))
    pair = F.concat_ws("|", F.array_sort(F.array("record_id", "new_id")))
    expected = expected.select("case_id", F.col("fault_profile").alias("detector"), F.when(F.col("fault_profile") == "duplicate", pair).otherwise(F.col("new_id")).alias("affected"), F.when(F.col("fault_profile") == "unit_drift", F.col("severity")).alias("factor_severity"))
    true = scoped.join(expected, ["case_id", "detector", "affected"]).filter("factor_severity IS NULL OR factor_severity = severity").groupBy("case_id").agg(F.count("*").alias("true_positives"))
    by_case = scoped.groupBy("case_id").agg(F.count("*").alias("own"))
    per_entity = plain.groupBy("dataset", "entity_id").agg(F.count("*").alias("n"))
    replaced = touched.join(per_entity, ["dataset", "entity_id"]).groupBy("case_id").agg(F.sum("n").alias("replaced"))
    whole = per_entity.groupBy("dataset").agg(F.sum("n").alias("whole"))
    faults = targets.groupBy("case_id").agg(F.count("*").alias("faults"))

    # Figures and repairs of the touched rows: what is not touched is the same on all sides.
    # All of it is summed, and equal multisets of rows have equal sums of digests: rows are not shuffled for it.
    side = lambda df, s: df.select("case_id", F.lit(s).alias("side"), *columns)
    repaired = repair(corrupted, marked.filter("is_target"), columns)
    rows = side(marked, "clean").unionByName(side(corrupted, "corrupted")).unionByName(side(repaired, "repaired"))
    moved = F.when(F.col("side") == "clean", 1).when(F.col("side") == "corrupted", -1).otherwise(0)
    digest_of = lambda s: digest_of_rows(F.when(F.col("side") == s, F.col("row")))
    whole_rows = lambda s: F.count_if(F.col("side") == s)
    compared = rows.withColumn("row", F.when(F.col("side") != "corrupted", row_digest(columns)))
    figures = compared.groupBy("case_id").agg(
        F.sum(F.when(visible(as_of), moved).otherwise(0)).alias("seen"), F.sum(F.col("value") * moved.cast("decimal(9,0)")).alias("total"), F.sum(moved).alias("records"),
        ((whole_rows("clean") == whole_rows("repaired")) & (digest_of("clean") == digest_of("repaired"))).alias("same"),
    )
    figure = F.when(F.col("fault_profile") == "lookahead", F.col("seen") != 0).when(F.col("fault_profile") == "duplicate", F.col("records") != 0).otherwise(F.col("total") != 0)

    out = sized.join(whole, "dataset", "left")
    for part in (faults, true, by_case, replaced, figures):
        out = out.join(part, "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    total = n("whole") - n("replaced") + n("own")
    out = out.select(
        *CASE, F.when((F.col("kind") == "fault") & (n("faults") == 0), "no_target").otherwise("ok").alias("status"), total.alias("findings"), n("faults").alias("faults"), n("true_positives").alias("true_positives"), (total - n("true_positives")).alias("false_positives"),
        # A look-ahead target is no clean row; its denominator leaves the targets out.
        (n("eligible") - F.when(F.col("fault_profile") == "lookahead", n("faults")).otherwise(0)).alias("eligible"),
        F.when(F.col("faults").isNotNull(), F.coalesce(figure, F.lit(False))).alias("changed"), F.when(F.col("faults").isNotNull(), F.col("same")).alias("restored"),
    )
    rest = [c for c in cases.columns if c not in CASE]
    results = stored(out.join(F.broadcast(cases.select("case_id", *rest)), "case_id") if rest else out, "results")
    return Dispatched(results, targets, findings)
