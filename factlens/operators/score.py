"""Exact scoring of findings against a manifest, clean controls and interpretation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.functions.ratios import rounded
from factlens.operators.detect import EXPECTED_KEY, absent_observations
from factlens.operators.inject import missing_targets
from factlens.operators.pit import sanitize, visible
from factlens.sources.sinks import work_folder


def f1(p: Column, r: Column) -> Column:
    """Null if either is null; 0 if both are 0."""
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / (p + r), 9))


def matches(findings: DataFrame, manifest: DataFrame, finding_key: str, entry_key: str, checks: dict[str, str]) -> DataFrame:
    """Every finding with its status: true_positive if it fits exactly one entry and that entry no other finding; ambiguous if it fits several; else false_positive."""
    left = findings.withColumn("_f", F.monotonically_increasing_id()).alias("f")
    right = manifest.alias("m")
    on = F.col(f"f.{finding_key}") == F.col(f"m.{entry_key}")
    for a, b in checks.items():
        on = on & F.col(f"f.{a}").eqNullSafe(F.col(f"m.{b}"))
    joined = left.join(right, on, "left").select("f.*", F.col(f"m.{entry_key}").alias("entry"))
    # Findings without an entry are most of them: each is its own group, so they spread over all tasks.
    claim = Window.partitionBy("entry", F.when(F.col("entry").isNull(), F.col("_f")))
    counted = joined.withColumns({"entries": F.count("entry").over(Window.partitionBy("_f")), "claims": F.count("*").over(claim)})
    status = F.when(F.col("entries") == 0, "false_positive").when((F.col("entries") == 1) & (F.col("claims") == 1), "true_positive").otherwise("ambiguous")
    return counted.withColumn("status", status).drop("_f", "entries", "claims")


def metrics(matched: DataFrame, targets: int, eligible: int, family: str) -> DataFrame:
    """One row of exact counts, precision, recall, F1 and false positive rate.

    The rate's denominator is the eligible rows that were not targets for look-ahead, and all eligible rows otherwise.
    """
    base = eligible - targets if family == "lookahead" else eligible
    n = matched.agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "true_positive").alias("true_positives"), F.count_if(F.col("status") != "true_positive").alias("false_positives"))
    n = n.withColumns({"targets": F.lit(targets).cast("long"), "eligible": F.lit(eligible).cast("long")}).withColumn("missed", F.col("targets") - F.col("true_positives"))
    p, r = rounded(F.col("true_positives"), F.col("findings")), rounded(F.col("true_positives"), F.col("targets"))
    return n.withColumns({"precision": p, "recall": r}).withColumns({"f1": f1(F.col("precision"), F.col("recall")), "false_positive_rate": rounded(F.col("false_positives"), F.lit(base))})


def clean_control(findings: DataFrame, eligible: int) -> DataFrame:
    """Every finding on clean data is false; recall is null, precision 0 with findings and null without."""
    n = findings.agg(F.count("*").alias("false_positives"))
    return n.select("false_positives", F.lit(eligible).cast("long").alias("eligible"), F.when(F.col("false_positives") > 0, F.lit(0.0)).alias("precision"), F.lit(None).cast("double").alias("recall"), rounded(F.col("false_positives"), F.lit(eligible)).alias("false_positive_rate"))


def interpret(findings: DataFrame, manifest: DataFrame, clean_findings: DataFrame, primary: str) -> DataFrame:
    """What each finding on corrupted data is, in this order.

    primary_matched: of the detector `primary`, and fits one fault of `manifest` (original_record_id, injected_record_id) one to
    one. independent_background: the clean data give a finding of the same detector, records (injected ids mapped back), severity
    and confidence. secondary_corroborating: another detector's, and its records are those of exactly one fault. Else unmatched.
    """
    exact = matches(findings.filter(F.col("detector") == primary), manifest, "affected", "injected_record_id", {}).filter("status = 'true_positive'").select("finding_id", F.lit(True).alias("is_primary"))
    fault = F.col("injected_record_id").alias("fault")
    causal = manifest.select(F.explode(F.array_distinct(F.array("original_record_id", "injected_record_id"))).alias("record_id"), fault).distinct()
    records = findings.select("finding_id", F.explode(F.split("affected", r"\|")).alias("record_id"))
    touched = records.join(causal, "record_id").groupBy("finding_id").agg(F.count_distinct("fault").alias("faults"))
    ids = manifest.select(F.col("injected_record_id").alias("record_id"), "original_record_id")
    back = records.join(ids, "record_id", "left").groupBy("finding_id").agg(F.concat_ws("|", F.array_sort(F.collect_list(F.coalesce("original_record_id", "record_id")))).alias("clean_affected"))
    body = ["detector", "clean_affected", "severity", "confidence"]
    background = clean_findings.withColumnRenamed("affected", "clean_affected").select(*body).distinct().withColumn("is_background", F.lit(True))
    out = findings.join(back, "finding_id").join(exact, "finding_id", "left").join(background, body, "left").join(touched, "finding_id", "left")
    status = F.when(F.col("is_primary"), "primary_matched").when(F.col("is_background"), "independent_background").when((F.col("faults") == 1) & (F.col("detector") != primary), "secondary_corroborating").otherwise("unmatched")
    return out.select("finding_id", "detector", "affected", status.alias("interpretation"))


class DirtyControl(ValueError):
    """The clean facts already give findings."""


def expectations_of(facts: DataFrame, as_of: date | str, context: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """One explicit expectation for each visible fact, due when the fact came."""
    return facts.filter(visible(as_of)).select(*scope, F.concat(F.lit("exp-"), "record_id").alias("expected_observation_id"), F.lit(context).alias("context"), *EXPECTED_KEY, "period_start", "dimensions", F.col("available_on").alias("expected_by"))


def missing_evaluation(clean: DataFrame, as_of: date | str, mechanisms: tuple[str, ...], severity: str, seed: int, most: int, bound_whole: bool = True) -> DataFrame:
    """A row for each mechanism: removes facts by it, detects what is missing, scores the findings against the removed rows.

    A removed fact of which a copy stays is missed, as its expectation is met. All mechanisms are scored in one plan: the rows that any of
    them removes are chosen once, and only expectations and facts of their keys are looked at, as all others are met by what stays.
    Raises if a clean fact does not meet its own expectation, which only a null in its key can do.
    """
    key = [*EXPECTED_KEY, "dimensions"]
    if clean.filter(visible(as_of)).filter(reduce(Column.__or__, [F.col(c).isNull() for c in key])).first() is not None:
        raise DirtyControl("expectations are not met by the clean facts")
    spark = clean.sparkSession
    path = f"{work_folder(spark)}/gone"
    chosen = missing_targets(clean, as_of, mechanisms, severity, seed, most, bound_whole)
    chosen.write.parquet(path)
    gone = spark.read.schema(chosen.schema).parquet(path)
    # Rows of one hash stand for those of one key; a hash that two keys share only adds rows that change nothing.
    place = F.xxhash64(*key, "period_start")
    keyed = clean.filter(visible(as_of)).withColumn("_key", place)
    touched = keyed.join(gone.select("record_id").distinct(), "record_id", "left_semi").select("_key").distinct()
    rows = keyed.join(touched, "_key", "left_semi")
    lost = rows.join(gone.groupBy("record_id").agg(F.collect_set("mechanism").alias("_gone")), "record_id", "left")
    each = lost.withColumn("mechanism", F.explode(F.array(*map(F.lit, mechanisms)))).withColumn("lost", F.coalesce(F.array_contains("_gone", F.col("mechanism")), F.lit(False)))
    stays = each.filter("NOT lost")
    expected = expectations_of(each, as_of, "random", ("mechanism",))
    found = absent_observations(sanitize(stays, ("mechanism",)), expected, as_of, ("mechanism",)).select("mechanism", F.col("expected_observation_id").alias("id"), F.lit(1).alias("found"), F.lit(0).alias("lost"))
    removed = gone.select("mechanism", F.concat(F.lit("exp-"), "record_id").alias("id"), F.lit(0).alias("found"), F.lit(1).alias("lost"))
    both = found.unionByName(removed).groupBy("mechanism", "id").agg(F.max("found").alias("found"), F.max("lost").alias("lost"))
    f, m = F.col("found") == 1, F.col("lost") == 1
    out = both.groupBy("mechanism").agg(F.count_if(f).alias("findings"), F.count_if(m).alias("targets"), F.count_if(f & m).alias("true_positives"), F.count_if(f & ~m).alias("false_positives"), F.count_if(m & ~f).alias("missed"))
    return out.withColumns({"precision": rounded(F.col("true_positives"), F.col("findings")), "recall": rounded(F.col("true_positives"), F.col("targets"))})
