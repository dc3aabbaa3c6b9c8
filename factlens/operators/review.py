"""Review of findings: rerun comparison, adjudication coverage, pilot report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest


def rerun_diff(baseline: DataFrame, candidate: DataFrame, key: str = "finding_id", body: tuple[str, ...] = ("severity", "confidence")) -> DataFrame:
    """(key, change): added, removed, changed or unchanged."""
    a = baseline.select(key, F.struct(*body).alias("before"))
    b = candidate.select(key, F.struct(*body).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def adjudication_coverage(findings: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Counts of findings without an adjudication, and of adjudications without a finding."""
    open_ = findings.join(adjudications, "finding_id", "left_anti").agg(F.count("*").alias("unreviewed"))
    stray = adjudications.join(findings, "finding_id", "left_anti").agg(F.count("*").alias("unknown"))
    return open_.crossJoin(stray)  # one row each


def pilot_report(findings: DataFrame, adjudications: DataFrame) -> DataFrame:
    """By detector: findings, dispositions, review seconds."""
    return findings.join(adjudications, "finding_id", "left").groupBy("detector").agg(
        F.count("*").alias("findings"), F.count_if(F.col("disposition") == "confirmed").alias("confirmed"), F.count_if(F.col("disposition") == "rejected").alias("rejected"),
        F.count_if(F.col("disposition").isNull()).alias("unreviewed"), F.coalesce(F.sum("review_seconds"), F.lit(0)).alias("review_seconds"),
    )


def disjoint_violations(audit: DataFrame, partition: str) -> DataFrame:
    """Entities that lie in more than one partition."""
    return audit.groupBy("entity_id").agg(F.count_distinct(partition).alias("partitions")).filter("partitions > 1")


def evidence(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """`findings` with evidence_hash: of the rule, its verdict and the content of the records, whatever these are called.

    The records of a finding go in as a multiset of digests of all audited columns but record_id, so their ids and order play no part,
    and a finding on very many copies is still one aggregation. A record that is not in `audit` has no content: its finding's hash is null.
    """
    columns = [c for c in audit.columns if c != "record_id"]
    contents = audit.select("record_id", row_digest(columns).alias("h"))
    each = findings.select("finding_id", F.explode(F.split("affected", r"\|")).alias("record_id")).join(contents, "record_id", "left")
    whole = each.groupBy("finding_id").agg(F.when(F.count("h") == F.count("*"), digest_of_rows(F.col("h"))).alias("content"))
    said = F.sha2(F.concat_ws("|", "detector", "rule_id", "severity", "confidence", "content"), 256)
    return findings.join(whole, "finding_id", "left").withColumn("evidence_hash", F.when(F.col("content").isNotNull(), said)).drop("content")


def evidence_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(evidence_hash, detector, before, after) of findings with evidence, counted: as many of one hash as both sides have are the same.

    Findings without a hash cannot be told to be the same; they stand under null, by detector.
    """
    n = lambda df, name: df.groupBy("evidence_hash", "detector").agg(F.count("*").alias(name))
    a, b = n(baseline, "before"), n(candidate, "after").select(F.col("evidence_hash").alias("h"), F.col("detector").alias("d"), "after")
    both = a.join(b, F.col("evidence_hash").eqNullSafe(F.col("h")) & (F.col("detector") == F.col("d")), "full_outer")
    return both.select(F.coalesce("evidence_hash", "h").alias("evidence_hash"), F.coalesce("detector", "d").alias("detector"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def evidence_counts(diff: DataFrame) -> DataFrame:
    """By detector: findings that are kept, added and removed."""
    same = F.when(F.col("evidence_hash").isNotNull(), F.least("before", "after")).otherwise(0)
    return diff.groupBy("detector").agg(F.sum(same).alias("kept"), F.sum(F.col("after") - same).alias("added"), F.sum(F.col("before") - same).alias("removed"))


def carried_adjudications(baseline: DataFrame, adjudications: DataFrame, candidate: DataFrame) -> DataFrame:
    """(finding_id, disposition, review_seconds, state) of the candidate's findings whose evidence was adjudicated in the baseline.

    state: `carried`; `conflicting` where the baseline's findings of one evidence were judged differently, with a null disposition.
    Seconds are those spent on the evidence, at most on one finding. Findings with new evidence, or none, have no row.
    """
    judged = baseline.filter("evidence_hash IS NOT NULL").join(adjudications, "finding_id")
    one = judged.groupBy("evidence_hash").agg(F.min("disposition").alias("least"), F.max("disposition").alias("most"), F.max("review_seconds").alias("review_seconds"))
    agree = F.col("least") == F.col("most")
    one = one.select("evidence_hash", F.when(agree, F.col("least")).alias("disposition"), "review_seconds", F.when(agree, "carried").otherwise("conflicting").alias("state"))
    return candidate.join(one, "evidence_hash").select("finding_id", "disposition", "review_seconds", "state")
