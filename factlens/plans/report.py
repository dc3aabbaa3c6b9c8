"""The audit of an external table, from its rows to a disposition under a policy."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators import pit, policy
from factlens.sources import mapping
from factlens.sources.sinks import work_folder

APPLY = {policy.ConceptUnit: policy.concept_unit, policy.PublicationLag: policy.publication_lag, policy.ReportingFrequency: policy.reporting_frequency}


@dataclass(frozen=True)
class Policy:
    """Rules of all kinds, and exceptions as exceptions_table has them."""

    rules: tuple
    exceptions: tuple[dict, ...] = ()
    dataset_name: str | None = None

    def __post_init__(self):
        ids = [r.rule_id for r in self.rules]
        if again := sorted({i for i in ids if ids.count(i) > 1}):
            raise policy.PolicyError(f"repeated rule ids: {again}")
        if unknown := sorted({x["rule_id"] for x in self.exceptions} - set(ids)):
            raise policy.PolicyError(f"exceptions of unknown rules: {unknown}")


@dataclass(frozen=True)
class Report:
    """profile, diagnostics: of the input. evaluations: a row a rule. results: with their effective action. summary: one row."""

    profile: DataFrame
    diagnostics: DataFrame
    findings: DataFrame
    evaluations: DataFrame
    results: DataFrame
    summary: DataFrame = field(repr=False)


def audit_report(raw: DataFrame, m: mapping.Mapping, rules: Policy, as_of: date | str, most: int = 100) -> Report:
    """Validates `raw`, takes its snapshot, runs the detectors and rules of the policy, resolves exceptions and sums up.

    Fails closed: an invalid row, a revision history that contradicts itself, a lag rule on a day that nobody stated, several rules
    for a detector, a finding on a record that is not audited, or two exceptions that fit equally raise, and nothing is reported. The
    summary has the counts of the input and of the snapshot, of findings and of results by effective action, and the disposition.
    Results and the snapshot are written once; what is returned reads them.
    """
    spark, root = raw.sparkSession, work_folder(raw.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    out = mapping.profiled(raw, m, most)
    counts = out.profile.first()
    if not counts.valid:
        raise mapping.InvalidDataset(f"{counts.error_count} rows are invalid")
    audit = pit.sanitize(pit.snapshot(out.facts, as_of))
    policy.require_evidence(audit, list(rules.rules))
    audit = stored(audit, "audit")
    detectors = [r for r in rules.rules if isinstance(r, policy.DetectorRule)]
    findings = stored(policy.run_detector_rules(audit, as_of, detectors), "findings")
    parts = [policy.detector_results(findings, audit, detectors), *[APPLY[type(r)](audit, r) for r in rules.rules if type(r) in APPLY]]
    exceptions = policy.exceptions_table(spark, list(rules.exceptions))
    results = stored(policy.resolve_exceptions(reduce(DataFrame.unionByName, parts), exceptions, rules.dataset_name), "results")
    evaluations = policy.roll_up(spark, list(rules.rules), results, policy.evaluated(audit, list(rules.rules)))
    summary = policy.disposition(results).crossJoin(F.broadcast(audit.agg(F.count("*").alias("snapshot_records")))).crossJoin(F.broadcast(findings.agg(F.count("*").alias("findings"))))  # one row each
    summary = summary.select(F.lit(counts.row_count).cast("long").alias("source_records"), "snapshot_records", "findings", "blocking", "warning", "informational", "waived", "disposition")
    return Report(out.profile, out.diagnostics, findings, evaluations, results, summary)
