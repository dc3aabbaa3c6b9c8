"""spark-submit entry. Exit codes: 0 done, 2 wrong call, 3 invalid data, 4 findings or results that block."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import detect, dispatch, inject, manifest, pit, policy, score
from factlens.plans import benchmark, report
from factlens.schema import fact_errors
from factlens.sources import mapping
from factlens.sources.sinks import write_public, write_table

FAMILIES = (*dispatch.FAMILIES, "missing")
RULES = {"detector": policy.DetectorRule, "concept_unit": policy.ConceptUnit, "publication_lag": policy.PublicationLag, "reporting_frequency": policy.ReportingFrequency}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factlens")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *needed: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        return c

    command("validate", "check facts and lineages", "facts")
    command("snapshot", "write the snapshot of a date", "facts", "as-of", "out")
    c = command("audit", "run detectors over the snapshot of a date", "facts", "as-of", "out")
    c.add_argument("--detectors", nargs="*", default=list(detect.DETECTORS), choices=list(detect.DETECTORS))
    c.add_argument("--fail-on", choices=("low", "medium", "high"))
    c = command("inject", "write corrupted facts, and apart from them the manifest", "facts", "as-of", "out")
    c.add_argument("--family", required=True, choices=FAMILIES)
    c.add_argument("--severity", default="medium", choices=inject.SEVERITIES)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--mechanism", default="random", choices=inject.MECHANISMS)
    c = command("evaluate", "score the findings of an audit against a manifest", "findings", "manifest")
    c.add_argument("--family", required=True, choices=dispatch.FAMILIES)
    c = command("benchmark", "run a grid of cases and sum them up", "facts", "history", "as-of", "out")
    c.add_argument("--seeds", nargs="+", type=int, default=[0])
    c = command("report", "audit an external table under a policy", "input", "mapping", "policy", "as-of", "out")
    c.add_argument("--format", default="parquet", choices=("csv", "parquet", "arrow"))
    command("explain", "show a finding and the facts it is about", "findings", "facts", "finding")
    return p


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_mapping(body: dict) -> mapping.Mapping:
    return mapping.Mapping(**{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()})


def read_policy(body: dict) -> report.Policy:
    """Rules as {"kind": ..., and the rule's fields}; a scope is an object, accepted units a list."""
    rules = []
    for r in body.get("rules", []):
        own = {k: policy.Scope(**v) if k == "scope" else tuple(v) if isinstance(v, list) else v for k, v in r.items() if k != "kind"}
        rules.append(RULES[r["kind"]](**own))
    return report.Policy(tuple(rules), tuple(body.get("exceptions", ())), body.get("dataset_name"))


def _say(**what) -> None:
    print(json.dumps(what, sort_keys=True, default=str))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return COMMANDS[args.command](spark, args)
    except (pit.AmbiguousHistory, manifest.UnfitFacts, mapping.InvalidDataset, mapping.MappingError, policy.PolicyError, inject.NoEligibleTarget) as e:
        _say(error=str(e))
        return 3


def validate(spark: SparkSession, args) -> int:
    facts = spark.read.parquet(args.facts)
    bad, broken = fact_errors(facts).count(), pit.lineage_violations(facts).count()
    _say(invalid_facts=bad, lineage_violations=broken)
    return 3 if bad or broken else 0


def snapshot(spark: SparkSession, args) -> int:
    write_table(_snapshot(spark, args), args.out, "snapshot")
    return 0


def _snapshot(spark: SparkSession, args) -> DataFrame:
    return pit.snapshot(spark.read.parquet(args.facts), args.as_of, check=True)


def audit(spark: SparkSession, args) -> int:
    path = write_public(detect.run_detectors(pit.sanitize(_snapshot(spark, args)), args.as_of, tuple(args.detectors)), args.out, "findings")
    found = spark.read.parquet(path)
    print(json.dumps({f"{r.detector}.{r.severity}": r["count"] for r in found.groupBy("detector", "severity").count().collect()}, sort_keys=True))
    levels = ("low", "medium", "high")
    grave = levels[levels.index(args.fail_on) :] if args.fail_on else ()
    return 4 if found.filter(F.col("severity").isin(*grave)).limit(1).count() else 0


def inject_faults(spark: SparkSession, args) -> int:
    facts = spark.read.parquet(args.facts)
    manifest.require_clean(facts)
    if args.family == "revision_overwrite":
        snap = pit.snapshot(facts, args.as_of).drop("lineage_id", "seq")
        corrupted, hidden = inject.inject_revision_overwrite(snap, facts, args.as_of, args.severity, args.seed)
    elif args.family == "missing":
        corrupted, hidden = inject.inject_missing(facts, args.as_of, args.mechanism, args.severity, args.seed)
    else:
        corrupted, hidden = {"lookahead": inject.inject_lookahead, "unit_drift": inject.inject_unit_drift, "duplicate": inject.inject_duplicate}[args.family](facts, args.as_of, args.severity, args.seed)
    path = write_table(hidden, f"{args.out}/private", "manifest")
    write_table(corrupted, f"{args.out}/public", "facts")
    _say(faults=spark.read.parquet(path).count(), manifest=manifest.root_digest(spark.read.schema(hidden.schema).parquet(path)))
    return 0


def evaluate(spark: SparkSession, args) -> int:
    """Findings of the family's detector are true if they are for the records of exactly one fault."""
    found, hidden = spark.read.parquet(args.findings), spark.read.parquet(args.manifest)
    key = "affected" if args.family == "duplicate" else "injected_record_id"
    own = score.matches(found.filter(F.col("detector") == args.family), hidden, "affected", key, {})
    n = own.agg(F.count("*").alias("own"), F.count_if(F.col("status") == "true_positive").alias("hits")).first()
    findings, faults = found.count(), hidden.count()
    p, r = (n.hits / findings if findings else None), (n.hits / faults if faults else None)
    f = None if p is None or r is None else 0.0 if p + r == 0 else round(2 * p * r / (p + r), 9)
    _say(findings=findings, faults=faults, true_positives=n.hits, false_positives=findings - n.hits, missed=faults - n.hits, precision=p and round(p, 9), recall=r and round(r, 9), f1=f)
    return 0


def run_benchmark(spark: SparkSession, args) -> int:
    cases = benchmark.expand(spark, seeds=args.seeds).filter("kind = 'fault'").unionByName(benchmark.controls(spark, seed=min(args.seeds)))
    out = dispatch.dispatch(spark, cases, spark.read.parquet(args.facts), spark.read.parquet(args.history), args.as_of)
    write_public(out.results, args.out, "results")
    for r in benchmark.aggregate(out.results, ("fault_profile", "severity"), "lenient").orderBy("dimension", "member").collect():
        _say(**r.asDict())
    return 0


def external_report(spark: SparkSession, args) -> int:
    m, rules = read_mapping(_json(spark, args.mapping)), read_policy(_json(spark, args.policy))
    columns = [*m.columns.values(), *m.dimensions.values()]
    if args.format == "csv":
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(args.input)
    else:
        raw = mapping.read_arrow(spark, args.input) if args.format == "arrow" else mapping.read_parquet(spark, args.input, columns, tuple(c for f, c in m.columns.items() if f == "value"))
    out = report.audit_report(raw, m, rules, args.as_of)
    write_public(out.results, args.out, "results")
    write_public(out.evaluations, args.out, "evaluations")
    row = out.summary.first()
    _say(**row.asDict())
    return 4 if row.disposition == "blocking" else 0


def explain(spark: SparkSession, args) -> int:
    found = spark.read.parquet(args.findings).filter(F.col("finding_id") == args.finding).first()
    if found is None:
        _say(error=f"no finding {args.finding}")
        return 2
    ids = found.affected.split("|")[:100]
    rows = spark.read.parquet(args.facts).filter(F.col("record_id").isin(*ids)).select("record_id", "entity_id", "concept", "value", "unit", "period_end", "filed_on", "available_on", "accession_number")
    _say(finding=found.asDict(), records=[r.asDict() for r in rows.orderBy("record_id").collect()])
    return 0


COMMANDS = {"validate": validate, "snapshot": snapshot, "audit": audit, "inject": inject_faults, "evaluate": evaluate, "benchmark": run_benchmark, "report": external_report, "explain": explain}


if __name__ == "__main__":
    sys.exit(main())
