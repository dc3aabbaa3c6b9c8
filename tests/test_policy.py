"""Policies to the letter: thresholds, exceptions by pattern, evidence of availability, reports that fail closed."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factlens.operators import detect, pit, policy
from factlens.plans import report
from factlens.sources import mapping

from .test_engine import D, fact, facts

RULE = policy.PublicationLag("r", policy.Scope("n", "c"), "filing", 0, 1)


def results(spark, n):
    """One result a record of n entities of two records, in two units."""
    rows = [fact(i, entity_id=f"E{i // 2}", unit="USD" if i % 2 else "EUR") for i in range(n)]
    return policy.publication_lag(pit.sanitize(facts(spark, *rows)), RULE)


def brute(rows, exceptions):
    out = {}
    for r in rows:
        ids, fit = r.affected.split("|"), []
        for x in exceptions:
            own = {c: x.get(c) for c in policy.SCOPE if x.get(c)}
            if x["rule_id"] == r.rule_id and all(v in ids if c == "record_id" else getattr(r, c) == v for c, v in own.items()):
                fit.append((len(own), x["exception_id"], x))
        top = max((f[0] for f in fit), default=None)
        best = [f for f in fit if f[0] == top]
        out[r.affected] = None if not fit else "ambiguous" if len(best) > 1 else best[0][1]
    return out


def test_exceptions_against_brute_force(spark):
    rng = __import__("random").Random(4)
    df = results(spark, 40)
    rows = df.collect()
    ids = [r.affected for r in rows]
    pools = {"record_id": ids, "entity_id": [f"E{i}" for i in range(20)], "concept_namespace": ["n", "other"], "concept": ["c", "d"], "unit": ["USD", "EUR"]}
    exceptions = []
    for k in range(120):
        own = {c: rng.choice(pools[c]) for c in policy.SCOPE if rng.random() < (0.5 if c == "record_id" else 0.4)}
        exceptions.append({"exception_id": f"x{k:03}", "rule_id": rng.choice(["r", "r", "r", "q"]), "effect": "waive", "reason": "z"} | own)
    got = policy.resolve_exceptions(df, policy.exceptions_table(spark, exceptions), strict=False).collect()
    want = brute(rows, exceptions)
    assert {r.affected: "ambiguous" if r.ambiguous else r.exception_id for r in got} == want
    assert "ambiguous" in want.values() and len([v for v in want.values() if v and v != "ambiguous"]) > 5
    with pytest.raises(Exception, match="several exceptions fit equally"):
        policy.resolve_exceptions(df, policy.exceptions_table(spark, exceptions)).collect()


def test_a_hundred_thousand_exceptions_of_one_rule(spark):
    """The join is on equal keys, so results meet the exceptions that fit and no others."""
    given = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("exception_id"), F.lit("r").alias("rule_id"), F.lit(None).cast("string").alias("x_record_id"), F.concat(F.lit("E"), "id").alias("x_entity_id"), *[F.lit(None).cast("string").alias(f"x_{c}") for c in ("concept_namespace", "concept", "unit")], F.lit("waive").alias("effect"), F.lit(None).cast("string").alias("override"), F.lit("z").alias("reason"))
    out = policy.resolve_exceptions(results(spark, 30), given)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.entity_id, r.exception_id) for r in out.collect()) == sorted((f"E{i // 2}", f"x{i // 2}") for i in range(30))


def test_results_of_one_rule_do_not_meet_in_one_task(spark):
    """All results share a key where an exception names the concept alone: results are not shuffled for it, nor put together again."""
    rows = [{"exception_id": "a", "rule_id": "r", "effect": "waive", "reason": "z", "concept": "c"}, {"exception_id": "b", "rule_id": "r", "effect": "waive", "reason": "z", "concept": "c", "entity_id": "E3"}]
    out = policy.resolve_exceptions(results(spark, 30), policy.exceptions_table(spark, rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(result_id" not in plan
    assert sorted((r.entity_id, r.exception_id) for r in out.collect()) == sorted((f"E{i // 2}", "b" if i // 2 == 3 else "a") for i in range(30))


def test_exceptions_of_another_dataset_do_not_fit(spark):
    df = results(spark, 2)
    rows = [{"exception_id": "a", "rule_id": "r", "effect": "waive", "reason": "z", "dataset_name": "one"}]
    waived = lambda name: policy.resolve_exceptions(df, policy.exceptions_table(spark, rows), name).filter("effective_action IS NULL").count()
    assert (waived("one"), waived("two"), waived(None)) == (2, 0, 0)
    assert policy.resolve_exceptions(df, policy.exceptions_table(spark, []), "one").filter("exception_id IS NULL").count() == 2


def test_findings_of_several_records(spark):
    twin = [fact(1, accession_number="a"), fact(2, accession_number="a"), fact(3, entity_id="E9")]
    audit = pit.sanitize(facts(spark, *twin))
    found = detect.run_detectors(audit, "2030-01-01", ("duplicate",))
    rules = [policy.DetectorRule("d", "duplicate")]
    (r,) = policy.detector_results(found, audit, rules).collect()
    assert r.entity_id == "E1" and r.concept == "c" and len(r.affected.split("|")) == 2
    with pytest.raises(Exception, match="not audited"):
        policy.detector_results(found, audit.filter(F.col("record_id") != r.affected.split("|")[1]), rules).collect()
    with pytest.raises(policy.PolicyError, match="several rules"):
        policy.detector_results(found, audit, [*rules, policy.DetectorRule("e", "duplicate", action="warning")])


def test_the_threshold_of_a_rule_reaches_its_detector(spark):
    rows = [fact(i, period_end=D(f"20{10 + i}-01-01"), value=Decimal(3000 if i == 3 else 100)) for i in range(6)]
    audit = pit.sanitize(facts(spark, *rows))
    n = lambda t: policy.run_detector_rules(audit, "2030-01-01", [policy.DetectorRule("u", "unit_drift", threshold=t)]).count()
    assert n(20) == 1 and n(40) == 0
    with pytest.raises(ValueError, match="threshold"):
        policy.DetectorRule("l", "lookahead", threshold=5)
    assert policy.run_detector_rules(audit, "2030-01-01", [policy.DetectorRule("u", "unit_drift", enabled=False, reason="z")]).count() == 0


HEADER = ["entity", "amount", "end", "filed", "row"]
CONSTANTS = {"concept_namespace": "n", "concept": "c", "unit": "USD", "period_type": "instant", "source_name": "s", "source_locator": "l"}
COLUMNS = {"entity_id": "entity", "value": "amount", "period_end": "end", "filed_on": "filed", "source_row_key": "row"}


def raw(spark, rows):
    return mapping.read_rows(spark, [dict(zip(HEADER, r, strict=True)) for r in rows], HEADER)


ROWS = [("A", "1", "2020-01-01", "2020-01-20", "r1"), ("A", "2", "2020-04-01", "2020-04-20", "r2"), ("B", "3", "2020-01-01", "2020-01-09", "r3")]


def test_a_rule_on_days_that_nobody_stated_raises(spark, tmp_path):
    rule = policy.PublicationLag("lag", policy.Scope("n", "c"), "availability", 0, 10)
    assumed, stated = mapping.Mapping(COLUMNS, CONSTANTS), mapping.Mapping(COLUMNS, CONSTANTS, available_when_filed=True)
    for m, ok in ((assumed, False), (stated, True)):
        audit = pit.sanitize(pit.snapshot(mapping.load(raw(spark, ROWS), m), "2021-01-01"))
        audit.write.parquet(f"file://{tmp_path}/{ok}")
        for a in (audit, spark.read.parquet(f"file://{tmp_path}/{ok}")):  # the origin is written with the table
            if ok:
                assert policy.publication_lag(a, rule).count() == 2
            else:
                with pytest.raises(policy.PolicyError, match="lag"):
                    policy.publication_lag(a, rule)
        assert policy.publication_lag(audit, policy.PublicationLag("lag", policy.Scope("n", "c"), "filing", 0, 10)).count() == 2
    with pytest.raises(policy.PolicyError):
        report.audit_report(raw(spark, ROWS), assumed, report.Policy((rule,)), "2021-01-01")


def test_reports_fail_closed(spark):
    m = mapping.Mapping(COLUMNS, CONSTANTS, available_when_filed=True)
    lag = policy.PublicationLag("lag", policy.Scope("n", "c"), "availability", 0, 10)
    out = report.audit_report(raw(spark, ROWS), m, report.Policy((lag, policy.ReportingFrequency("gap", policy.Scope("n", "c", entity_id="B"), 30))), "2021-01-01")
    assert tuple(out.summary.first()) == (3, 3, 0, 0, 2, 0, 0, "warning")
    assert sorted((r.rule_id, r.status, r.reason, r.matching, r.results) for r in out.evaluations.collect()) == [("gap", "not_evaluated", "insufficient_distinct_periods", 1, 0), ("lag", "evaluated", None, 3, 2)]
    with pytest.raises(mapping.InvalidDataset):
        report.audit_report(raw(spark, [*ROWS, ("A", "x", "2020-01-01", "2020-01-20", "r9")]), m, report.Policy((lag,)), "2021-01-01")
    two = tuple({"exception_id": x, "rule_id": "lag", "effect": "waive", "reason": "z"} | s for x, s in (("a", {"entity_id": "A"}), ("b", {"unit": "USD"})))
    with pytest.raises(Exception, match="several exceptions fit equally"):
        report.audit_report(raw(spark, ROWS), m, report.Policy((lag,), two), "2021-01-01")
    for bad in (lambda: report.Policy((lag, lag)), lambda: report.Policy((lag,), ({"exception_id": "a", "rule_id": "none", "effect": "waive", "reason": "z"},))):
        with pytest.raises(policy.PolicyError):
            bad()


def test_report_of_an_empty_table(spark):
    m = mapping.Mapping(COLUMNS, CONSTANTS, available_when_filed=True)
    rules = report.Policy((policy.DetectorRule("d", "lookahead"), policy.ConceptUnit("u", policy.Scope("n", "c"), ("USD",))))
    out = report.audit_report(raw(spark, ROWS).limit(0), m, rules, "2021-01-01")
    assert tuple(out.summary.first()) == (0, 0, 0, 0, 0, 0, 0, "passed")
    assert sorted((r.rule_id, r.status, r.reason) for r in out.evaluations.collect()) == [("d", "evaluated", None), ("u", "not_evaluated", "no_matching_records")]
