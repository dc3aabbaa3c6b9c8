"""Hand answers, boundaries and metamorphic checks of the engine's operators."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factlens.functions.ident import canonical_decimal, snapshot_digest
from factlens.operators import detect, impact, inject, pit, policy, replay, review, score, series
from factlens.plans import benchmark
from factlens.schema import AUDIT_COLUMNS, FACT, fact_errors
from factlens.sources import companyfacts, generate, mapping, sinks, testdata

D = date.fromisoformat


def fact(i, **changes):
    row = {"record_id": f"rec_{i:016x}", "entity_id": "E1", "entity_name": None, "concept_namespace": "n", "concept": "c", "value": Decimal("100"), "unit": "USD", "dimensions": [], "period_type": "instant", "period_start": None, "period_end": D("2020-03-31"), "filed_on": D("2020-04-30"), "available_on": D("2020-04-30"), "form": "10-Q", "accession_number": f"a{i}", "source_name": "s", "source_locator": "l", "source_row_key": f"k{i}"} | changes
    return tuple(row[f.name] for f in FACT)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def ids(df, col="record_id"):
    return sorted(int(r[col][4:], 16) for r in df.collect())


def test_visible_is_inclusive(spark):
    df = facts(spark, fact(1), fact(2, available_on=D("2020-05-01")))
    assert ids(pit.snapshot(df, "2020-04-30")) == [1]


def test_lineages(spark):
    df = facts(
        spark, fact(1, source_row_key="x#r1"), fact(2, source_row_key="x#r2", available_on=D("2020-06-01"), filed_on=D("2020-06-01")), fact(3, source_row_key="x#r01"), fact(4, source_row_key="x#r0"), fact(5, source_row_key="plain"),
    )
    assert ids(pit.snapshot(df, "2020-05-01")) == [1, 3, 4, 5]
    assert ids(pit.snapshot(df, "2020-06-01", check=True)) == [2, 3, 4, 5]


def test_an_invalid_invisible_member_is_an_error(spark):
    df = facts(spark, fact(1, source_row_key="x#r1"), fact(2, source_row_key="x#r2", available_on=D("2021-06-01"), filed_on=D("2020-01-01")))
    with pytest.raises(pit.AmbiguousHistory):
        pit.snapshot(df, "2020-05-01", check=True)


@pytest.mark.parametrize(("days", "severity"), [(1, "low"), (13, "low"), (14, "medium"), (29, "medium"), (30, "high")])
def test_lookahead_severity(spark, days, severity):
    df = facts(spark, fact(1, available_on=D("2020-03-31"), filed_on=date.fromordinal(D("2020-03-31").toordinal() + days)))
    assert [r.severity for r in detect.lookahead(pit.sanitize(df), "2020-12-31").collect()] == [severity]


def drift_series(values, **last):
    return [fact(i, **{"value": Decimal(v), "period_end": date.fromordinal(D("2020-01-01").toordinal() + 60 * i)} | (last if i == len(values) - 1 else {})) for i, v in enumerate(values)]


def test_series_needs_three_rows_and_no_repeated_coordinate(spark):
    assert series.comparable_series(facts(spark, *drift_series(["1", "2"])), "2022-01-01").count() == 0
    assert series.comparable_series(facts(spark, *drift_series(["1", "2", "3"], period_end=D("2020-01-01"))), "2022-01-01").count() == 0
    assert series.comparable_series(facts(spark, *drift_series(["1", "2", "3"])), "2022-01-01").count() == 3


def test_drift_is_found_and_confidence_follows_neighbours(spark):
    found = {int(r.record_id[4:], 16): r for r in detect.unit_drift(pit.sanitize(facts(spark, *drift_series(["100", "101", "102000", "103", "104"]))), "2022-01-01").collect()}
    assert (found[2].factor, found[2].operation, found[2].severity, found[2].confidence) == (1000, "divide", "medium", "strong")


def test_ratio_of_exactly_fifty(spark):
    at = lambda v: detect.unit_drift(pit.sanitize(facts(spark, *drift_series([v, "100", "100"]))), "2022-01-01").filter("record_id = 'rec_0000000000000000'").count()
    assert at("5000") == 1  # passes the gate; divided by 100 it is near
    assert at("4999.999999") == 0
    assert at("500000000000") == 0  # 5e9 times: a correction by 1e6 leaves 5000


def test_zero_values_are_skipped(spark):
    rows = series.nearest_nonzero(series.comparable_series(facts(spark, *drift_series(["1", "0", "3"])), "2022-01-01")).orderBy("period_end").collect()
    assert [(r.previous_value, r.next_value) for r in rows] == [(None, Decimal(3)), (Decimal(1), None)]


def test_rows_that_differ_only_in_form_are_duplicates(spark):
    df = facts(spark, fact(1, accession_number="a"), fact(2, accession_number="a", form="8-K"), fact(3, accession_number=None), fact(4, accession_number=None))
    assert [r.affected for r in detect.exact_duplicates(pit.sanitize(df), "2021-01-01").orderBy("affected").collect()] == ["rec_0000000000000001|rec_0000000000000002", "rec_0000000000000003|rec_0000000000000004"]


def test_filed_on_the_day_is_no_overwrite(spark):
    df = facts(spark, fact(1, available_on=D("2020-04-01")), fact(2, available_on=D("2020-04-01"), filed_on=D("2020-05-01")), fact(3, available_on=D("2020-04-01"), filed_on=D("2020-05-01"), accession_number=None))
    assert ids(detect.revision_overwrite(pit.sanitize(df), "2020-04-30")) == [2]


def test_target_count():
    assert series.target_count(1, "0.01", 100) == 1
    assert series.target_count(101, "0.02", 100) == 3
    assert series.target_count(500, "0.5", 100) == 100
    assert series.target_count(0, "0.5", 100) == 0


def test_expectation_due_on_the_day(spark):
    df = facts(spark, fact(1, period_end=D("2020-01-31")), fact(2, period_end=D("2020-06-30")))
    schema = "expected_observation_id string, context string, entity_id string, concept_namespace string, concept string, unit string, dimensions array<struct<axis:string,member:string>>, period_type string, source_name string, source_locator string, period_start date, period_end date, expected_by date"
    mk = lambda i, end, by: (i, "survivorship", "E1", "n", "c", "USD", [], "instant", "s", "l", None, D(end), D(by))
    exp = spark.createDataFrame([mk("x1", "2020-03-31", "2020-12-31"), mk("x2", "2020-03-31", "2021-01-01"), mk("x3", "2020-06-30", "2020-12-31")], schema)
    (r,) = detect.missing_observations(pit.sanitize(df), exp, "2020-12-31").collect()
    assert (r.expected_observation_id, r.previous_end, r.next_end, r.severity) == ("x1", D("2020-01-31"), D("2020-06-30"), "high")


def test_gap_of_exactly_the_maximum_is_no_result(spark):
    df = facts(spark, fact(1, period_end=D("2020-01-01")), fact(2, period_end=D("2020-04-10")), fact(3, period_end=D("2020-07-20")))
    assert series.reporting_gaps(df, 101).count() == 0
    assert series.reporting_gaps(df, 100).select("gap_days").collect() == [(101,)]


def test_equally_specific_exceptions_are_ambiguous(spark):
    audit = pit.sanitize(facts(spark, fact(1)))
    rule = policy.PublicationLag("r", policy.Scope("n", "c"), "filing", 0, 1)
    rows = [{"exception_id": x, "rule_id": "r", "effect": "waive", "reason": "z"} | s for x, s in (("a", {"entity_id": "E1"}), ("b", {"unit": "USD"}))]
    got = policy.resolve_exceptions(policy.publication_lag(audit, rule), policy.exceptions_table(spark, rows), strict=False).collect()
    assert [(r.ambiguous, r.effective_action) for r in got] == [(True, None)]


def test_zero_prior_is_excluded_from_growth(spark):
    df = facts(spark, fact(1, value=Decimal(0), period_end=D("2019-01-01")), fact(2, period_end=D("2020-01-01")), fact(3, entity_id="E2", period_end=D("2019-01-01")), fact(4, entity_id="E2", value=Decimal(150), period_end=D("2020-01-01")))
    assert impact.growth_ranking(df, ("2019-01-01", "2019-12-31"), ("2020-01-01", "2020-12-31")).collect() == [("E2", 0.5, 1)]


@pytest.mark.parametrize(("text", "canonical"), [("1.500000", "1.5"), ("100.000000", "100"), ("-0.000000", "0"), ("0.000001", "0.000001"), ("1200.000000", "1200")])
def test_canonical_decimal(spark, text, canonical):
    assert spark.range(1).select(canonical_decimal(F.lit(text))).first()[0] == canonical


def test_digest_ignores_order_and_partitions(spark):
    df = generate.performance_corpus(spark, 5)
    a = snapshot_digest(df, df.columns).first()
    assert a == snapshot_digest(df.orderBy(F.desc("record_id")).repartition(7), df.columns).first()
    assert a != snapshot_digest(df.limit(99), df.columns).first()


def test_sanitize_is_an_allow_list(spark):
    assert tuple(pit.sanitize(facts(spark, fact(1)).withColumn("secret", F.lit(1))).columns) == AUDIT_COLUMNS


def test_detectors_import_no_truth():
    from pathlib import Path

    text = Path(detect.__file__).read_text()
    assert "inject" not in text and "score" not in text


@pytest.mark.parametrize("mechanism", ["random", "periodic_gap", "entity_dependent", "concept_dependent", "survivorship", "source_outage"])
def test_missing_replay_restores(spark, mechanism):
    clean = generate.performance_corpus(spark, 4)
    corrupted, manifest = inject.inject_missing(clean, "2030-01-01", mechanism, "medium", 1)
    assert corrupted.count() + manifest.count() == clean.count() and manifest.count() > 0
    assert tuple(replay.residual(clean, replay.replay("missing", corrupted, manifest)).first()) == (0, 0)


def test_a_whole_group_goes_whatever_its_size_if_asked(spark):
    clean = generate.performance_corpus(spark, 4)
    with pytest.raises(inject.NoEligibleTarget, match="10 are allowed"):
        inject.inject_missing(clean, "2030-01-01", "source_outage", "low", 1, 10)
    kept, manifest = inject.inject_missing(clean, "2030-01-01", "source_outage", "low", 1, 10, bound_whole=False)
    assert kept.count() == 0 and manifest.count() == clean.count()
    # A mechanism that takes a fraction keeps its bound.
    assert inject.inject_missing(clean, "2030-01-01", "random", "high", 1, 10, bound_whole=False)[1].count() == 10
    single = clean.dropDuplicates(["entity_id", "period_end"])
    rows = {r.mechanism: r for r in score.missing_evaluation(single, "2030-01-01", ("random", "source_outage"), "low", 1, 10, bound_whole=False).collect()}
    assert rows["source_outage"].targets == rows["source_outage"].true_positives == single.count() > 10 and 0 < rows["random"].targets <= 10


@pytest.mark.parametrize(("n", "fraction", "most"), [(1, "0.02", 5), (9, "0.05", 5), (4000, "0.02", 10_000), (4000, "0.10", 150), (4000, "0.50", 10_000)])
def test_targets_are_ranked_apart(spark, n, fraction, most):
    """The first by digest, whatever their number; ranking them takes a task for each bucket, not one for all."""
    import hashlib

    df = spark.range(n).select(F.concat(F.lit("r"), "id").alias("u"), "id").repartition(5)
    got = series.select_targets(df, "u", "x", 7, fraction, most)
    digest = lambda i: hashlib.sha256(f'{{"eligibility_unit_id":"r{i}","namespace":"x","seed":7}}'.encode()).hexdigest()
    want = sorted(range(n), key=lambda i: (digest(i), f"r{i}"))[: series.target_count(n, fraction, most)]
    assert [(r.id, r.target_rank) for r in got.orderBy("target_rank").collect()] == [(i, k) for k, i in enumerate(want)]
    assert "Window" not in got._jdf.queryExecution().toString() and got.columns == ["u", "id", "digest", "target_rank"]


def test_results_do_not_depend_on_order_or_partitions(spark):
    df = generate.performance_corpus(spark, 6)
    base = sorted(inject.inject_unit_drift(df, "2030-01-01", "high", 2)[0].select("record_id", "value").collect())
    assert base == sorted(inject.inject_unit_drift(df.repartition(9).orderBy("value"), "2030-01-01", "high", 2)[0].select("record_id", "value").collect())


def test_every_injected_drift_in_a_flat_series_is_found(spark):
    clean = generate.performance_corpus(spark, 5)
    corrupted, manifest = inject.inject_unit_drift(clean, "2030-01-01", "medium", 4)
    found = detect.unit_drift(pit.sanitize(corrupted), "2030-01-01")
    m = score.metrics(score.matches(found, manifest, "record_id", "injected_record_id", {"factor": "factor"}), manifest.count(), clean.count(), "unit_drift").first()
    assert m.missed == 0 and m.recall == 1.0


def test_ambiguous_match(spark):
    found = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "record_id string")
    truth = spark.createDataFrame([("a",), ("b",), ("z",)], "injected_record_id string")
    got = sorted((r.record_id, r.status) for r in score.matches(found, truth, "record_id", "injected_record_id", {}).collect())
    assert got == [("a", "ambiguous"), ("a", "ambiguous"), ("b", "true_positive"), ("c", "false_positive")]


def test_mapping(spark, tmp_path):
    header = ["entity", "amount", "end", "filed", "row", "lin", "seq"]
    (tmp_path / "x.csv").write_text("entity,amount,end,filed,row,lin,seq\nA,1.50,2020-03-31,2020-04-30,r1,,\nA,2,2020-02-30,2020-04-30,r2,,\nB,1e3,2020-03-31,2020-04-30,r3,,\nB,3,2020-03-31,2020-04-30,r4,L,2\nB,3,2020-03-31,2020-04-30,r5,L,\nA,9,2020-03-31,2020-04-30,r1,,\n")
    m = mapping.Mapping({"entity_id": "entity", "value": "amount", "period_end": "end", "filed_on": "filed", "source_row_key": "row", "lineage": "lin", "sequence": "seq"}, {"concept_namespace": "n", "concept": "c", "unit": "USD", "period_type": "instant", "source_name": "s", "source_locator": "l"})
    raw = mapping.read_csv(spark, str(tmp_path / "x.csv"), header)
    good, bad = mapping.normalize(raw, m)
    assert good.schema.names == FACT.names and good.count() == 2 and fact_errors(good).count() == 0
    assert sorted((r.source_row_key, r.error_code) for r in bad.collect()) == [("r1", "normalization.duplicate_source_identity"), ("r2", "normalization.invalid_date"), ("r3", "normalization.invalid_decimal"), ("r5", "normalization.invalid_revision")]
    with pytest.raises(mapping.InvalidDataset):
        mapping.load(raw, m)
    with pytest.raises(mapping.MappingError):
        mapping.normalize(raw.drop("lin"), m)
    with pytest.raises(mapping.MappingError):
        mapping.normalize(raw.withColumn("amount", F.lit(1.5)), m)


def test_arrow_equals_rows(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": ["x", "y"], "b": pa.array([1, None], pa.int64())})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, mapping.read_arrow(spark, str(tmp_path / "f.arrow")).collect()), key=str) == [("x", 1), ("y", None)]
    assert mapping.read_rows(spark, [{"a": "x"}], ["a"]).collect() == [("x",)]


def test_companyfacts_keeps_digits_and_reasons(spark):
    doc = '{"cik":320,"entityName":"X","facts":{"gaap":{"Cash":{"label":"l","units":{"USD":[{"end":"2020-03-31","val":352583000000.10,"accn":"a","form":"10-Q","filed":"2020-05-01"},{"end":"2020-03-31","val":352583000000.10,"accn":"a","form":"10-Q","filed":"2020-05-01"},{"start":"2020-04-01","end":"2020-03-31","val":1,"accn":"b","form":"10-Q","filed":"2020-05-01"}]}}},"dei":{"N":{"units":{"x":[{"end":"2020-03-31","val":1,"accn":"c","form":"10-Q","filed":"2020-05-01"}]}}}}}'
    rules = companyfacts.Rules(("gaap",), ("Cash",), ("USD",), ("10-Q",), ("2019-01-01", "2021-01-01"))
    flat = companyfacts.flatten(spark.createDataFrame([(doc,)], "json string"), rules)
    assert [str(r.value) for r in companyfacts.facts(flat).collect()] == ["352583000000.100000"] * 2
    assert sorted(r.reason for r in companyfacts.exclusions(flat).collect()) == ["period_shape", "taxonomy_not_allowed"]


def test_grid_and_seeds(spark):
    assert benchmark.expand(spark, seeds=range(2)).count() == 4 * 3 * 2 + 2
    with pytest.raises(PermissionError):
        benchmark.expand(spark, seeds=[1000])
    with pytest.raises(ValueError):
        benchmark.seed_class(50)


def test_a_failing_case_does_not_stop_others(spark):
    def one(case):
        if case == "b":
            raise RuntimeError("private detail")
        return "done"

    rows = sorted(map(tuple, benchmark.run_cases(spark, ["a", "b"], one).collect()))
    assert rows == [("a", "ok", None, "done"), ("b", "failed", "RuntimeError", None)]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "x.json")
    assert sinks.store_text(spark, p, "{}") and not sinks.store_text(spark, p, "{}")
    with pytest.raises(sinks.ArtifactConflict):
        sinks.store_text(spark, p, "[]")
    known = sinks.checksums(spark, p)
    assert sinks.verify_checksums(spark, p, known).count() == 0
    with pytest.raises(ValueError):
        sinks.write_public(spark.range(1).withColumnRenamed("id", "target_rank"), str(tmp_path), "t")
    assert sinks.leaks(spark.createDataFrame([("ok",), ('{"target_rank":1}',)], "value string")).count() == 1


def test_rerun_diff(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "finding_id string, severity string, confidence string")
    got = sorted(map(tuple, review.rerun_diff(rows(("a", "x", "y"), ("b", "x", "y"), ("c", "x", "y")), rows(("b", "x", "y"), ("c", "z", "y"), ("d", "x", "y"))).collect()))
    assert got == [("a", "removed"), ("b", "unchanged"), ("c", "changed"), ("d", "added")]


def test_streaming_lookahead_equals_batch(spark, tmp_path):
    from factlens.streaming.audit import lookahead_stream

    df = pit.sanitize(facts(spark, fact(1, available_on=D("2020-03-31")), fact(2)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = lookahead_stream(stream, "2021-01-01").writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.record_id for r in spark.table("hits").collect()] == [r.record_id for r in detect.lookahead(df, "2021-01-01").collect()]


def test_no_eligible_row_raises(spark):
    with pytest.raises(inject.NoEligibleTarget):
        inject.inject_lookahead(facts(spark, fact(1)), "2020-01-01", "low", 1)


def test_a_finding_corroborates_one_fault_of_another_family_only(spark):
    schema = "finding_id string, detector string, affected string, entity_id string, severity string, confidence string"
    rows = [("f1", "lookahead", "i1", "E", "low", "c"), ("f2", "duplicate", "i2|z", "E", "low", "c"), ("f3", "duplicate", "i1|i2", "E", "low", "c"), ("f4", "duplicate", "z|y", "E", "low", "c"), ("f5", "lookahead", "o2", "E", "low", "c"), ("f6", "revision_overwrite", "i1", "E", "high", "c")]
    clean = spark.createDataFrame([("g", "revision_overwrite", "o1", "E", "high", "c")], schema)
    manifest = spark.createDataFrame([("o1", "i1"), ("o2", "i2")], "original_record_id string, injected_record_id string")
    got = {r.finding_id: r.interpretation for r in score.interpret(spark.createDataFrame(rows, schema), manifest, clean, "lookahead").collect()}
    assert got == {"f1": "primary_matched", "f2": "secondary_corroborating", "f3": "unmatched", "f4": "unmatched", "f5": "unmatched", "f6": "independent_background"}


def test_cohort_mean_is_null_without_observations_and_refuses_several(spark):
    schema = "expected_observation_id string, entity_id string, concept_namespace string, concept string, unit string, period_end date, expected_by date"
    exp = spark.createDataFrame([("x", "E1", "n", "c", "USD", D("2020-03-31"), D("2020-05-01"))], schema)
    states = impact.states(clean=facts(spark, fact(1, value=Decimal("0.000003"))), corrupted=facts(spark, fact(2, entity_id="E2")))
    assert sorted(map(tuple, impact.cohort_mean(exp, states, "2021-01-01").collect())) == [("clean", Decimal("0.000003")), ("corrupted", None)]
    with pytest.raises(Exception, match="several facts meet x"):
        impact.cohort_mean(exp, impact.states(clean=facts(spark, fact(1), fact(2))), "2021-01-01").collect()


def test_cohort_mean_counts_every_fact_of_an_expectation(spark, compare, tmp_path):
    """Two orders of one customer on an expected day: the mean is that of both, as in SQL."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from factlens.plans.queries import ORACLE, QUERIES

    days = [D("1995-03-31"), D("1995-03-31"), D("1996-06-30")]
    orders = {"o_orderkey": [1, 2, 3], "o_custkey": [7, 7, 8], "o_orderstatus": ["O"] * 3, "o_totalprice": [10.0, 30.5, 2.25], "o_orderdate": [datetime(d.year, d.month, d.day) for d in days], "o_orderpriority": ["1-URGENT"] * 3}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [7, 8, 9]}), tmp_path / "customer.parquet")
    compare(QUERIES["impact_cohort_mean"], ORACLE["impact_cohort_mean"], str(tmp_path))
    assert QUERIES["impact_cohort_mean"](spark, str(tmp_path)).first().figure == Decimal("14.25")


def test_policy_rules_are_checked(spark):
    with pytest.raises(ValueError, match="reason"):
        policy.DetectorRule("r", "lookahead", enabled=False)
    audit = pit.sanitize(facts(spark, fact(1)))
    rule = policy.PublicationLag("r", policy.Scope("n", "c"), "filing", 0, 1)
    rows = [{"exception_id": x, "rule_id": "r", "effect": "waive", "reason": "z"} | s for x, s in (("a", {"entity_id": "E1"}), ("b", {"unit": "USD"}))]
    results = policy.publication_lag(audit, rule)
    with pytest.raises(policy.AmbiguousException):
        policy.require_clear(policy.resolve_exceptions(results, policy.exceptions_table(spark, rows), strict=False))
    assert policy.require_clear(policy.resolve_exceptions(results, policy.exceptions_table(spark, rows[:1]))).count() == 1


def single_case(facts, history, family, severity, seed, as_of):
    """One case by the operators that work on one case."""
    from factlens.operators import series as S

    level = inject.SEVERITIES.index(severity)
    if family == "revision_overwrite":
        clean = pit.snapshot(history, as_of).drop("lineage_id", "seq")
        corrupted, manifest = inject.inject_revision_overwrite(clean, history, as_of, severity, seed)
        n = S.adjacent_revisions(history, as_of, inject.MINIMUM_SIZE[level]).count()
    else:
        clean = facts
        corrupted, manifest = {"lookahead": inject.inject_lookahead, "unit_drift": inject.inject_unit_drift, "duplicate": inject.inject_duplicate}[family](facts, as_of, severity, seed)
        n = {"lookahead": lambda: inject.eligible_lookahead(facts, as_of, severity), "unit_drift": lambda: inject.eligible_unit_drift(facts, as_of), "duplicate": lambda: inject.eligible_duplicate(facts, as_of)}[family]().count()
    found = detect.run_detectors(pit.sanitize(corrupted), as_of)
    key = "affected" if family == "duplicate" else "injected_record_id"
    own = found.filter(F.col("detector") == family)
    if family == "unit_drift":
        own = own.filter(F.col("severity") == severity)
    hits = own.join(manifest, own["affected"] == manifest[key], "left_semi").count()
    return found.count(), manifest.count(), hits, n - (manifest.count() if family == "lookahead" else 0), {r.original_record_id for r in manifest.collect()}


@pytest.mark.parametrize(("family", "severity", "seed"), [("lookahead", "high", 1), ("unit_drift", "medium", 0), ("duplicate", "low", 7), ("revision_overwrite", "high", 4)])
def test_a_dispatched_case_is_the_single_case(spark, family, severity, seed):
    from factlens.operators import dispatch
    from factlens.plans import benchmark
    from factlens.sources import testdata

    d, as_of = "/root/testdata/sf0.001", "1999-01-01"
    facts, history = testdata.facts_orders(spark, d), testdata.lineages_lineitem(spark, d)
    cases = benchmark.expand(spark, (family,), (severity,), (seed, seed + 1)).filter("kind = 'fault'")
    got = dispatch.dispatch(spark, cases, facts, history, as_of)
    row = got.results.filter(F.col("seed") == seed).first()
    want = single_case(facts, history, family, severity, seed, as_of)
    assert (row.findings, row.faults, row.true_positives, row.eligible) == want[:4] and row.changed and row.restored and row.status == "ok"
    targets = got.manifest.filter(F.col("case_id") == row.case_id).orderBy("target_rank").collect()
    assert {r.record_id for r in targets} == want[4] and [r.target_rank for r in targets] == list(range(len(targets)))
    assert got.findings.filter(F.col("case_id") == row.case_id).count() == row.findings


def test_dispatch_edges(spark):
    """Without an eligible row a case has no target and is audited as it is; no case, no result; a family must be known."""
    from factlens.operators import dispatch
    from factlens.plans import benchmark
    from factlens.sources import testdata

    d, as_of = "/root/testdata/sf0.001", "1999-01-01"
    facts, history = testdata.facts_orders(spark, d).limit(0), testdata.lineages_lineitem(spark, d).limit(0)
    cases = benchmark.expand(spark, seeds=(0,)).filter("kind = 'fault'").unionByName(benchmark.controls(spark))
    rows = dispatch.dispatch(spark, cases, facts, history, as_of).results.collect()
    assert len(rows) == 16 and {(r.kind, r.status) for r in rows} == {("fault", "no_target"), ("clean_control", "ok")}
    assert {(r.findings, r.faults, r.eligible, r.changed, r.restored) for r in rows} == {(0, 0, 0, None, None)}
    assert dispatch.dispatch(spark, cases.limit(0), facts, history, as_of).results.count() == 0
    with pytest.raises(dispatch.UnknownFamily):
        dispatch.dispatch(spark, cases.withColumn("fault_profile", F.lit("other")), facts, history, as_of)


def test_jobs_do_not_grow_with_the_cases(spark):
    from factlens.operators import dispatch
    from factlens.plans import benchmark
    from factlens.sources import testdata

    d, tracker, jobs = "/root/testdata/sf0.001", spark.sparkContext.statusTracker(), []
    facts, history = testdata.facts_orders(spark, d), testdata.lineages_lineitem(spark, d)
    for k, seeds in enumerate(((0,), range(10))):
        spark.sparkContext.setJobGroup(f"grid-{k}", "a grid")
        dispatch.dispatch(spark, benchmark.expand(spark, seeds=seeds).filter("kind = 'fault'"), facts, history, "1999-01-01")
        jobs.append(len(tracker.getJobIdsForGroup(f"grid-{k}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert abs(jobs[1] - jobs[0]) <= 6  # adaptive plans may split a stage; the cases are ten times as many


def test_first_of_groups_has_its_own_count_for_each_group(spark):
    from factlens.operators import ranks

    rng = __import__("random").Random(3)
    rows = [(g, i, f"{rng.randrange(16**6):06x}" if g != "ties" else "00abc1", w) for g, w, n in (("a", 5, 40), ("b", 1, 3), ("ties", 4, 9), ("all", 99, 6), ("none", 0, 6), ("null", None, 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, h string, w int").repartition(3)
    for digits in (1, 3):
        got = sorted((r.g, r.target_rank, r.i) for r in ranks.first_of_groups(df, ["g"], "h", "i", "w", digits=digits).collect())
        want = [(g, k, i) for g in sorted({r[0] for r in rows}) for k, (_, i, w) in enumerate(sorted((h, i, w) for x, i, h, w in rows if x == g)) if w is not None and k < w]
        assert got == want


def test_first_of_groups_does_not_shuffle_rows_to_find_needed_buckets(spark):
    from factlens.operators import ranks

    df = spark.createDataFrame([("a", 1, "00abc1", 1)], "g string, i int, h string, w int")
    plan = ranks.first_of_groups(df, ["g"], "h", "i", "w")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_total_rank_and_sorted_sink(spark, tmp_path):
    from factlens.operators import ranks

    rng = __import__("random").Random(5)
    rows = [(rng.choice([None, *range(20)]), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c double").repartition(5)
    got = ranks.total_rank(df, ["-a", "b"], "place", partitions=7)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r)[:3] for r in got.orderBy("place").collect()] == want and [r.place for r in got.select("place").orderBy("place").collect()] == list(range(3000))
    assert ranks.total_rank(df.limit(0), ["a"]).count() == 0
    ranks.write_sorted(df, f"file://{tmp_path}/sorted", ["-a", "b"], partitions=6)
    files = sorted(p for p in (tmp_path / "sorted").iterdir() if p.suffix == ".parquet")
    assert len(files) > 3
    import pyarrow.parquet as pq

    assert [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()] == want


def test_revisions_are_shuffled_once_and_without_unused_columns(spark, monkeypatch):
    """Line items meet their orders where the window has put them; targets of overwrites are stored with their own columns alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = testdata.lineages_lineitem(spark, "/root/testdata/sf0.001")
        plan = history._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    asked, of = [], inject.select_targets
    monkeypatch.setattr(inject, "select_targets", lambda rows, *a: asked.append(rows.columns) or of(rows, *a))
    inject.inject_revision_overwrite(pit.snapshot(history, "1999-01-01").drop("lineage_id", "seq"), history, "1999-01-01", "medium", 3)
    assert asked == [["record_id", *inject.LATER, "later"]]


def test_figures_of_a_grid_shuffle_no_rows(spark, monkeypatch):
    """Figures and the comparison of repaired rows are sums a case; a repair that puts nothing back is seen."""
    from pyspark.sql.readwriter import DataFrameWriter

    from factlens.operators import dispatch

    d, plans, write = "/root/testdata/sf0.001", {}, DataFrameWriter.parquet

    def parquet(self, path, *more, **options):
        plans[path.rsplit("/", 1)[1]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(dispatch, "repair", lambda corrupted, originals, columns: corrupted.select("case_id", *columns))
    cases = benchmark.expand(spark, seeds=(0,)).filter("kind = 'fault' AND severity = 'high'")
    got = dispatch.dispatch(spark, cases, testdata.facts_orders(spark, d), testdata.lineages_lineitem(spark, d), "1999-01-01").results.collect()
    assert len(got) == 4 and not any(r.restored for r in got if r.faults)
    assert "Aggregate [case_id" in plans["results"] and not re.search(r"Aggregate \[case_id#\d+, record_id", plans["results"])
