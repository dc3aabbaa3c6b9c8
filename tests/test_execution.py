"""Partitioned audits with reuse, manifest revalidation, frozen vintages, missing-observation scores."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factlens.operators import detect, execution, impact, inject, manifest, pit, score
from factlens.sources import generate, testdata

SF, AS_OF = "/root/testdata/sf0.001", "1999-01-01"


@pytest.fixture(scope="module")
def facts(spark):
    return testdata.facts_orders(spark, SF).cache()


def by_status(status):
    return {r.partition: r.status for r in status.collect()}


def test_partitioned_equals_whole_and_reuses(spark, facts, tmp_path):
    audit, root = pit.sanitize(facts), f"file://{tmp_path}"
    status, found = execution.run_partitioned(spark, audit, AS_OF, root, 5)
    whole = sorted(detect.run_detectors(audit, AS_OF).collect())
    assert sorted(found.collect()) == whole and set(by_status(status).values()) == {"audited"}
    status, found = execution.run_partitioned(spark, audit.orderBy("value"), AS_OF, root, 5)
    assert sorted(found.collect()) == whole and set(by_status(status).values()) == {"reused"}
    assert sum(r.findings for r in status.collect()) == len(whole)
    status, _ = execution.run_partitioned(spark, audit, "1998-01-01", root, 5)
    assert set(by_status(status).values()) == {"audited"}


def test_damaged_findings_and_lost_ledger_are_audited_again(spark, facts, tmp_path):
    audit, root = pit.sanitize(facts), f"file://{tmp_path}"
    execution.run_partitioned(spark, audit, AS_OF, root, 5)
    keys = sorted(Path(tmp_path, "findings").glob("key=*"))
    shutil.rmtree(keys[0])
    status, found = execution.run_partitioned(spark, audit, AS_OF, root, 5)
    assert sorted(by_status(status).values()) == ["audited"] + ["reused"] * 4
    mended = sorted(found.collect())
    shutil.rmtree(Path(tmp_path, "ledger"))  # as if the run was cut before it
    status, again = execution.run_partitioned(spark, audit, AS_OF, root, 5)
    assert set(by_status(status).values()) == {"audited"}
    assert mended == sorted(again.collect()) == sorted(detect.run_detectors(audit, AS_OF).collect())


def test_unchanged_files_are_not_read(spark, facts, tmp_path):
    """The second run takes its plan from the files' names, sizes and times; another file, date or version is planned anew."""
    facts.write.parquet(f"file://{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.read.schema(facts.schema).parquet(f"file://{tmp_path}/in")
    audit = pit.sanitize(raw.mapInArrow(count, raw.schema))
    run = lambda as_of=AS_OF, version="": execution.run_partitioned(spark, audit, as_of, f"file://{tmp_path}/out", 4, inputs=[f"file://{tmp_path}/in"], version=version)
    status, found = run()
    first, n = sorted(found.collect()), seen.value
    assert n > 0 and set(by_status(status).values()) == {"audited"}
    status, found = run()
    assert seen.value == n and set(by_status(status).values()) == {"reused"} and sorted(found.collect()) == first
    run(version="2")
    assert seen.value > n
    n = seen.value
    facts.limit(1).withColumn("record_id", F.lit("rec_new")).write.mode("append").parquet(f"file://{tmp_path}/in")
    status, _ = execution.run_partitioned(spark, pit.sanitize(spark.read.schema(facts.schema).parquet(f"file://{tmp_path}/in")), AS_OF, f"file://{tmp_path}/out", 4, inputs=[f"file://{tmp_path}/in"])
    assert sorted(by_status(status).values()) == ["audited"] + ["reused"] * 3


def test_partitioned_edges(spark, facts, tmp_path):
    audit = pit.sanitize(facts)
    status, found = execution.run_partitioned(spark, audit.limit(0), AS_OF, f"file://{tmp_path}/a", 5)
    assert not status.count() and not found.count()
    clean = audit.filter("available_on > '2100-01-01' OR record_id = ''").unionByName(audit.filter("available_on = filed_on").limit(1))
    for expected in ("audited", "reused"):
        status, found = execution.run_partitioned(spark, clean, AS_OF, f"file://{tmp_path}/b", 5)
        assert set(by_status(status).values()) == {expected} and not found.count()
    # A null in another column is another content; a copy of a row too.
    key = lambda df: {r.key for r in execution.plan(df, AS_OF, 1, ("duplicate",)).collect()}
    two = spark.createDataFrame([("e", None, "x")], "entity_id string, a string, b string")
    assert len(key(two) | key(two.selectExpr("entity_id", "b AS a", "a AS b")) | key(two.unionByName(two)) | key(two.select("b", "a", "entity_id"))) == 3


def test_manifest(spark, facts):
    _, m = inject.inject_unit_drift(facts, AS_OF, "low", 1)
    assert not manifest.revalidate(m, m).count() and manifest.require_valid(m, m) is m
    assert {r.problem for r in manifest.revalidate(m.unionByName(m.filter("target_rank = 0")), m).collect()} == {"repeated"}
    assert {r.problem for r in manifest.revalidate(m.withColumn("factor", m.factor + 1), m).collect()} == {"changed:factor"}
    _, other = inject.inject_unit_drift(facts, AS_OF, "low", 2)
    assert {"not_selected", "left_out"} <= {r.problem for r in manifest.revalidate(other, m).collect()}
    with pytest.raises(manifest.ManifestConflict):
        manifest.require_valid(other, m)
    with pytest.raises(manifest.ManifestConflict):
        manifest.revalidate(m.drop("factor"), m)


def test_frozen_vintage(spark):
    history = generate.performance_corpus(spark, entities=3, periods=3)
    c = impact.GrowthContext("performance", "Revenue", "USD", "instant", (None, "2000-03-31"), (None, "2000-06-30"))
    old = pit.snapshot(history, "2000-06-01")
    got = impact.frozen_vintage(old, "2000-06-01", history, "2001-01-01", c)
    assert sorted(str(r.period_end) for r in got.collect()) == ["2000-03-31"] * 3 + ["2000-06-30"] * 3
    with pytest.raises(impact.VintageConflict):
        impact.frozen_vintage(pit.snapshot(history, "2001-01-01"), "2000-06-01", history, "2001-01-01", c)
    with pytest.raises(impact.VintageConflict):
        impact.frozen_vintage(old, "2001-01-01", history, "2001-01-01", c)
    changed = old.withColumn("value", old.value + (old.entity_id == "E1").cast("int"))
    assert [r.entity_id for r in old.join(impact.inconsistent(changed.select(old.columns), old), "record_id").collect()] == ["E1"]


def test_missing_scores(spark, facts):
    single = facts.dropDuplicates(["entity_id", "period_end"])
    rows = score.missing_evaluation(single, AS_OF, ("random", "survivorship"), "low", 1, 10_000).collect()
    assert len(rows) == 2 and all(r.precision == r.recall == 1.0 and r.targets == r.true_positives > 0 for r in rows)
