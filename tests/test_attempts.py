"""Partitions that fail alone, retries, finalization; manifests against facts."""

from __future__ import annotations

import hashlib
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows
from factlens.operators import attempts, detect, inject, manifest, pit, series
from factlens.plans import queries_audit
from factlens.schema import is_token
from factlens.sources import mapping, testdata

from .test_engine import fact, facts
from .test_policy import COLUMNS, CONSTANTS, HEADER

M = mapping.Mapping(COLUMNS | {"lineage": "lin", "sequence": "seq"}, CONSTANTS, available_when_filed=True)
AS_OF = "2021-01-01"


def raw(spark, *rows):
    names = [*HEADER, "lin", "seq", "partition"]
    full = [tuple(r) + (None, None) * (len(r) == 6) for r in rows]
    return spark.createDataFrame([(*r[:5], *(r[6:8] if len(r) == 8 else (None, None)), r[5]) for r in full], ", ".join(f"{n} string" for n in names))


ROWS = [(f"{p}{e}", str(100 + e), f"2020-0{1 + k}-01", f"2021-0{1 + k}-20" if e == 1 else f"2020-0{1 + k}-20", f"{p}{e}k{k}", p) for p in "abc" for e in range(3) for k in range(3)]
BROKEN = [(*r[:1], "x", *r[2:]) if r[4] == "b0k1" else r for r in ROWS]


def states(df):
    return {r.partition: (r.attempt, r.status, r.failure) for r in df.collect()}


def test_a_failing_partition_leaves_the_others_and_is_retried_alone(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert states(attempts.run_attempt(spark, raw(spark, *BROKEN), M, AS_OF, root)) == {"a": (1, "succeeded", None), "b": (1, "failed", "invalid_rows"), "c": (1, "succeeded", None)}
    with pytest.raises(attempts.NotFinal, match="b first"):
        attempts.finalize(spark, raw(spark, *BROKEN), M, AS_OF, root)
    assert states(attempts.run_attempt(spark, raw(spark, *BROKEN), M, AS_OF, root))["b"] == (2, "failed", "invalid_rows")
    assert states(attempts.run_attempt(spark, raw(spark, *ROWS), M, AS_OF, root)) == {"a": (1, "reused", None), "b": (3, "succeeded", None), "c": (1, "reused", None)}
    assert not list(Path(tmp_path).glob("final-*"))
    final = attempts.finalize(spark, raw(spark, *ROWS), M, AS_OF, root)
    whole = mapping.load(raw(spark, *ROWS).drop("partition"), M)
    want = sorted(r.finding_id for r in detect.run_detectors(pit.sanitize(pit.snapshot(whole, AS_OF)), AS_OF).collect())
    assert sorted(r.finding_id for r in final.collect()) == want
    # The same run is the same file, whatever order its rows are read in.
    attempts.finalize(spark, raw(spark, *ROWS[::-1]), M, AS_OF, root)
    assert len(list(Path(tmp_path).glob("final-*.json"))) == 1


def test_counts_and_histories_fail_too(spark, tmp_path):
    bad = [("x", "1", "2020-01-01", "2020-03-01", "r1", "d", "L", "1"), ("x", "2", "2020-01-01", "2020-02-01", "r2", "d", "L", "2")]
    expected = spark.createDataFrame([("a", 9), ("b", 10)], "partition string, records long")
    got = states(attempts.run_attempt(spark, raw(spark, *ROWS, *bad), M, AS_OF, f"file://{tmp_path}", expected))
    assert got == {"a": (1, "succeeded", None), "b": (1, "failed", "record_count"), "c": (1, "succeeded", None), "d": (1, "failed", "ambiguous_history")}


def test_one_source_row_in_two_partitions_is_two(spark, tmp_path):
    twin = [(*r[:5], "z") for r in ROWS if r[5] == "a"]
    root, rows = f"file://{tmp_path}", raw(spark, *ROWS, *twin)
    assert {s for _, s, _ in states(attempts.run_attempt(spark, rows, M, AS_OF, root)).values()} == {"succeeded"}
    with pytest.raises(attempts.NotFinal, match="is in 2 partitions"):
        attempts.finalize(spark, rows, M, AS_OF, root)


def test_findings_that_were_changed_raise_and_stay(spark, tmp_path):
    leaky = [(*r[:3], "2021-06-01", *r[4:]) if r[4] == "a0k0" else r for r in ROWS]
    m = mapping.Mapping(COLUMNS | {"lineage": "lin", "sequence": "seq", "available_on": "end"}, CONSTANTS)
    root = f"file://{tmp_path}"
    attempts.run_attempt(spark, raw(spark, *leaky), m, AS_OF, root)
    folders = sorted(Path(tmp_path, "findings").glob("key=*"))
    assert folders
    shutil.rmtree(folders[0])
    for call in (attempts.run_attempt, attempts.finalize):
        with pytest.raises(attempts.PriorSuccessInvalid):
            call(spark, raw(spark, *leaky), m, AS_OF, root)
    assert not folders[0].exists()


def test_attempt_edges(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert attempts.run_attempt(spark, raw(spark, *ROWS).limit(0), M, AS_OF, root).count() == 0
    assert attempts.finalize(spark, raw(spark, *ROWS).limit(0), M, AS_OF, root).count() == 0
    key = lambda *rows: {r.key for r in attempts.content_keys(raw(spark, *rows), M, AS_OF, ("duplicate",)).collect()}
    assert key(*ROWS) == key(*ROWS[::-1]) and not key(*ROWS) & key(*ROWS, *ROWS)


@pytest.mark.parametrize("family", ["lookahead", "unit_drift", "duplicate", "revision_overwrite", "missing"])
def test_stored_manifests_against_facts(spark, tmp_path, family):
    d, as_of = "/root/testdata/sf0.001", "1999-01-01"
    more = {"history": testdata.lineages_lineitem(spark, d)} if family == "revision_overwrite" else {"mechanism": "source_outage"} if family == "missing" else {}
    rows = testdata.facts_orders(spark, d)
    m = manifest.derive(family, rows, as_of, "low", 1, **more)
    m.write.parquet(f"file://{tmp_path}/m")
    stored = spark.read.schema(m.schema).parquet(f"file://{tmp_path}/m")
    key = "record_id" if family == "missing" else "original_record_id"
    check = lambda s, seed=1, level="low": manifest.revalidate_from_facts(s, family, rows, as_of, level, seed, key, 4, **more)
    assert check(stored).count() == 0 and manifest.root_digest(stored) == manifest.root_digest(m)
    one = stored.orderBy(key).first()[key]
    assert [tuple(r) for r in check(stored.filter(F.col(key) != one)).collect()] == [(one, "left_out")]
    changed = stored.withColumn("value", F.when(F.col(key) == one, 0).otherwise(F.col("value")).cast("decimal(28,6)")) if family == "missing" else stored.withColumn("injected_record_id", F.when(F.col(key) == one, "rec_0").otherwise(F.col("injected_record_id")))
    assert [(r[0], r.problem) for r in check(changed).collect()] == [(one, "changed:value" if family == "missing" else "changed:injected_record_id")]
    assert manifest.root_digest(changed) != manifest.root_digest(m)
    if family != "missing":
        assert check(stored, seed=2).count() > 0


def test_only_leaves_that_differ_are_compared(spark, monkeypatch):
    rows = testdata.facts_orders(spark, "/root/testdata/sf0.001")
    m, seen = manifest.derive("unit_drift", rows, "1999-01-01", "high", 1), []
    whole = manifest.revalidate
    monkeypatch.setattr(manifest, "revalidate", lambda a, b, key: seen.append((a.count(), b.count())) or whole(a, b, key))
    changed = m.withColumn("factor", F.when(F.col("target_rank") == 9, 7).otherwise(F.col("factor")).cast("long"))
    assert manifest.revalidate_from_facts(changed, "unit_drift", rows, "1999-01-01", "high", 1, leaf=8).count() == 1
    assert seen == [(8, 8)]


def test_nothing_is_injected_into_unclean_facts(spark):
    manifest.require_clean(facts(spark, fact(1), fact(2)))
    for bad in ([fact(1), fact(1)], [fact(1, unit=" x")], [fact(1, source_row_key="a#r1"), fact(2, source_row_key="a#r1")]):
        with pytest.raises((manifest.UnfitFacts, pit.AmbiguousHistory)):
            manifest.require_clean(facts(spark, *bad))
    assert inject.FRACTIONS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["audit_attempt_isolated", "audit_attempt_retried", "audit_final"])
def test_a_delivery_is_derived_once_and_then_read(spark, monkeypatch, name):
    given = []
    for step in ("run_attempt", "finalize"):
        real = getattr(attempts, step)
        monkeypatch.setattr(attempts, step, lambda *a, real=real, **k: (given.append(a[1]), real(*a, **k))[1])
    getattr(queries_audit, name)(spark, "/root/testdata/sf0.001").collect()
    assert given and not any("Exchange" in plan(raw) for raw in given)


def test_series_are_sorted_once_and_rows_without_a_copy_are_not_listed(spark):
    rows = facts(spark, *[fact(i, record_id=f"r{i}", entity_id=f"e{i // 3}", accession_number=f"a{i // 3}") for i in range(7)])
    assert plan(detect.unit_drift(rows, "2022-01-01")).count("Sort [") == 1
    found = detect.exact_duplicates(rows, "2022-01-01")
    steps = plan(found)
    assert "Window" in steps and steps.count("Exchange hashpartitioning") == 1
    assert sorted((r.affected, r.members) for r in found.collect()) == [("r0|r1|r2", 3), ("r3|r4|r5", 3)]
    assert sorted(r.members for r in series.duplicate_groups(rows, "2022-01-01").collect()) == [1, 3, 3]


def test_digests_dates_and_tokens_are_what_they_were(spark):
    h = [c * 64 for c in "0f"] + ["0123456789abcdef" * 4] * 3
    sums = "|".join(["5", *[str(sum(int(x[16 * i : 16 * i + 16], 16) for x in h)) for i in range(4)]])
    assert spark.createDataFrame([(x,) for x in h], "h string").agg(digest_of_rows(F.col("h")).alias("d")).first().d == hashlib.sha256(sums.encode()).hexdigest()
    days = ["2020-02-29", "2021-02-29", "2020-01-01\n", " 2020-01-01", "0001-01-01", "2020-1-1", "9999-12-31", "2020-01-01T00:00", "2020-00-10"]
    got = mapping.marked_rows(raw(spark, *[("e", "1", "2020-01-01", d, f"k{i}", "a") for i, d in enumerate(days)]), M, ("partition",)).select("source_row_key", F.col("filed_on").cast("string").alias("d")).collect()
    assert {r.source_row_key: r.d for r in got if r.d} == {"k0": "2020-02-29", "k4": "0001-01-01", "k6": "9999-12-31"}
    tokens = ["a", "a b", " a", "a\n", "a\u00a0", "\u00a0a", "\u00e9", "a\tb", "", "x" * 512, "x" * 513, "\u00e9" * 513, "a\x7f", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").filter(is_token(F.col("t"))).collect()
    assert sorted(r.i for r in got) == [0, 1, 6, 9]
