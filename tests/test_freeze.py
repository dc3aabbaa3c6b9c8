"""Frozen corpora, classes of cases in their order, evidence that survives new ids."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factlens.operators import detect, freeze, pit, review

from .test_engine import D, fact, facts


def corpus(spark, *rows):
    return spark.createDataFrame(list(rows), "unit string, a string, b int")


ROWS = [("u1", "x", 1), ("u1", "y", None), ("u2", "x", 1), (None, "z", 3)]


def states(df):
    return {r.unit: r.state for r in df.collect()}


def test_units_are_sealed_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(freeze.Sealed, match="not sealed"):
        freeze.freeze_status(spark, root, "c", corpus(spark, *ROWS), "unit")
    assert freeze.freeze(spark, root, "c", corpus(spark, *ROWS), "unit").count() == 3
    assert freeze.freeze(spark, root, "c", corpus(spark, *ROWS[::-1]).repartition(3), "unit").count() == 3
    status = lambda *rows: states(freeze.freeze_status(spark, root, "c", corpus(spark, *rows), "unit"))
    assert set(status(*ROWS).values()) == {"sealed"}
    assert status(*ROWS, ROWS[0]) == {"u1": "changed", "u2": "sealed", None: "sealed"}  # a copy is a change
    assert status(("u1", "x", 1), ("u1", None, None), ("u2", "x", 1), ("u3", "x", 1)) == {"u1": "changed", "u2": "sealed", "u3": "unexpected", None: "missing"}
    with pytest.raises(freeze.Sealed, match="unit u2 is missing"):
        freeze.freeze(spark, root, "c", corpus(spark, *ROWS[:2], ROWS[3]), "unit")
    Path(tmp_path, "frozen", "c", "_SUCCESS").unlink()  # as if the write was cut: it is done again
    shutil.rmtree(Path(tmp_path, "frozen", "c"))
    assert freeze.freeze(spark, root, "c", corpus(spark, *ROWS[:2]), "unit").count() == 1
    for bad in ("", "../x", "A", "a/b"):
        with pytest.raises(freeze.Sealed, match="not a name"):
            freeze.freeze(spark, root, bad, corpus(spark, *ROWS), "unit")


def grid(spark):
    return spark.createDataFrame([(f"{c[0]}{i}", c) for c in ("development", "validation", "reserved") for i in range(3)], "case_id string, seed_class string")


def outcome(cases, status="ok"):
    return cases.select("case_id", "seed_class", F.lit(status).alias("status"), F.lit(1).alias("findings"))


def test_validation_waits_for_development(spark, tmp_path):
    root, cases, ran = f"file://{tmp_path}", grid(spark), []

    def run(c):
        ran.append(c.count())
        return outcome(c)

    with pytest.raises(freeze.Sealed, match="wait for the results of development"):
        freeze.run_class(spark, root, "validation", cases, run)
    assert not ran  # nothing was run
    freeze.run_class(spark, root, "development", cases, run)
    with pytest.raises(PermissionError):
        freeze.run_class(spark, root, "reserved", cases, run)
    with pytest.raises(freeze.Sealed, match="wait for the results of validation"):
        freeze.run_class(spark, root, "reserved", cases, run, authorized=True)
    freeze.run_class(spark, root, "validation", cases, run)
    assert freeze.run_class(spark, root, "reserved", cases, run, authorized=True).count() == 3
    with pytest.raises(freeze.Sealed, match="other results"):
        freeze.run_class(spark, root, "development", cases, lambda c: outcome(c).withColumn("findings", F.lit(2)))
    assert freeze.run_class(spark, root, "development", cases, run).count() == 3


@pytest.mark.parametrize("spoil", [lambda r: r.filter("case_id != 'd1'"), lambda r: r.unionByName(r), lambda r: outcome(r, "failed"), lambda r: r.withColumn("case_id", F.concat(F.lit("x"), "case_id"))])
def test_a_class_is_sealed_whole(spark, tmp_path, spoil):
    cases = grid(spark)
    with pytest.raises(freeze.Sealed):
        freeze.run_class(spark, f"file://{tmp_path}", "development", cases, lambda c: spoil(outcome(c)))
    with pytest.raises(freeze.Sealed):
        freeze.require_open(spark, f"file://{tmp_path}", "validation", cases)


def test_evidence_survives_new_ids(spark):
    rows = [fact(1, accession_number="a"), fact(2, accession_number="a"), fact(3, available_on=D("2020-03-31")), fact(4, entity_id="E2", available_on=D("2020-03-31"))]
    audit = pit.sanitize(facts(spark, *rows))
    again = audit.withColumn("record_id", F.concat(F.lit("n"), F.reverse("record_id"))).repartition(3)
    restated = again.withColumn("value", F.when(F.col("entity_id") == "E2", 7).otherwise(F.col("value")).cast("decimal(28,6)"))
    found = lambda a: review.evidence(detect.run_detectors(a, "2030-01-01", ("lookahead", "duplicate")), a)
    counts = lambda a, b: {r.detector: (r.kept, r.added, r.removed) for r in review.evidence_counts(review.evidence_diff(a, b)).collect()}
    before = found(audit)
    assert counts(before, found(again)) == {"lookahead": (2, 0, 0), "duplicate": (1, 0, 0)}
    assert counts(before, found(restated)) == {"lookahead": (1, 1, 1), "duplicate": (1, 0, 0)}
    assert counts(before, review.evidence(before.drop("evidence_hash"), audit.limit(0))) == {"lookahead": (0, 2, 2), "duplicate": (0, 1, 1)}
    judged = before.select("finding_id", F.lit("confirmed").alias("disposition"), F.lit(5).cast("long").alias("review_seconds"))
    got = review.carried_adjudications(before, judged, found(restated))
    assert sorted((r.disposition, r.state) for r in got.collect()) == [("confirmed", "carried")] * 2


def test_copies_of_one_evidence_are_counted(spark):
    """Two findings of equal content: as many as both sides have are the same, and opposed judgements conflict."""
    rows = [fact(i, available_on=D("2020-03-31"), accession_number="a", source_row_key="k") for i in (1, 2)]
    audit = pit.sanitize(facts(spark, *rows))
    both = review.evidence(detect.run_detectors(audit, "2030-01-01", ("lookahead",)), audit)
    one = both.orderBy("finding_id").limit(1)
    assert [(r.kept, r.added, r.removed) for r in review.evidence_counts(review.evidence_diff(both, one)).collect()] == [(1, 0, 1)]
    first = one.first().finding_id
    judged = both.select("finding_id", F.when(F.col("finding_id") == first, "confirmed").otherwise("rejected").alias("disposition"), F.lit(5).cast("long").alias("review_seconds"))
    assert {(r.disposition, r.state) for r in review.carried_adjudications(both, judged, both).collect()} == {(None, "conflicting")}
