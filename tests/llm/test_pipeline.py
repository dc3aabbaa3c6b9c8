"""Each stage of the pipeline against brute force on the smallest documents."""

from __future__ import annotations

import corpus_pipeline as P
from factlens.llm import common as C
from factlens.llm import packing

from .test_operators import SF, brute_jaccard, brute_substrings, texts_of, words


def test_stages(spark, tmp_path):
    docs = C.table(spark, SF, "documents")
    columns = docs.columns
    got = {}
    for name, stage in P.STAGES:
        before = texts_of(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = (before, texts_of(docs) if "text" in docs.columns else docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = got["near_copies"]
    assert {i for i, _ in after} == {i for i, _, c in brute_jaccard(before, 5, 80) if i == c}
    before, after = got["substrings"]
    want = {k[0]: (k[1] if v[2] == 0 else v[0]) for k, v in brute_substrings(before, 20).items() if v[2] == 0 or v[2] < v[1]}
    assert dict(after) == want
    before, after = got["benchmark"]
    items = [" ".join(words(r.text)) for r in C.table(spark, SF, "benchmark").collect()]
    assert {i for i, t in before} - {i for i, _ in after} >= {i for i, t in before if any(b in " ".join(words(t)) for b in items)}
    assert len(after) > 0.9 * len(before)
    before, rows = got["packing"]
    assert {r.doc_id for r in rows} == {i for i, _ in before} and all(r.length <= packing.CAPACITY for r in rows)


def test_empty_and_null_rows(spark, edge, tmp_path):
    docs = edge.selectExpr("doc_id", "text", "lang", "CAST(NULL AS string) AS source", "CAST(length(text) AS long) AS n_chars", "'mine' AS score", "1 AS n_words", "'k' AS `_key`", "true AS contaminated", "'row' AS `row`")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name)) if name != "packing" else docs
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {1, 2, 3, 9} <= {r.doc_id for r in docs.collect()}
    assert {(r.score, r.n_words, r._key, r.contaminated, r.row) for r in docs.collect()} == {("mine", 1, "k", True, "row")}


def test_copies_without_an_id(spark):
    """A copy without an id goes beside one with an id, whatever other documents without an id are kept."""
    text = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, text), (None, text + " extra"), (None, other), (None, third), (None, third + " more"), (None, third), (2, None), (None, None), (None, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in P.one_of_near_copies(spark, docs, SF).collect()), key=str)
    assert len([k for k in kept if k[1] and k[1].startswith("u0")]) == 1
    assert [k for k in kept if not (k[1] or "").startswith("u0")] == sorted([(1, text), (None, other), (2, None), (None, None), (None, "")], key=str)


def test_run_leaves_one_table(spark, monkeypatch, tmp_path):
    """Each stage's table goes when the next one is written."""
    monkeypatch.setattr(C, "scratch_root", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(P, "STAGES", [(n, lambda spark, docs, sf_dir: docs) for n in "abc"])
    assert P.run(spark, SF).count() == C.table(spark, SF, "documents").count()
    (base,) = tmp_path.iterdir()
    assert [d.name for d in base.iterdir()] == ["b"]
