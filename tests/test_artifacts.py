"""Sealed trees: a flipped byte, an extra or missing file and a bad path are each named."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from factlens.sources import artifacts, mapping


@pytest.fixture
def tree(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id * 3 AS x").repartition(3).write.parquet(f"file://{tmp_path}/t")
    for p in Path(tmp_path, "t").iterdir():  # Spark's names have capitals only in its own hidden and marker files
        if not p.name.startswith("part-"):
            p.unlink()
    return tmp_path


def found(spark, tree):
    return sorted((r.path if r.problem == "unexpected" else "", r.chunk, r.problem) for r in artifacts.problems(spark, f"file://{tree}/t", f"file://{tree}/m").collect())


def test_a_sealed_tree_is_read_and_differences_are_named(spark, tree):
    root, manifest = f"file://{tree}/t", f"file://{tree}/m"
    digest = artifacts.seal(spark, root, manifest, chunk=4096)
    assert artifacts.read_sealed(spark, root, manifest, digest).count() == 5000 and found(spark, tree) == []
    assert artifacts.read_sealed(spark, root, manifest, digest, ["x"]).columns == ["x"]
    one = sorted(Path(tree, "t").glob("part-*"))[0]
    whole = one.read_bytes()
    assert len(whole) > 3 * 4096
    one.write_bytes(whole[:5000] + bytes([whole[5000] ^ 1]) + whole[5001:])
    assert found(spark, tree) == [("", 1, "changed")]
    with pytest.raises(artifacts.NotIntact, match="chunk 1: changed"):
        artifacts.read_sealed(spark, root, manifest, digest)
    one.write_bytes(whole[:-10])
    assert [p[2] for p in found(spark, tree)] == ["size"]
    one.write_bytes(whole)
    Path(tree, "t", "extra.parquet").write_bytes(b"x")
    assert found(spark, tree) == [("extra.parquet", 0, "unexpected")]
    Path(tree, "t", "extra.parquet").unlink()
    Path(tree, "t", "Bad name.parquet").write_bytes(b"x")
    assert [p[2] for p in found(spark, tree)] == ["path"]
    Path(tree, "t", "Bad name.parquet").unlink()
    one.unlink()
    assert {p[2] for p in found(spark, tree)} == {"missing"}
    with pytest.raises(artifacts.NotIntact, match="manifest"):
        artifacts.read_sealed(spark, root, manifest, "0" * 64)


def test_bad_paths_are_not_sealed(spark, tree):
    Path(tree, "t", "A.parquet").write_bytes(b"x")
    with pytest.raises(artifacts.NotIntact, match="not a path"):
        artifacts.seal(spark, f"file://{tree}/t", f"file://{tree}/m")
    assert not Path(tree, "m").exists()
    for path, ok in (("a/b.parquet", True), ("../a", False), ("a//b", False), (".a", False), ("/a", False), ("a/", False), ("a b", False), ("/".join("a" * 9), False)):
        assert bool(artifacts.GRAMMAR.fullmatch(path)) is ok


def test_chunks_of_files(spark, tmp_path, monkeypatch):
    Path(tmp_path, "a.bin").write_bytes(bytes(range(256)) * 40)
    Path(tmp_path, "empty.bin").write_bytes(b"")
    rows = sorted(map(tuple, artifacts.chunk_hashes(spark, f"file://{tmp_path}", 4096).collect()))
    data = bytes(range(256)) * 40
    want = [("a.bin", i, len(data[i * 4096 : (i + 1) * 4096]), hashlib.sha256(data[i * 4096 : (i + 1) * 4096]).hexdigest()) for i in range(3)]
    assert rows == want  # the empty file has no chunk
    monkeypatch.setattr("factlens.sources.arrow_source.reachable", lambda path: False)  # a store that only Spark reads
    assert sorted(map(tuple, artifacts.chunk_hashes(spark, f"file://{tmp_path}", 4096).collect())) == rows


def test_pinned_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/x.csv"
    Path(tmp_path, "x.csv").write_bytes(b"abc" * 1000)
    digest = hashlib.sha256(b"abc" * 1000).hexdigest()
    assert mapping.pinned(spark, path, digest, 3000) == path
    for sha, size in (("0" * 64, 3000), (digest, 2999)):
        with pytest.raises(mapping.InvalidDataset):
            mapping.pinned(spark, path, sha, size)
    monkeypatch.setattr("factlens.sources.arrow_source.reachable", lambda path: False)
    assert mapping.pinned(spark, path, digest) == path
