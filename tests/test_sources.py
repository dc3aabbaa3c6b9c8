"""Sources: Arrow by record batches, footers of Parquet files, diagnostics by place."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factlens.sources import arrow_source, mapping

COLUMNS = {"entity_id": "entity", "value": "amount", "period_end": "end", "filed_on": "filed", "source_row_key": "row", "lineage": "lin", "sequence": "seq"}
CONSTANTS = {"concept_namespace": "n", "concept": "c", "unit": "USD", "period_type": "instant", "source_name": "s", "source_locator": "l"}
M = mapping.Mapping(COLUMNS, CONSTANTS)


def arrow_file(path, batches, rows=100, names=("a", "b")):
    schema = pa.schema([(names[0], pa.int64()), (names[1], pa.string())])
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, schema) as w:
        for i in range(batches):
            w.write_batch(pa.record_batch([pa.array(range(i * rows, (i + 1) * rows), pa.int64()), pa.array([f"v{j % 7}" if j % 5 else None for j in range(rows)])], schema=schema))


def test_one_arrow_file_is_read_by_several_tasks(spark, tmp_path):
    arrow_file(tmp_path / "x.arrow", 40)
    size = (tmp_path / "x.arrow").stat().st_size
    df = mapping.read_arrow(spark, str(tmp_path / "x.arrow"), task_bytes=size // 8)
    assert 7 <= df.rdd.getNumPartitions() <= 10
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.a for r in got) == list(range(4000)) and len({r.task for r in got}) >= 7
    assert sum(r.b is None for r in got) == 40 * 20
    assert mapping.read_arrow(spark, f"file://{tmp_path}/x.arrow").count() == 4000


def test_the_driver_reads_footers_only(tmp_path, monkeypatch):
    arrow_file(tmp_path / "x.arrow", 30)
    read = []
    whole = pa.ipc.RecordBatchFileReader.get_batch
    monkeypatch.setattr(arrow_source, "pa", pa)
    monkeypatch.setattr(pa.ipc.RecordBatchFileReader, "get_batch", lambda self, i: read.append(i) or whole(self, i), raising=False)
    source = arrow_source.ArrowSource({"path": str(tmp_path / "x.arrow"), "task_bytes": "1000"})
    schema = source.schema()
    parts = source.reader(schema).partitions()
    assert schema.names == ["a", "b"] and [(p.first, p.last) for p in parts][0][0] == 0 and parts[-1].last == 30 and not read


def test_arrow_folders_and_edges(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        arrow_file(tmp_path / "d" / f"{k}.arrow", k)  # the first has no batch
    assert mapping.read_arrow(spark, str(tmp_path / "d")).count() == 300
    arrow_file(tmp_path / "e.arrow", 0)
    assert mapping.read_arrow(spark, str(tmp_path / "e.arrow")).collect() == []
    arrow_file(tmp_path / "d" / "3.arrow", 1, names=("a", "c"))
    with pytest.raises(Exception, match="has columns"):
        mapping.read_arrow(spark, str(tmp_path / "d")).count()
    with pytest.raises(Exception, match="none"):
        mapping.read_arrow(spark, str(tmp_path / "none")).count()


def test_arrow_streams_and_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    t = pa.table({"a": ["x", "y"], "b": pa.array([1, None], pa.int64())})
    with pa.OSFile(str(tmp_path / "s.arrows"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, mapping.read_arrow(spark, str(tmp_path / "s.arrows"), stream=True).collect())) == [("x", 1), ("y", None)]
    arrow_file(tmp_path / "x.arrow", 3)
    monkeypatch.setattr(arrow_source, "reachable", lambda path: False)
    assert mapping.read_arrow(spark, str(tmp_path / "x.arrow")).count() == 300


def test_footers_name_the_bad_file(spark, tmp_path):
    for k in range(6):
        pq.write_table(pa.table({"k": pa.array([k], pa.int64()), "value": pa.array(["1"])}), tmp_path / f"{k}.parquet")
    folder = f"file://{tmp_path}"
    assert mapping.read_parquet(spark, folder, ["k", "value"]).count() == 6
    problems = lambda: sorted((r.file.rsplit("/", 1)[1], r.column, r.problem) for r in mapping.footer_problems(mapping.parquet_footers(spark, folder), ["k", "value"]).collect())
    assert problems() == []
    pq.write_table(pa.table({"k": pa.array([1], pa.int32()), "value": pa.array(["1"])}), tmp_path / "3.parquet")
    pq.write_table(pa.table({"k": pa.array([1], pa.int64()), "value": pa.array([1.5])}), tmp_path / "4.parquet")
    pq.write_table(pa.table({"value": pa.array(["1"])}), tmp_path / "5.parquet")
    (tmp_path / "6.parquet").write_bytes(b"PAR1 this is none")
    assert [p for p in problems() if p[2] != "unreadable"] == [("3.parquet", "k", "differs"), ("4.parquet", "value", "floating"), ("5.parquet", "k", "missing")]
    assert [p[0] for p in problems() if p[2] == "unreadable"] == ["6.parquet"]
    with pytest.raises(mapping.InvalidDataset, match="3.parquet: k differs"):
        mapping.read_parquet(spark, folder, ["k", "value"])


HEADER = ["entity", "amount", "end", "filed", "row", "lin", "seq"]


def csv(tmp_path, rows, name="x.csv"):
    (tmp_path / name).write_text("\n".join([",".join(HEADER), *rows]) + "\n")
    return f"file://{tmp_path}/{name}"


def test_profile_counts_rows_and_numbers_them(spark, tmp_path):
    rows = [f"E{i},{'x' if i % 10 == 3 else i},2020-03-31,2020-04-30,r{min(i, 95)},," for i in range(100)]
    out = mapping.profiled(mapping.read_csv(spark, csv(tmp_path, rows), HEADER), M, most=5)
    p = out.profile.first()
    assert (p.row_count, p.valid_record_count, p.error_count, p.warning_count, p.omitted_diagnostic_count, p.valid) == (100, 86, 14, 0, 9, False)
    got = [(r.position, r.row_number, r.code, r.field, r.stage) for r in out.diagnostics.orderBy("position").collect()]
    assert got == [(k, 10 * k + 4, "normalization.invalid_decimal", "value", "normalization") for k in range(5)]
    last = [(r.row_number, r.code) for r in mapping.profiled(mapping.read_csv(spark, csv(tmp_path, rows), HEADER), M, most=50).diagnostics.orderBy("position").collect()][-4:]
    # Row 96 is the first of its coordinate; the copies after it are errors.
    assert last == [(n, "normalization.duplicate_source_identity") for n in (97, 98, 99, 100)]
    assert out.facts.count() == 86


def test_profile_numbers_rows_file_by_file(spark, tmp_path):
    for k in range(3):
        csv(tmp_path, [f"E{i},{'x' if i in (1, 4) else i},2020-03-31,2020-04-30,f{k}r{i},," for i in range(6)], f"{k}.csv")
    out = mapping.profiled(mapping.read_csv(spark, f"file://{tmp_path}", HEADER), M)
    # read_csv selects from the scan, so the rows' files are not told apart: they count as one input.
    assert out.profile.first().error_count == 6 and out.diagnostics.count() == 6
    raw = spark.read.schema(", ".join(f"{h} string" for h in HEADER)).option("header", True).csv(f"file://{tmp_path}")
    got = sorted((r.file.rsplit("/", 1)[1], r.row_number) for r in mapping.profiled(raw, M).diagnostics.collect())
    assert got == [(f"{k}.csv", n) for k in range(3) for n in (2, 5)]


def test_profile_of_revisions_and_empty_tables(spark, tmp_path):
    good = ["A,1,2020-03-31,2020-04-30,r1,L,1", "A,2,2020-03-31,2020-05-30,r2,L,2"]
    bad = good + ["B,1,2020-03-31,2020-06-30,r3,K,1", "B,2,2020-03-31,2020-05-30,r4,K,2"]
    load = lambda rows: mapping.profiled(mapping.read_csv(spark, csv(tmp_path, rows), HEADER), M)
    assert load(good).profile.first().valid
    out = load(bad)
    assert not out.profile.first().valid and {(r.code, r.stage, r.row_number) for r in out.diagnostics.collect()} == {("revision.ambiguous_history", "revision", None)}
    with pytest.raises(mapping.InvalidDataset):
        mapping.load(mapping.read_csv(spark, csv(tmp_path, bad), HEADER), M)
    empty = load([])
    assert tuple(empty.profile.drop("mapping_id").first()) == (0, 0, 0, 0, 0, True) and empty.facts.count() == 0 and empty.diagnostics.count() == 0


def test_the_input_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = mapping.read_csv(spark, csv(tmp_path, [f"E{i},{i},2020-03-31,2020-04-30,r{i},," for i in range(50)]), HEADER)
    facts = mapping.load(raw.mapInArrow(count, raw.schema), M)
    assert facts.count() == 50 and facts.count() == 50 and seen.value == 50


def test_mapping_ids_follow_what_is_said():
    same = mapping.Mapping(dict(reversed(COLUMNS.items())), dict(CONSTANTS))
    assert M.mapping_id() == same.mapping_id() != mapping.Mapping(COLUMNS, CONSTANTS, reject_unmapped=True).mapping_id()
