"""Partitioned audits: entities dealt to fixed partitions, a ledger of what was audited, reuse of what did not change."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest
from factlens.operators.detect import DETECTORS, run_detectors
from factlens.sources.sinks import exists

FINDING = "finding_id string, detector string, rule_id string, affected string, entity_id string, severity string, confidence string"
LEDGER = "key string, partition int, records long, findings long"
RUN = "identity string, partition int, records long, key string"


def partition_of(partitions: int) -> Column:
    """The partition of an entity: by its SHA-256, so partitions share no entity and need no order of all entities."""
    return F.pmod(F.conv(F.substring(F.sha2("entity_id", 256), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def plan(audit: DataFrame, as_of: date | str, partitions: int, names: tuple[str, ...]) -> DataFrame:
    """(partition, records, key): the key stands for the rows of a partition in any order, the date and the detectors."""
    hashed = audit.select(partition_of(partitions).alias("partition"), row_digest(audit.columns).alias("h"))
    out = hashed.groupBy("partition").agg(F.count("*").alias("records"), digest_of_rows(F.col("h")).alias("rows"))
    return out.select("partition", "records", F.sha2(F.concat_ws("|", F.lit(_config(as_of, partitions, names)), "partition", "rows"), 256).alias("key"))


def _config(as_of: date | str, partitions: int, names: tuple[str, ...]) -> str:
    return "|".join((str(as_of), str(partitions), *sorted(names)))


def file_identity(spark: SparkSession, paths: list[str]) -> str:
    """What the files at and below `paths` are known by without reading them: name, size and time of change of each."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(at).isFile():
            status = fs.getFileStatus(at)
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def _known_plan(spark: SparkSession, root: str, identity: str) -> list:
    if not exists(spark, f"{root}/runs"):
        return []
    return spark.read.schema(RUN).parquet(f"{root}/runs").filter(F.col("identity") == identity).select("partition", "records", "key").distinct().collect()


def _intact(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """(key, findings) of the ledger, for `keys`, whose stored findings are all there."""
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], "key string, findings long")
    ledger = spark.read.schema(LEDGER).parquet(f"{root}/ledger").join(keys, "key", "left_semi").select("key", "findings").distinct()
    stored = _stored(spark, root, keys).groupBy("key").agg(F.count("*").alias("there"))
    return ledger.join(stored, "key", "left").filter("findings = coalesce(there, 0)").select("key", "findings")


def _stored(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    return spark.read.schema(f"{FINDING}, key string").parquet(f"{root}/findings").join(keys, "key", "left_semi")


def run_partitioned(spark: SparkSession, audit: DataFrame, as_of: date | str, root: str, partitions: int = 200, names: tuple[str, ...] = tuple(DETECTORS), inputs: list[str] | None = None, version: str = "") -> tuple[DataFrame, DataFrame]:
    """Audits the partitions whose rows, date or detectors the ledger below `root` does not know: (status, findings) of all.

    status: (partition, records, findings, status), where status is `audited` or `reused`. Findings are stored under the key of
    their partition and replaced as a whole; the ledger is written after them. So a run that was cut, or findings that were
    damaged, are audited again and give no finding twice; read `findings` before another run replaces them. An empty table gives
    empty results. Every detector works within an entity, so findings by partition are the findings of the whole table.

    inputs: the files that `audit` is made from, and nothing else; version: of the way it is made. Where all files have the names, sizes and
    times of an earlier run, its plan holds and they are not read.
    """
    identity = hashlib.sha256("|".join((file_identity(spark, inputs), version, _config(as_of, partitions, names))).encode()).hexdigest() if inputs else None
    # At most `partitions` rows; they steer the run and are the only thing that is broadcast.
    rows = _known_plan(spark, root, identity) if identity else []
    fresh_plan = not rows
    if fresh_plan:
        rows = plan(audit, as_of, partitions, names).collect()
    planned = spark.createDataFrame(rows, "partition int, records long, key string")
    keys = F.broadcast(planned.select("key"))
    known = {r.key: r.findings for r in _intact(spark, root, keys).collect()}
    stale = spark.createDataFrame([r for r in rows if r.key not in known], planned.schema)
    fresh: dict[str, int] = {}
    if len(known) < len(rows):
        own = audit.withColumn("partition", partition_of(partitions)).join(F.broadcast(stale.select("partition")), "partition", "left_semi").drop("partition")
        found = run_detectors(own, as_of, names).withColumn("partition", partition_of(partitions)).join(F.broadcast(stale.select("partition", "key")), "partition").drop("partition")
        # Few files a key, but a partition with most of the findings is split.
        found.hint("rebalance", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{root}/findings")
        fresh = {r.key: r.n for r in _stored(spark, root, F.broadcast(stale.select("key"))).groupBy("key").agg(F.count("*").alias("n")).collect()}
        spark.createDataFrame([(r.key, r.partition, r.records, fresh.get(r.key, 0)) for r in rows if r.key not in known], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    if identity and fresh_plan and rows:
        spark.createDataFrame([(identity, r.partition, r.records, r.key) for r in rows], RUN).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    status = [(r.partition, r.records, known.get(r.key, fresh.get(r.key, 0)), "reused" if r.key in known else "audited") for r in rows]
    findings = _stored(spark, root, keys).drop("key") if rows else spark.createDataFrame([], FINDING)
    return spark.createDataFrame(status, "partition int, records long, findings long, status string"), findings
