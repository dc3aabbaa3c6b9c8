"""Audits of external tables partition by partition: a failing one leaves the others, is retried alone, and nothing is final before all are done."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest
from factlens.operators.detect import DETECTORS, run_detectors
from factlens.operators.pit import lineage_violations, sanitize, snapshot, with_lineage
from factlens.schema import FACT
from factlens.sources import mapping
from factlens.sources.sinks import exists, store_text, work_folder

FINDING = "partition string, finding_id string, detector string, rule_id string, affected string, entity_id string, severity string, confidence string"
ATTEMPT = "key string, partition string, attempt int, status string, failure string, records long, findings long, digest string"


class Judged(NamedTuple):
    partition: str
    key: str
    failure: str | None
    records: int
    findings: int
    digest: str | None


class PriorSuccessInvalid(ValueError):
    """What is stored of a partition that succeeded is not what was stored then."""


class NotFinal(ValueError):
    """A run that cannot be finalized."""


def content_keys(raw: DataFrame, m: mapping.Mapping, as_of: date | str, names: tuple[str, ...]) -> DataFrame:
    """(partition, source_records, key): the key stands for the rows of a partition in any order, the mapping, the date and the detectors."""
    columns = [c for c in raw.columns if c != "partition"]
    sums = raw.select("partition", row_digest(columns).alias("h")).groupBy("partition").agg(F.count("*").alias("source_records"), digest_of_rows(F.col("h")).alias("rows"))
    config = "|".join((m.mapping_id(), str(as_of), *sorted(names)))
    return sums.select("partition", "source_records", F.sha2(F.concat_ws("|", F.lit(config), "partition", "rows"), 256).alias("key"))


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """The ledger: a row for each attempt at a partition's content."""
    return spark.read.schema(ATTEMPT).parquet(f"{root}/ledger") if exists(spark, f"{root}/ledger") else spark.createDataFrame([], ATTEMPT)


def _succeeded(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """(key, findings, digest) of the keys that have succeeded; raises if what is stored of one was changed since."""
    done = attempts(spark, root).filter("status = 'succeeded'").join(keys, "key", "left_semi").groupBy("key").agg(F.max("findings").alias("findings"), F.max("digest").alias("digest"))
    now = _digests(stored_findings(spark, root).join(keys, "key", "left_semi"))
    both = done.join(now.select("key", F.col("digest").alias("now")), "key", "left")
    changed = both.filter(F.when(F.col("findings") == 0, F.col("now").isNotNull()).otherwise(~F.col("now").eqNullSafe(F.col("digest"))))
    if (bad := changed.first()) is not None:
        raise PriorSuccessInvalid(f"findings of {bad.key[:16]} are not those of its attempt")
    return done


def _digests(findings: DataFrame) -> DataFrame:
    return findings.groupBy("key").agg(F.count("*").alias("n"), digest_of_rows(row_digest([c for c in findings.columns if c != "key"])).alias("digest"))


def stored_findings(spark: SparkSession, root: str) -> DataFrame:
    schema = f"{FINDING}, key string"
    return spark.read.schema(schema).parquet(f"{root}/findings") if exists(spark, f"{root}/findings") else spark.createDataFrame([], schema)


def run_attempt(spark: SparkSession, raw: DataFrame, m: mapping.Mapping, as_of: date | str, root: str, expected: DataFrame | None = None, names: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """Audits every partition of `raw` (`partition` and the mapping's columns) that has not succeeded with the same content before.

    Returns (partition, attempt, status, failure, records, findings), status `succeeded`, `reused` or `failed`. A partition fails, and
    only it, if a row is invalid (`invalid_rows`), its history contradicts itself (`ambiguous_history`) or it does not have the rows
    that `expected` (partition, records) says (`record_count`). All partitions are audited in one plan. Findings are written under the
    partition's key, then the attempt into the ledger: a run that was cut leaves partitions that it had not entered, and they are
    audited again. Findings of an earlier success that were changed since raise and are not replaced. An empty table gives no rows.
    """
    names = tuple(names)
    rows = content_keys(raw, m, as_of, names).collect()  # a row a partition, which steer the run
    planned = spark.createDataFrame([(r.partition, r.source_records, r.key) for r in rows], "partition string, source_records long, key string")
    done = {r.key: r.findings for r in _succeeded(spark, root, F.broadcast(planned.select("key"))).collect()}
    tried = {r.partition: r.n for r in attempts(spark, root).groupBy("partition").agg(F.max("attempt").alias("n")).collect()}
    stale = F.broadcast(spark.createDataFrame([(r.partition, r.key) for r in rows if r.key not in done], "partition string, key string"))
    status = [(r.partition, tried.get(r.partition, 0), "reused", None, r.source_records, done[r.key]) for r in rows if r.key in done]
    if len(done) < len(rows):
        fresh = _audit(spark, raw.join(stale.select("partition"), "partition", "left_semi"), m, as_of, root, expected, names, stale)
        entries = [(r.key, r.partition, tried.get(r.partition, 0) + 1, "failed" if r.failure else "succeeded", r.failure, r.records, r.findings, r.digest) for r in fresh]
        spark.createDataFrame(entries, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
        status += [(e[1], e[2], e[3], e[4], e[5], e[6]) for e in entries]
    return spark.createDataFrame(status, "partition string, attempt int, status string, failure string, records long, findings long")


def _audit(spark: SparkSession, raw: DataFrame, m: mapping.Mapping, as_of, root: str, expected: DataFrame | None, names: tuple[str, ...], keys: DataFrame) -> list[Judged]:
    """(partition, key, failure, records, findings, digest) of the partitions of `keys`, once their findings are written."""
    marked = mapping.marked_rows(raw, m, keep=("partition",))
    path = f"{work_folder(spark)}/rows"
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    facts = rows.filter("problem IS NULL").select(*FACT.names, "partition")
    # Revision lineages are those of a partition: its name goes before the row key while they are looked at.
    own = facts.withColumn("source_row_key", F.concat_ws("/", "partition", "source_row_key"))
    # A partition's name may hold a slash itself; the lineage's entry is found again through its rows.
    broken = lineage_violations(own.drop("partition"))
    named = with_lineage(own).filter("lineage_id IS NOT NULL").select("partition", "lineage_id")
    ambiguous = named.join(broken.select("lineage_id").distinct(), "lineage_id", "left_semi").select("partition").distinct().withColumn("ambiguous", F.lit(True))
    counts = rows.groupBy("partition").agg(F.count("*").alias("records"), F.count("problem").alias("bad"))
    state = keys.join(counts, "partition", "left").join(ambiguous, "partition", "left")
    state = state.join(expected.select("partition", F.col("records").alias("wanted")), "partition", "left") if expected is not None else state.withColumn("wanted", F.lit(None).cast("long"))
    failure = F.when(F.col("bad") > 0, "invalid_rows").when(F.col("wanted") != F.col("records"), "record_count").when(F.col("ambiguous"), "ambiguous_history")
    judged = state.select("partition", "key", failure.alias("failure"), F.coalesce("records", F.lit(0)).alias("records")).collect()
    good = F.broadcast(spark.createDataFrame([(r.partition, r.key) for r in judged if not r.failure], "partition string, key string"))
    sound = facts.join(good, "partition")
    audit = _snapshots(sound, as_of)
    found = run_detectors(audit, as_of, names, scope=("partition",)).join(good, "partition")
    found.hint("rebalance", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{root}/findings")
    sound.select("key", "partition", "entity_id").distinct().hint("rebalance", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{root}/entities")
    sums = {r.key: r for r in _digests(stored_findings(spark, root).join(good.select("key"), "key", "left_semi")).collect()}
    return [Judged(r.partition, r.key, r.failure, r.records, sums[r.key].n if r.key in sums else 0, sums[r.key].digest if r.key in sums else None) for r in judged]


def _snapshots(facts: DataFrame, as_of) -> DataFrame:
    """The audit input of each partition: lineages of two partitions are not one."""
    apart = facts.withColumn("source_row_key", F.concat_ws("/", "partition", "source_row_key"))
    seen = snapshot(apart, as_of)
    return seen.select("partition", *sanitize(seen).columns)


def finalize(spark: SparkSession, raw: DataFrame, m: mapping.Mapping, as_of: date | str, root: str, names: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """The findings of all partitions of `raw`, once each has succeeded and no entity is in two of them; else NotFinal.

    What is final is written once as `final.json` below `root`, by the partitions' keys: the same run again is the same text, another
    content of the table is another file's name, and stored findings that were changed raise.
    """
    rows = content_keys(raw, m, as_of, tuple(names)).collect()
    keys = F.broadcast(spark.createDataFrame([(r.key,) for r in rows], "key string"))
    done = {r.key: r for r in _succeeded(spark, root, keys).collect()}
    if left := sorted(r.partition for r in rows if r.key not in done):
        raise NotFinal(f"{len(left)} partitions are not done, {left[0]} first")
    if rows:
        entities = spark.read.schema("partition string, entity_id string, key string").parquet(f"{root}/entities").join(keys, "key", "left_semi")
        if (twice := entities.groupBy("entity_id").agg(F.count_distinct("partition").alias("n"), F.min("partition").alias("p")).filter("n > 1").first()) is not None:
            raise NotFinal(f"an entity of partition {twice.p} is in {twice.n} partitions")
    body = {"partitions": sorted([r.partition, r.key, done[r.key].findings, done[r.key].digest or ""] for r in rows), "records": sum(r.source_records for r in rows)}
    name = hashlib.sha256("".join(sorted(r.key for r in rows)).encode()).hexdigest()[:16]
    store_text(spark, f"{root}/final-{name}.json", json.dumps(body, sort_keys=True))
    return stored_findings(spark, root).join(keys, "key", "left_semi").drop("key")
