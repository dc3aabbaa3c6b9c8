"""Frozen corpora: digests of units sealed once, what changed since, and classes of cases that open one after the other."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.ident import digest_of_rows, row_digest
from factlens.sources.sinks import ArtifactConflict, exists, store_text

#: Classes of cases in the order in which they open.
CLASSES = ("development", "validation", "reserved")
NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")


class Sealed(ValueError):
    """What is sealed is other than what is given, or must be sealed first."""


def unit_seals(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, records, digest) of the rows of every unit, in any order: one aggregation, whatever the units' sizes. A null unit is one too."""
    columns = [c for c in rows.columns if c != unit]
    return rows.select(F.col(unit).alias("unit"), row_digest(columns).alias("h")).groupBy("unit").agg(F.count("*").alias("records"), digest_of_rows(F.col("h")).alias("digest"))


def freeze(spark: SparkSession, root: str, name: str, rows: DataFrame, unit: str) -> DataFrame:
    """Seals every unit of `rows` below `root` under `name`, once: the same rows again change nothing, others raise. Returns the seals."""
    if not NAME.fullmatch(name):
        raise Sealed(f"not a name: {name!r}")
    path = f"{root.rstrip('/')}/frozen/{name}"
    if exists(spark, f"{path}/_SUCCESS"):
        if (bad := freeze_status(spark, root, name, rows, unit).filter("state != 'sealed'").first()) is not None:
            raise Sealed(f"{name}: unit {bad.unit} is {bad.state}")
    else:
        unit_seals(rows, unit).write.mode("overwrite").parquet(path)  # an unfinished write has no _SUCCESS and is replaced
    return seals(spark, root, name)


def seals(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root.rstrip('/')}/frozen/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        raise Sealed(f"{name} is not sealed")
    return spark.read.schema("unit string, records long, digest string").parquet(path)


def freeze_status(spark: SparkSession, root: str, name: str, rows: DataFrame, unit: str) -> DataFrame:
    """(unit, state, sealed_records, records): `sealed` as it was, `changed`, `missing` now, or `unexpected` as it was not there."""
    then = seals(spark, root, name).select("unit", F.col("records").alias("sealed_records"), F.col("digest").alias("then"))
    now = unit_seals(rows, unit).select(F.col("unit").alias("u"), "records", F.col("digest").alias("now"))
    both = then.join(now, F.col("unit").eqNullSafe(F.col("u")), "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed").otherwise("sealed")
    return both.select(F.coalesce("unit", "u").alias("unit"), state.alias("state"), "sealed_records", "records")


def seal_results(spark: SparkSession, root: str, seed_class: str, cases: DataFrame, results: DataFrame) -> str:
    """Seals the results of a class: a row for every case of it, none other, all of which ended; returns their digest.

    Written once: the same results again are the same seal, others raise. So results cannot be replaced after a later class was seen.
    """
    require_open(spark, root, seed_class, cases)
    mine = lambda df: df.filter(F.col("seed_class") == seed_class)
    both = mine(cases).select("case_id", F.lit(1).alias("asked")).join(mine(results).groupBy("case_id").agg(F.count("*").alias("n"), F.max("status").alias("status")), "case_id", "full_outer")
    wrong = both.filter("asked IS NULL OR n IS NULL OR n > 1 OR status NOT IN ('ok', 'no_target')").select("case_id").first()
    if wrong is not None:
        raise Sealed(f"{seed_class}: case {wrong.case_id} is not there once, or did not end")
    sealed = mine(results)
    row = sealed.select(row_digest(sealed.columns).alias("h")).agg(F.count("*").alias("n"), digest_of_rows(F.col("h")).alias("d")).first()
    try:
        store_text(spark, f"{root.rstrip('/')}/results-{seed_class}.json", json.dumps({"cases": row.n, "digest": row.d}))
    except ArtifactConflict as e:
        raise Sealed(f"{seed_class} is sealed with other results") from e
    return row.d


def require_open(spark: SparkSession, root: str, seed_class: str, cases: DataFrame, authorized: bool = False) -> None:
    """Raises unless cases of the class may run: all classes before it that have cases are sealed, and reserved ones are authorized."""
    if seed_class not in CLASSES:
        raise Sealed(f"no class of cases: {seed_class}")
    if seed_class == CLASSES[-1] and not authorized:
        raise PermissionError("reserved cases need authorization")
    there = {r.seed_class for r in cases.select("seed_class").distinct().collect()}
    for before in CLASSES[: CLASSES.index(seed_class)]:
        if before in there and not exists(spark, f"{root.rstrip('/')}/results-{before}.json"):
            raise Sealed(f"{seed_class} cases wait for the results of {before}")


def run_class(spark: SparkSession, root: str, seed_class: str, cases: DataFrame, run, authorized: bool = False) -> DataFrame:
    """run(cases of the class) -> results, if the class is open; a class that is sealed may run again and must give what was sealed."""
    require_open(spark, root, seed_class, cases, authorized)
    results = run(cases.filter(F.col("seed_class") == seed_class))
    if seed_class != CLASSES[-1]:
        seal_results(spark, root, seed_class, cases, results)
    return results
