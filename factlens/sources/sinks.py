"""Sinks: immutable artifacts, public and private trees, checksums, a leak scan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIVATE = ("original_record_id", "injected_record_id", "target_rank", "original_value", "original_available_on")


#: Work folders that this driver named.
WORK: list[str] = []


class ArtifactConflict(ValueError):
    """Another content is already stored under the name."""


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def work_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local temporary folder only where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp()}"
    WORK.append(f"{root.rstrip('/')}/audit-{uuid.uuid4().hex[:12]}")
    return WORK[-1]


def clear_work(spark: SparkSession) -> int:
    """Removes all work folders of this driver, once the results that read them are written; how many there were."""
    n = len(WORK)
    while WORK:
        target = spark._jvm.org.apache.hadoop.fs.Path(WORK.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return n


def store_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes `text` at `path` once, by a rename of a temporary file. The same text again is reused (False); another one is an error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if bytes(spark.read.format("binaryFile").load(path).collect()[0].content).decode() != text:
            raise ArtifactConflict(path)
        return False
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        raise ArtifactConflict(path)
    return True


def write_table(df: DataFrame, root: str, name: str) -> str:
    """A Parquet table that must not exist; its _SUCCESS file says that it is whole."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_public(df: DataFrame, root: str, name: str) -> str:
    """As write_table; columns of the manifest must not leave the private tree."""
    if leaked := sorted(set(df.columns) & set(PRIVATE)):
        raise ValueError(f"private columns: {leaked}")
    return write_table(df, root, name)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of all files below `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_checksums(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against `known` (path, sha256)."""
    now = checksums(spark, path).select("path", F.col("sha256").alias("now"))
    both = known.select("path", F.col("sha256").alias("then")).join(now, "path", "full_outer")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", status.alias("status")).filter("status IS NOT NULL")


SECRET = r"(?i)(BEGIN [A-Z ]*PRIVATE KEY|password\s*[=:]|Traceback \(most recent call last\)|/home/[a-z]|/Users/)"


def leaks(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of text that show a private key of the manifest, a secret, a home folder or a traceback."""
    keys = "|".join(f'"{re.escape(k)}"' for k in PRIVATE)
    return texts.filter(F.col(column).rlike(SECRET) | F.col(column).rlike(keys))
