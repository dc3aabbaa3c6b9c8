"""Shared pieces: scratch tables, Arrow row iteration, 64-bit word and n-gram hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A document without an id takes part as the document with the smallest id.
NULL_ID = -(1 << 63)
ARROW_ROWS = 2000
try:
    TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    TRIM = None
#: Words gathered before numpy works on them at once.
BLOCK_WORDS = 200_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='factlens-')}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only in a local session where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (given or _own_dir()).rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        WRITTEN.append(self.base)
        limit_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.base}/{name}")


#: Folders of scratch tables that this driver wrote.
WRITTEN: list[str] = []


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Removes the scratch tables of all operators of this driver, once their results are written; how many folders there were."""
    n = len(WRITTEN)
    while WRITTEN:
        _delete(spark, WRITTEN.pop())
    return n


def limit_batches(spark: SparkSession) -> None:
    """Long texts: at most ARROW_ROWS rows go to Python at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, name) of the documents with one label, 0 or 1; a doc_id with both labels, or none, is left out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias(name)).filter(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("other")).filter(F.col(name) == F.col("other")).select("doc_id", name)


def id_key(c: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pow2(n: float, low: int, high: int) -> int:
    """The least power of two of at least n, within the bounds."""
    x = low
    while x < n and x < high:
        x *= 2
    return x


def release() -> None:
    """Gives a Python worker's freed memory back to the system, Arrow's too: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def tidy(run):
    """`run` (batches -> batches), with memory given back at its end."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return out


def tidy_group(run):
    """`run` (table -> table), with memory given back at its end."""

    def out(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            release()

    return out


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list:
    return col.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\t to \\r: words of [^\\x20\\x09-\\x0D]+."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


M1, M2, A, B = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
S29, S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> S32)
    x *= M1
    x ^= x >> S29
    x *= M2
    x ^= x >> S32
    return x


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * A + y * B)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items, by doubling: len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            part = power[done : done + n]
            out, done = part if out is None else pair(out, part), done + size
        if size * 2 > k:
            return mix(out + np.uint64(k))
        power, size = pair(power[:-size], power[size:]), size * 2


def blocks(batches: Iterator[pa.RecordBatch], cols: list[str], text: str = "text", fold=None) -> Iterator[tuple]:
    """(rows of cols, word hashes of all their texts, offsets); a block ends after BLOCK_WORDS."""
    rows, parts, ends, n = [], [], [0], 0
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in cols), strict=True)
        for key, t in zip(keys, as_bytes(batch.column(text)), strict=True):
            h = word_hashes(words_of(t if fold is None or t is None else fold(t)))
            rows.append(key)
            parts.append(h)
            n += len(h)
            ends.append(n)
            if n >= BLOCK_WORDS:
                yield rows, np.concatenate(parts), np.array(ends)
                rows, parts, ends, n = [], [], [0], 0
    if rows:
        yield rows, np.concatenate(parts), np.array(ends)


def starts_in_one_doc(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of runs of k words that do not cross a document's end."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))[:n]
    s = np.arange(n)
    return s[s + k <= last]


def segments(changed: np.ndarray) -> np.ndarray:
    """First index of each run, for changed[i]: item i + 1 differs from item i."""
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


def record(schema: str, **cols) -> pa.RecordBatch:
    kinds = dict(x.split() for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, type=KINDS[kinds[k]]) for k, c in cols.items()], names=list(cols))


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def add_columns(docs: DataFrame, start, ddl: str) -> DataFrame:
    """`docs` with the columns of `ddl` added (replaced if there).

    start() gives each task its own judge: a list of texts -> a list for each added column. What it remembers goes with the
    task. All other columns, of any name, travel in one struct beside the text.
    """
    added = T.StructType.fromDDL(ddl)
    docs = docs.drop(*added.names)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            cols = judge(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(c, type=KINDS[f.dataType.simpleString().replace("bigint", "long")]) if not isinstance(c, pa.Array) else c for c, f in zip(cols, added, strict=True))], names=["row", "text", *added.names])

    out = packed.mapInArrow(tidy(run), T.StructType([*packed.schema, *added]))
    return out.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], *added.names)
