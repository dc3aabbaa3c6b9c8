"""Trees of files known by the hashes of their chunks, and a reader that names what is not as it was sealed."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.ident import digest_of_rows, row_digest
from factlens.sources import arrow_source

#: Bytes of a chunk, the unit of hashing and of a task's memory.
CHUNK = 32 << 20
#: What a path below the root may be: at most eight names of small letters, digits and `._=-`, none of which starts with a dot.
SEGMENT = r"[a-z0-9_=-][a-z0-9._=-]{0,127}"
GRAMMAR = re.compile(rf"{SEGMENT}(/{SEGMENT}){{0,7}}")
CHUNKS = "path string, chunk long, size long, sha256 string"


class NotIntact(ValueError):
    """A tree of files is not the sealed one."""


def _listed(spark: SparkSession, path: str, content: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", *(["content"] if content else []))


def chunk_hashes(spark: SparkSession, root: str, chunk: int = CHUNK) -> DataFrame:
    """(path, chunk, size, sha256) of all files below `root` that hold a byte, paths relative to it: Spark does not list empty files.

    Executors read their chunks, so a large file is hashed by many tasks. Files of a store that pyarrow does not reach come whole from Spark.
    """
    near = arrow_source.reachable(root)
    base = root.rstrip("/")
    files = _listed(spark, root, not near)
    pieces = files.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / chunk).cast("long") - 1)))
    if near:
        pieces = pieces.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def hashed(batches):
        for b in batches:
            out = []
            for i, (path, n) in enumerate(zip(b.column("path").to_pylist(), b.column("chunk").to_pylist(), strict=True)):
                if near:
                    store, at = arrow_source.opened(unquote(path))
                    with store.open_input_file(at) as f:
                        f.seek(n * chunk)
                        data = f.read(chunk)
                else:
                    data = b.column("content")[i].as_py()[n * chunk : (n + 1) * chunk]
                out.append((path, n, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "chunk", "size", "sha256"])

    found = pieces.mapInArrow(hashed, CHUNKS)
    # Spark names files with their store; what follows the root is the path.
    tail = re.sub(r"^[a-z]+:/*", "", base)
    return found.withColumn("path", F.regexp_replace(F.substring_index(F.col("path"), tail + "/", -1), "^/+", ""))


def file_hashes(spark: SparkSession, path: str, piece: int = CHUNK) -> DataFrame:
    """(path, size, sha256) of the file at `path`, or of all below it: whole files, hashed piece by piece, a file in one task."""
    near = arrow_source.reachable(path)

    def hashed(batches):
        for b in batches:
            out = []
            for i, name in enumerate(b.column("path").to_pylist()):
                h, n = hashlib.sha256(), 0
                if near:
                    store, at = arrow_source.opened(unquote(name))
                    with store.open_input_stream(at) as f:
                        while data := f.read(piece):
                            h.update(data)
                            n += len(data)
                else:
                    data = b.column("content")[i].as_buffer()
                    h.update(data)
                    n = data.size
                out.append((name, n, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "size", "sha256"])

    return _listed(spark, path, not near).mapInArrow(hashed, "path string, size long, sha256 string")


def seal(spark: SparkSession, root: str, manifest: str, chunk: int = CHUNK) -> str:
    """Writes the chunk hashes of the tree below `root` to the table `manifest`, which must not exist; returns the tree's digest.

    A path outside the grammar raises before anything is written.
    """
    found = chunk_hashes(spark, root, chunk)
    if (bad := found.filter(~_fits(F.col("path"))).first()) is not None:
        raise NotIntact(f"not a path: {bad.path}")
    found.withColumn("chunk_bytes", F.lit(chunk).cast("long")).write.mode("errorifexists").parquet(manifest)
    return tree_digest(_manifest(spark, manifest))


def _fits(path):
    return path.rlike(f"^{GRAMMAR.pattern}$")


def _manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(T.StructType([*T.StructType.fromDDL(CHUNKS), T.StructField("chunk_bytes", T.LongType())])).parquet(manifest)


def tree_digest(chunks: DataFrame) -> str:
    return chunks.select(row_digest(["path", "chunk", "size", "sha256"]).alias("h")).agg(digest_of_rows(F.col("h")).alias("d")).first().d


def problems(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """(path, chunk, problem) of what differs from the sealed tree: `path`, `unexpected`, `missing`, `size` or `changed`, with the chunk."""
    sealed = _manifest(spark, manifest)
    first = sealed.select("chunk_bytes").first()
    now = chunk_hashes(spark, root, first.chunk_bytes if first else CHUNK)
    a = sealed.select("path", "chunk", F.col("size").alias("then_size"), F.col("sha256").alias("then"))
    b = now.select("path", "chunk", F.col("size").alias("now_size"), F.col("sha256").alias("now"))
    both = a.join(b, ["path", "chunk"], "full_outer")
    problem = F.when(~_fits(F.col("path")), "path").when(F.col("then").isNull(), "unexpected").when(F.col("now").isNull(), "missing").when(F.col("then_size") != F.col("now_size"), "size").when(F.col("then") != F.col("now"), "changed")
    return both.select("path", "chunk", problem.alias("problem")).filter("problem IS NOT NULL")


def read_sealed(spark: SparkSession, root: str, manifest: str, digest: str, columns: list[str] | None = None) -> DataFrame:
    """The Parquet table below `root`, if its manifest has that digest and every byte is as it was sealed; else NotIntact names the first difference."""
    if tree_digest(_manifest(spark, manifest)) != digest:
        raise NotIntact("the manifest is not the sealed one")
    if (bad := problems(spark, root, manifest).orderBy("path", "chunk").first()) is not None:
        raise NotIntact(f"{bad.path}, chunk {bad.chunk}: {bad.problem}")
    table = spark.read.parquet(root)
    return table.select(*columns) if columns else table
