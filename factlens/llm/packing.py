"""Packing token ids: near-equal windows by multiway differencing, and best-fit-decreasing id matrices."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm import tokens as T

CAPACITY, EOD = 2048, 1
#: What is left of a document after whole windows is cut into pieces of so many ids: small numbers balance well.
PIECE = 512
#: Pieces that are balanced together.
BUNDLE = 4096


def differencing(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp multiway differencing: the part of each size, for k parts of near-equal sums.

    A partial partition is its non-empty parts, largest first. The two of largest spread merge, the largest part of
    one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    left, right = list(range(n)), [-1] * n  # nodes: items, then unions of two nodes
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            s, m = np.concatenate((a, b)), np.concatenate((x, y))
        else:  # the smallest of a meet the smallest of b, in opposite order; with all k parts filled the largest meet the smallest
            i, j = len(a) - over, len(b) - over
            new = np.arange(len(left), len(left) + over)
            left += x[i:].tolist()
            right += y[j:][::-1].tolist()
            s, m = np.concatenate((a[:i], b[:j], a[i:] + b[j:][::-1])), np.concatenate((x[:i], y[:j], new))
        order = np.argsort(-s, kind="stable")
        s, m = s[order], m[order]
        serial += 1
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), serial, s, m))
    part = [0] * len(left)
    for p, node in enumerate(heap[0][3].tolist()):
        part[node] = p
    for node in range(len(left) - 1, n - 1, -1):
        part[left[node]] = part[right[node]] = part[node]
    return part[:n]


def windows(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Windows of near-equal sums of at most `capacity`; their number rises whenever one exceeds it. No sizes, no windows."""
    if not sizes:
        return [], 0
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        part = differencing(sizes, k)
        sums = np.bincount(part, weights=sizes, minlength=k)
        if (over := int(sums.max()) - capacity) <= 0:
            return part, k
        k += 1 + over * k // (4 * capacity)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, capacity: int, piece: int, path: str | None) -> DataFrame:
    """Pieces of every document's ids (with EOD behind): whole windows, then pieces of at most `piece` ids.

    A null or empty text is the one piece of the end id; repeated rows are cut each, a null doc_id stays, an empty table has no pieces.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = T.word_ids(path or T.default_path())
        end = np.array([EOD], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
                ids = known.text(text) + end
                n = len(ids) // 4
                whole = n // capacity * capacity
                for a in (*range(0, whole, capacity), *range(whole, n, piece)):
                    b = a + capacity if a < whole else min(a + piece, n)
                    for c, v in zip(out.values(), (doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n), strict=True):
                        c.append(v)
            yield C.record(PIECES, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, PIECES)


PACKED = PIECES + ", sequence_id long, offset long"


def _pack(t: pa.Table, capacity: int) -> pa.Table:
    t = t.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length", "doc_tokens", "row")])
    length, base = t.column("length").to_pylist(), t.column("bundle")[0].as_py() << 32
    small = [i for i, n in enumerate(length) if n < capacity]
    seq, offset, used = [0] * len(length), [0] * len(length), 0
    if small:
        part, used = windows([length[i] for i in small], capacity)
        filled = [0] * used
        for i, p in zip(small, part, strict=True):
            seq[i], offset[i] = p, filled[p]
            filled[p] += length[i]
    for i, n in enumerate(length):
        if n >= capacity:
            seq[i], used = used, used + 1
    return t.drop_columns(["bundle", "row"]).append_column("sequence_id", pa.array([base + s for s in seq], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, path: str | None = None) -> DataFrame:
    """Every piece of every row of `docs` (doc_id, text) with its sequence and offset; no sequence holds over `capacity` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (its bundle's number times 2^32, plus one
    within the bundle), offset. A null or empty text is the one end id. Repeated rows are packed each for itself, and a
    null doc_id stays null: pieces are dealt to bundles by a number that is written down with them, so however many are
    equal, no bundle is large. An empty table gives an empty result. Other columns are not read.
    """
    scratch = C.Scratch(spark, "packing")
    pieces = scratch.write(cut(docs, capacity, piece, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    bundles = max(1, pieces.count() // BUNDLE)
    keyed = pieces.withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(bundles)))
    return keyed.groupBy("bundle").applyInArrow(lambda t: _pack(t, capacity), PACKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids; nulls, ties, repeats and empty tables as in pack."""
    return pack(spark, C.table(spark, sf_dir, "documents"))


class Fits:
    """Open bins by free space 0 to `capacity`, in a segment tree of counts: the least space of at least a size."""

    def __init__(self, capacity: int):
        self.n = C.pow2(capacity + 1, 1, 1 << 40)
        self.count, self.bins = [0] * (2 * self.n), [[] for _ in range(capacity + 1)]

    def add(self, space: int, b: int) -> None:
        self.bins[space].append(b)
        self._move(space, 1)

    def _move(self, space: int, by: int) -> None:
        i = space + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(space, bin) of the tightest bin for `size`, removed; None if there is none."""
        i = size + self.n
        while not self.count[i]:
            while i & 1:  # a right child: nothing larger below its parent
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # ran over the end of its level
                return None
        while i < self.n:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        self._move(i - self.n, -1)
        return i - self.n, self.bins[i - self.n].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: items of each bin."""
    fits, out = Fits(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = fits.take(sizes[i])
        space, b = got if got else (capacity, len(out))
        if not got:
            out.append([])
        out[b].append(i)
        if space > sizes[i]:
            fits.add(space - sizes[i], b)
    return out


MATRIX = "sequence_id long, n_tokens int, id_bytes int, ids binary, cu_seqlens binary, position_resets binary, doc_ids binary, starts binary"
#: Ids that a task holds before it packs them.
MATRIX_IDS = 4_000_000


def matrices(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Rows of packed id matrices of `docs` (doc_id, text): best-fit-decreasing, within each task.

    ids: `capacity` little-endian unsigned ids of id_bytes each (2, or 4 for a vocabulary over 65,536), zeros behind n_tokens.
    cu_seqlens: 32-bit cumulative segment lengths from 0. position_resets: 32-bit offsets at which position ids start
    again at 0. doc_ids, starts: 64-bit, of each segment; a null doc_id is -2^63. Documents over the capacity are
    split losslessly. A null or empty text is the one end id; repeated rows are packed each. sequence_id: the
    task's number times 2^32, plus one within the task, so a task that runs again writes the same rows.
    """
    C.limit_batches(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, done = T.word_ids(path or T.default_path()), TaskContext.get().partitionId() << 32, 0
        held, n, kind = [], 0, known.kind
        for batch in batches:
            for doc_id, text in zip(batch.column("idk").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
                ids = np.append(np.frombuffer(known.text(text), "<u4"), np.uint32(EOD)).astype(kind)
                held += [(doc_id, a, ids[a : a + capacity]) for a in range(0, len(ids), capacity)]
                n += len(ids)
                if n >= MATRIX_IDS:
                    yield (out := _matrix(held, capacity, task + done))
                    done, held, n = done + out.num_rows, [], 0
        if held:
            yield _matrix(held, capacity, task + done)

    return docs.select(C.id_key().alias("idk"), "text").mapInArrow(each, MATRIX)


def _matrix(held: list, capacity: int, base: int) -> pa.RecordBatch:
    out: dict[str, list] = {c.split()[0]: [] for c in MATRIX.split(", ")}
    for s, items in enumerate(best_fit([len(x[2]) for x in held], capacity)):
        row, ends = np.zeros(capacity, held[items[0]][2].dtype), np.cumsum([0] + [len(held[i][2]) for i in items]).astype("<i4")
        row[: ends[-1]] = np.concatenate([held[i][2] for i in items])
        for c, v in zip(out.values(), (base + s, int(ends[-1]), row.itemsize, row.tobytes(), ends.tobytes(), ends[:-1].tobytes(), np.array([held[i][0] for i in items], "<i8").tobytes(), np.array([held[i][1] for i in items], "<i8").tobytes()), strict=True):
            c.append(v)
    return C.record(MATRIX, **out)


def unpack(row) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, start, ids) of every segment of a matrix row; a segment's position ids count from 0."""
    ids, cu = np.frombuffer(row["ids"], f"<u{row['id_bytes']}"), np.frombuffer(row["cu_seqlens"], "<i4")
    return [(int(d), int(s), ids[a:b]) for d, s, a, b in zip(np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["starts"], "<i8"), cu[:-1], cu[1:], strict=True)]


def write_matrices(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> None:
    """Matrix rows as Parquet files under `path`, by Spark's committer."""
    matrices(spark, docs, capacity, tokenizer).write.mode("errorifexists").parquet(path)


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents; nulls, ties, repeats and empty tables as in matrices."""
    return matrices(spark, C.table(spark, sf_dir, "documents"))
