"""Substring dedup: count-min prefilter, then exact grouping of the windows estimated repeated.

Pass 1: every window of `size` words has an anchor: its minimal run of `GRAM` words, the leftmost
of ties. Equal windows have equal anchors at equal places, so an anchor occurs at least as often as
any window that it stands for. Tasks send sparse sketches of their anchors, dealt by hash into blocks, as
many as the data ask for; a block's task merges them into a count-min sketch of two rows, whose counts
overestimate those of the windows. It answers which anchors of which documents are estimated to repeat. Nothing is
broadcast and nothing is held to a size, so the filter is as sharp at any size of the data.
Pass 2: the windows of those anchors go on (none that repeats is lost); each task keeps the
first of equal windows at once, which bounds what a hot passage sends, and exact groups by a 96-bit
hash mark all windows but the first by (doc_id, start). Windows are grouped under their anchor, those of anchors
that occur very often under their own hash, so that a common run of words with many surroundings is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import common as C

GRAM = 8
ROWS = 2
SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2D358DCCAA6C78A5))
#: Text bytes that one block of the sketch stands for, about 400,000 anchors; eight cells are kept for each.
BLOCK_BYTES = 16_000_000
CELLS = (1 << 10, 1 << 24)
#: Anchors, and candidate windows, gathered before a task sends them.
ANCHORS, FLUSH = 600_000, 300_000
#: Text bytes for one task of exact groups.
SLICE_BYTES = 10_000_000
#: An anchor counted so often is hot, at least; at most HOT_KEYS anchors are, which bounds the one broadcast (8 bytes each).
HOT, HOT_KEYS = 5_000, 1 << 22
SECOND = np.uint64(0xA0761D6478BD642F)
LOW32, S32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, cur = 1, x
    while size * 2 <= width:
        cur, size = np.minimum(cur[:-size], cur[size:]), size * 2
    rest = width - size
    return np.minimum(cur[:-rest], cur[rest:]) if rest else cur


def _windows(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the anchor place of each, and the hash of the run at any place."""
    starts, gram = C.starts_in_one_doc(offsets, size), min(GRAM, size)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    runs = C.ngrams(h, gram)
    ranked = (runs & ~LOW32) | np.arange(len(runs), dtype=np.uint64)
    return starts, (_sliding_min(ranked, size - gram + 1) & LOW32).astype(np.int64)[starts], runs


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (C.mix(keys + SEEDS[row]) & np.uint64(width - 1)).astype(np.int64)


def _anchors(h: np.ndarray, offsets: np.ndarray, size: int):
    """Of all windows: start, document, anchor hash, and the index of the first window of each anchor's run of windows."""
    starts, places, runs = _windows(h, offsets, size)
    if not len(starts):
        return starts, starts, runs, starts
    return starts, np.searchsorted(offsets, starts, side="right") - 1, runs[places], C.segments(places[1:] != places[:-1])


def _cut(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys of an ordered array."""
    if not len(key):
        return []
    first = C.segments(key[1:] != key[:-1])
    return list(zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True))


SKETCH = "slice int, once binary, once_docs binary, more binary, times binary, known binary, known_docs binary"


def sketches(docs: DataFrame, size: int, slices: int) -> DataFrame:
    """Sparse partition sketches of `docs` (idk, tkey, dkey, text), per block.

    once: anchors of one document each (in once_docs); more, times: anchors counted more than once here. Those are
    known to repeat, so known and known_docs, dealt by document, say at once which documents hold them.
    """
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def flush():
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = C.segments(key[1:] != key[:-1])
            times = np.diff(np.append(first, len(key)))
            alone, own = times == 1, key[first]
            again = np.repeat(~alone, times)
            parts: dict[int, dict] = {}
            for (keys, *others), to, columns in (
                ((own[alone], doc[first[alone]]), own[alone], ("once", "once_docs")),
                ((own[~alone], times[~alone].astype("<u4")), own[~alone], ("more", "times")),
                ((key[again], doc[again]), doc[again].astype(np.uint64), ("known", "known_docs")),
            ):
                to = (C.mix(to + C.A) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, keys, others = to[order], (keys & LOW32).astype("<u4")[order], others[0][order]
                for a, b in _cut(to):
                    parts.setdefault(int(to[a]), {}).update({columns[0]: keys[a:b].tobytes(), columns[1]: others[a:b].tobytes()})
            return C.record(SKETCH, slice=list(parts), **{c: [p.get(c) for p in parts.values()] for c in names[1:]})

        for rows, h, offsets in C.blocks(batches, ["idk", "tkey", "dkey"]):
            _, doc, key, first = _anchors(h, offsets, size)
            new = np.array([r[:2] not in seen and not seen.add(r[:2]) for r in rows])  # repeated rows are one document
            if len(first) and (ok := new[doc[first]]).any():
                dkeys = np.array([r[2] for r in rows], "<i8")
                held.append((key[first][ok], dkeys[doc[first][ok]]))
                n += int(ok.sum())
            if n >= ANCHORS:
                yield flush()
                held, n, seen = [], 0, set()
        if n:
            yield flush()

    return docs.mapInArrow(C.tidy(count), SKETCH)


HITS = "dkey long, keys binary"


def _estimated(t: pa.Table, hot: int) -> pa.Table:
    """Merges the sketches of one block: the anchors estimated to repeat of each document; without a document: the hot ones."""
    slice_ = t.column("slice")[0].as_py()
    once, once_docs, more, times, known, known_docs = (np.frombuffer(b"".join(x for x in t.column(c).to_pylist() if x), k) for c, k in (("once", "<u4"), ("once_docs", "<i8"), ("more", "<u4"), ("times", "<u4"), ("known", "<u4"), ("known_docs", "<i8")))
    keys, counts = np.concatenate((once, more)).astype(np.uint64), np.concatenate((np.ones(len(once)), times))
    width, estimate = C.pow2(8 * len(keys), *CELLS), np.full(len(keys), np.inf)
    for row in range(ROWS):
        cells = _cells(keys, row, width)
        estimate = np.minimum(estimate, np.bincount(cells, weights=counts, minlength=width)[cells])
    again = estimate[: len(once)] >= 2
    doc, key = np.concatenate((once_docs[again], known_docs)), np.concatenate((once[again], known))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    cuts = _cut(doc)
    often, at = np.unique(keys[estimate >= hot], return_inverse=True)
    often = often[np.bincount(at, weights=counts[estimate >= hot], minlength=len(often)) >= hot]
    out = C.record(HITS, dkey=[int(doc[a]) for a, _ in cuts], keys=[key[a:b].tobytes() for a, b in cuts])
    return pa.Table.from_batches([out, C.record(HITS, dkey=[None], keys=[(often | np.uint64(slice_) << S32).astype("<u8").tobytes()])])


PACKED = "target int, docs binary, sizes binary, keys binary"


def _dealt(t: pa.Table, targets: int) -> pa.Table:
    """The hits of one block by the target of their document, a row a target; without a target: the hot anchors.

    A row a document and block would be more rows with every block that the data add.
    """
    parts: dict[int | None, tuple[list, list, list]] = {}
    for d, k in zip(t.column("dkey").to_pylist(), t.column("keys").to_pylist(), strict=True):
        for x, y in zip(parts.setdefault(None if d is None else d % targets, ([], [], [])), (d or 0, len(k), k), strict=True):
            x.append(y)
    return pa.Table.from_batches([C.record(PACKED, target=list(parts), docs=[np.array(d, "<i8").tobytes() for d, _, _ in parts.values()], sizes=[np.array(n, "<i8").tobytes() for _, n, _ in parts.values()], keys=[b"".join(k) for _, _, k in parts.values()])])


ASKED = "dkey long, hits binary"


def _by_document(t: pa.Table) -> pa.Table:
    """All hits of the documents of one target, a row a document."""
    hits: dict[int, list[bytes]] = {}
    for docs, sizes, keys in zip(*(t.column(c).to_pylist() for c in ("docs", "sizes", "keys")), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
        for d, a, b in zip(np.frombuffer(docs, "<i8").tolist(), [0, *ends], ends, strict=False):
            hits.setdefault(d, []).append(keys[a:b])
    return pa.Table.from_batches([C.record(ASKED, dkey=list(hits), hits=[b"".join(x) for x in hits.values()])])


def _zipped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`docs` with its text compressed, for a shuffle."""
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("z", T.BinaryType())])

    def zip_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([None if t is None else pack(t) for t in C.as_bytes(b.column("text"))], pa.binary())], names=[*keep, "z"])

    return docs.select(*keep, "text").mapInArrow(zip_, schema)


CANDIDATES = "slice int, idk long, tkey long, lo int, hi int, w binary"
WINDOW = np.dtype([("a", "<u8"), ("b", "<u4")])


def candidates(docs: DataFrame, size: int, slices: int, blocks: int, hot) -> DataFrame:
    """Runs lo to hi of starts of windows of `docs` (idk, tkey, z, keys), the first of equals in a task; w: their hashes, null for a run known to repeat."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held, keys, n, seen = hot.value, [], [], 0, set()
        for rows, h, offsets in C.blocks(batches, ["idk", "tkey", "hits"], text="z", fold=zstandard.ZstdDecompressor().decompress):
            starts, doc, anchor, first = _anchors(h, offsets, size)
            if len(starts):
                asked = [np.frombuffer(r[2], "<u4").astype(np.uint64) | np.uint64(i) << S32 for i, r in enumerate(rows) if r[:2] not in seen and not seen.add(r[:2])]
                asked = np.sort(np.concatenate(asked)) if asked else np.empty(0, np.uint64)
                ok = np.repeat(_within(anchor[first] & LOW32 | doc[first].astype(np.uint64) << S32, asked), np.diff(np.append(first, len(starts))))
                starts, doc, anchor = starts[ok], doc[ok], anchor[ok]
                w1, w2 = C.ngrams(h, size)[starts], C.ngrams(C.mix(h ^ SECOND), size)[starts]
                block = C.mix(anchor + C.A) % np.uint64(blocks)
                dealt = np.where(_within(anchor & LOW32 | block << S32, often), w1, anchor) if len(often) else anchor
                held.append((w1, w2 & LOW32, C.mix(dealt + C.B) % np.uint64(slices), starts - offsets[doc], doc + len(keys)))
                n += len(starts)
            keys += [r[:2] for r in rows]
            if n >= FLUSH:
                yield _flush(held, keys, slices)
                held, keys, n, seen = [], [], 0, set()
        if n:
            yield _flush(held, keys, slices)

    return docs.mapInArrow(C.tidy(search), CANDIDATES)


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def _order(w1, w2, ids, tkeys, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by (window, doc_id, start, text), and whether an item is not its window's first."""
    at = np.lexsort((tkeys, start, ids, w2, w1))
    a, b = w1[at], w2[at]
    same = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    i, s, k = ids[at], start[at], tkeys[at]
    # Rows of one id, start and text are one occurrence, so repeated rows do not remove each other.
    return at, same & ~((i == i[first]) & (s == s[first]) & (k == k[first]))


def _runs(ids, tkeys, start, group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one document and group: the order of the items, first index and length of each run."""
    at = np.lexsort((start, tkeys, ids))
    i, k, s, g = ids[at], tkeys[at], start[at], group[at]
    first = C.segments((i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1) | (g[1:] != g[:-1])) if len(at) else np.empty(0, np.int64)
    return at, first, np.diff(np.append(first, len(at)))


def _flush(held: list, keys: list, slices: int) -> pa.RecordBatch:
    w1, w2, to, start, doc = (np.concatenate(x) for x in zip(*held, strict=True))
    own = np.array(keys, np.int64)
    ids, tkeys, to = own[doc, 0], own[doc, 1], to.astype(np.int64)
    at, later = _order(w1, w2, ids, tkeys, start)
    out = []
    for mine, hashed in ((at[later], False), (at[~later], True)):
        group = to[mine] if hashed else np.zeros(len(mine), np.int64)
        order, first, many = _runs(ids[mine], tkeys[mine], start[mine], group)
        mine = mine[order]
        lead = mine[first]
        w = None
        if hashed:
            both = np.empty(len(mine), WINDOW)
            both["a"], both["b"] = w1[mine], w2[mine]
            w = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(first, len(mine)) * WINDOW.itemsize).astype("<i4").tobytes()), pa.py_buffer(both.tobytes())])
        slice_ = to[lead] if hashed else (C.mix(ids[lead].astype(np.uint64) * C.A + tkeys[lead].astype(np.uint64)) % np.uint64(slices)).astype(np.int64)
        out.append(pa.RecordBatch.from_arrays([pa.array(slice_, pa.int32()), pa.array(ids[lead], pa.int64()), pa.array(tkeys[lead], pa.int64()), pa.array(start[lead], pa.int32()), pa.array(start[lead] + many - 1, pa.int32()), w if hashed else pa.nulls(len(first), pa.binary())], names=[x.split()[0] for x in CANDIDATES.split(", ")]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(b.num_rows for b in out) else out[0]


RUNS = "idk long, tkey long, lo int, hi int"


def _repeats(t: pa.Table) -> pa.Table:
    """Exact groups of one slice: runs of starts whose window starts earlier elsewhere."""
    hashed = pc.is_valid(t.column("w"))
    known, t = t.filter(pc.invert(hashed)).select(["idk", "tkey", "lo", "hi"]), t.filter(hashed)
    if not t.num_rows:
        return known
    idk, tkey, lo, hi = (t.column(c).to_numpy() for c in ("idk", "tkey", "lo", "hi"))
    both, many = np.frombuffer(b"".join(t.column("w").to_pylist()), WINDOW), (hi - lo + 1).astype(np.int64)
    ids, tkeys = np.repeat(idk, many), np.repeat(tkey, many)
    start = np.arange(len(both)) - np.repeat(np.cumsum(many) - many - lo, many)
    at, later = _order(both["a"], both["b"], ids, tkeys, start)
    mine = at[later]
    order, first, many = _runs(ids[mine], tkeys[mine], start[mine], np.zeros(len(mine), np.int64))
    lead = mine[order][first]
    return pa.concat_tables([known, pa.table([pa.array(ids[lead], pa.int64()), pa.array(tkeys[lead], pa.int64()), pa.array(start[lead], pa.int32()), pa.array(start[lead] + many - 1, pa.int32())], names=["idk", "tkey", "lo", "hi"])])


KEPT = "kept_text string, n_words long, n_removed long"


def repeated_anchors(spark: SparkSession, docs: DataFrame, size: int, total: int) -> tuple[DataFrame, np.ndarray, int]:
    """(dkey, hits) of the documents with anchors estimated to repeat, the hot anchors, and the number of blocks."""
    blocks = max(C.shuffle_partitions(spark), total // BLOCK_BYTES)
    # Anchors are no more than words, and words no more than half the bytes: so at most HOT_KEYS are counted so often.
    hot = max(HOT, -(-total // 2 // HOT_KEYS))
    found = sketches(docs, size, blocks).groupBy("slice").applyInArrow(C.tidy_group(lambda t: _dealt(_estimated(t, hot), blocks)), PACKED)
    found = C.Scratch(spark, "substrings").write(found, "hits")
    often = [np.frombuffer(r["keys"], "<u8") for r in found.filter("target IS NULL AND length(keys) > 0").collect()]
    return found.filter("target IS NOT NULL").groupBy("target").applyInArrow(C.tidy_group(_by_document), ASKED), np.sort(np.concatenate(often)) if often else np.empty(0, "<u8"), blocks


def dedup_substrings(spark: SparkSession, docs: DataFrame, size: int = 20) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, ...) and kept_text, n_words, n_removed.

    A word goes if a window of `size` words that covers it also starts earlier: in a smaller doc_id, or in
    the same document before. Kept words are joined by one space. A null or empty text has no words and keeps
    the empty text. A null doc_id is the smallest. Rows of one doc_id and text are one document and fare alike;
    rows of one doc_id with other texts are ordered by start, then by a hash of the text. An empty table gives an empty
    result. Columns named kept_text, n_words or n_removed are replaced; other columns may have any name.
    """
    C.limit_batches(spark)
    docs = docs.drop("kept_text", "n_words", "n_removed")
    keyed = docs.select(C.id_key().alias("idk"), F.xxhash64("text").alias("tkey"), F.xxhash64("doc_id", "text").alias("dkey"), "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(C.shuffle_partitions(spark), total // SLICE_BYTES)
    found, hot, blocks = repeated_anchors(spark, keyed, size, total)
    asked = _zipped(keyed, ["idk", "tkey", "dkey"]).join(found, "dkey")
    windows = candidates(asked.select("idk", "tkey", "z", "hits"), size, slices, blocks, spark.sparkContext.broadcast(hot))
    runs = windows.groupBy("slice").applyInArrow(C.tidy_group(_repeats), RUNS)
    gone = runs.groupBy(F.col("idk").alias("own_idk"), F.col("tkey").alias("own_tkey")).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    # The text goes through the join once: the other columns travel beside it.
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    row = docs.select(others.alias("row"), F.col("text").alias("text"), C.id_key().alias("own_idk"), F.xxhash64("text").alias("own_tkey"))
    joined = _zipped(row, ["row", "own_idk", "own_tkey"]).join(gone, ["own_idk", "own_tkey"], "left").select("row", "z", "lo", "hi")
    schema = T.StructType([row.schema["row"], row.schema["text"], *T.StructType.fromDDL(KEPT)])
    kept = joined.mapInArrow(C.tidy(lambda batches: (part for b in batches for part in _keep(b, size))), schema)
    return kept.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], "kept_text", "n_words", "n_removed")


#: Bytes of text that are decompressed at a time.
KEEP_BYTES = 4_000_000


def _keep(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with what is left of their texts, in parts of about KEEP_BYTES."""
    unzip = zstandard.ZstdDecompressor().decompress
    string = lambda x: pa.array(x, pa.binary()).cast(pa.string())
    texts, out, at, held = [], ([], [], []), 0, 0

    def part(end: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("row").slice(at, end - at), string(texts), string(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["row", "text", "kept_text", "n_words", "n_removed"])

    for i in range(batch.num_rows):
        z, lo, hi = (batch.column(c)[i].as_py() for c in ("z", "lo", "hi"))
        text = None if z is None else unzip(z)
        words = C.words_of(text)
        n, gone = len(words), 0
        if lo:
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, np.array(hi) + size, -1)
            kept = np.cumsum(edge[:-1]) == 0
            gone = n - int(kept.sum())
            words = [words[i] for i in np.flatnonzero(kept)]
        texts.append(text)
        for x, y in zip(out, (b" ".join(words), n, gone), strict=True):
            x.append(y)
        held += len(text or b"")
        if held >= KEEP_BYTES:
            yield part(i + 1)
            texts, out, at, held = [], ([], [], []), i + 1, 0
    if texts or not batch.num_rows:
        yield part(batch.num_rows)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents at windows of 20; nulls, ties, repeats and empty tables as in dedup_substrings."""
    kept = dedup_substrings(spark, C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
     win AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS t
             FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
     late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
     each AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
