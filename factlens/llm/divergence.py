"""Divergence of the sources of a language: terms of byte-level tokens, counted per source, compared in integers.

A block of documents is one UTF-8 buffer. A table over byte values lower-cases and finds the bounds of terms; slices are grouped by
xxhash and compared byte for byte with the first of their group. A sparse matrix of documents and terms gives counts and document
counts per source, which a task sums before it sends them. Terms are then dealt out by hash; each task holds its terms as one sparse
row a source, and sums divergences over rows with reduceat. What no row holds (terms absent from a source) has one value a source,
so it is added as a product and never expanded. Sums of all tasks make the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm import common as C

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes of text that are one block, and entries that a task sums before it sends them.
BLOCK_BYTES, HELD = 6_000_000, 2_000_000
#: Entries that are dealt to one task, and sources that it compares the others with at a time.
SLICE, SOURCES = 400_000, 64

#: Byte -> its lower case in a term, 0 between terms: ASCII letters and all bytes of other characters are in terms.
FOLD = np.zeros(256, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)

COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, and of each cell of the matrix its document, term and count), by document and term."""
    low = FOLD[np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)]
    starts_of_docs = np.cumsum([1] + [len(t) + 1 for t in texts])
    edge = np.diff((low != 0).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(starts):
        none = np.empty(0, np.int64)
        return [], none, none, none
    raw, digest = low.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, term = np.unique(h, return_index=True, return_inverse=True)
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    for i in _unequal(low, starts, ends, first[term]).tolist():  # two terms of one hash
        if (t := raw[starts[i] : ends[i]]) not in terms[len(first) :]:
            terms.append(t)
        term[i] = len(first) + terms[len(first) :].index(t)
    doc = np.searchsorted(starts_of_docs, starts, side="right") - 1
    cell, n = np.unique(doc * len(terms) + term, return_counts=True)
    return terms, cell // len(terms), cell % len(terms), n


def _unequal(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, step: int = 200_000) -> np.ndarray:
    """The slices whose bytes are not those of the first slice of their hash."""
    size, out = ends - starts, [np.flatnonzero(ends - starts != ends[first] - starts[first])]
    same = np.flatnonzero((ends - starts == ends[first] - starts[first]) & (first != np.arange(len(first))))
    for i in range(0, len(same), step):
        part = same[i : i + step]
        n = size[part]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = low[np.repeat(starts[part], n) + within] != low[np.repeat(starts[first[part]], n) + within]
        out.append(part[np.add.reduceat(differ, np.cumsum(n) - n) > 0])
    return np.concatenate(out)


def count_terms(docs: DataFrame, held: int = HELD, block: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, in parts that are still to be summed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        terms: dict[bytes, int] = {}
        keys, counts, many, full = [], [], 0, False
        waiting: tuple[list, list] = ([], [])

        def add():
            nonlocal many, full
            found, doc, term, n = terms_of(waiting[0])
            code = np.array([terms.setdefault(t, len(terms)) for t in found], np.int64)
            key = np.array(waiting[1], np.int64)[doc] << 40 | code[term]
            waiting[0].clear()
            waiting[1].clear()
            keys.append(key)
            counts.append(np.stack((n, np.ones_like(n))))
            many += len(key)
            if many > held:
                _, k, c = _sums(keys, counts)
                keys[:], counts[:], many, full = [k], [c], len(k), len(k) > held // 2

        def send():
            nonlocal many, full
            if keys:
                _, k, c = _sums(keys, counts)
                names, words = [*groups], [*terms]
                for at in range(0, len(k), 100_000):
                    group, term = k[at : at + 100_000] >> 40, (k[at : at + 100_000] & ((1 << 40) - 1)).tolist()
                    langs, sources = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([langs, sources, pa.array([words[t] for t in term], pa.binary()).cast(pa.string()), pa.array(c[0, at : at + 100_000]), pa.array(c[1, at : at + 100_000])], names=["lang", "source", "term", "n", "docs"])
            keys.clear()
            counts.clear()
            terms.clear()
            many, full = 0, False

        n = 0
        for batch in batches:
            for lang, source, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
                waiting[0].append(t or b"")
                waiting[1].append(groups.setdefault((lang, source), len(groups)))
                n += len(t or b"")
                if n >= block:
                    add()
                    n = 0
                    if full:
                        yield from send()
        if waiting[0]:
            add()
        yield from send()

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(C.tidy(read), COUNTS)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places, keys, counts) with the counts of equal keys summed."""
    key, count = np.concatenate(keys), np.concatenate(counts, axis=1)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[:, order]
    if not len(key):
        return order, key, count
    first = C.segments(key[1:] != key[:-1])
    return first, key[first], np.add.reduceat(count, first, axis=1)


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exact while the divisor is below 9 * 10^15: three steps of long division."""
    by = total + terms
    out, rest = np.divmod(count + 1, by)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


PARTS = "lang string, source string, part string, item string, value long"


def _slice(t: pa.Table, top: int) -> pa.Table:
    """Of one slice of terms: divergences of all sources from those of one block summed over the slice, and the leading terms of those sources."""
    col = {c: t.column(c).to_pylist() for c in ("lang", "source", "term", "held")}
    num = {c: t.column(c).to_numpy() for c in ("n", "lang_n", "total", "lang_total", "terms")}
    langs: dict[str, tuple[list, list]] = {}
    for i, (lang, term) in enumerate(zip(col["lang"], col["term"], strict=True)):
        langs.setdefault(lang, ([], []))[term is not None].append(i)
    out: dict[str, list] = {c.split()[0]: [] for c in PARTS.split(", ")}

    def put(lang, source, part, item, value):
        for c, v in zip(out.values(), ([lang] * len(item), source, [part] * len(item), item, value), strict=True):
            c.extend(v)

    for lang, (groups, entries) in langs.items():
        # All sources of the language, with or without terms here; `held` marks those of this block.
        names = sorted({col["source"][i] for i in groups})
        at = {s: k for k, s in enumerate(names)}
        total, held = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for i in groups:
            k = at[col["source"][i]]
            total[k], held[k] = num["total"][i], held[k] or col["held"][i]
        terms, lang_total = num["terms"][groups[0]], num["lang_total"][groups[0]]
        if not entries:
            continue
        e = np.array(entries)
        words, column = np.unique(np.array([col["term"][i].encode() for i in entries], dtype=object), return_inverse=True)
        row = np.array([at[col["source"][i]] for i in entries])
        order = np.lexsort((column, row))
        e, row, column = e[order], row[order], column[order]
        starts = np.searchsorted(row, np.arange(len(names) + 1))
        p, none = share(num["n"][e], total[row], terms), share(np.zeros(len(names), np.int64), total, terms)
        filled, width = np.flatnonzero(np.diff(starts)), len(words)
        for k in np.flatnonzero(held).tolist():
            mine = slice(starts[k], starts[k + 1])
            q = np.full(width, none[k])
            q[column[mine]] = p[mine]
            # Entries of each source, in place of what its absent terms would give; then all terms as if absent.
            absent = np.zeros(len(names), np.int64)
            for block in range(0, starts[k + 1] - starts[k], 4096):
                absent += gap(none[:, None], p[mine][block : block + 4096]).sum(axis=1)
            absent += gap(none, none[k]) * (width - (starts[k + 1] - starts[k]))
            over = gap(p, q[column]) - gap(none[row], q[column])
            absent[filled] += np.add.reduceat(over, starts[filled])
            others = [j for j in range(len(names)) if j != k]
            put(lang, [names[j] for j in others], "pair", [names[k]] * len(others), absent[others].tolist())
            own = share(num["lang_n"][e[mine]], lang_total, terms)
            more = np.flatnonzero(p[mine] > own)
            value = gap(p[mine][more], own[more])
            # Columns are in UTF-8 order, so a stable sort keeps ties by item.
            best = np.argsort(-value, kind="stable")[:top]
            put(lang, [names[k]] * len(best), "term", [words[j].decode() for j in column[mine][more][best].tolist()], value[best].tolist())
    return pa.table({c: pa.array(v, C.KINDS["long" if c == "value" else "string"]) for c, v in out.items()})


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_rows: int = SLICE, sources: int = SOURCES, held: int = HELD, block: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are from each other, and by which terms.

    Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII. A language keeps the terms in at least
    `least_docs` of its rows. Part `pair` has a row for each other source, part `term` the `top` kept terms that the source has more of
    than the language. Null text, lang and source are read as ''. Repeated rows count as rows of their own. A language without
    kept terms gives pairs of value 0, one with one source none; an empty table gives no rows. Ties rank by item, in UTF-8 order.
    Other columns are not read. Values are exact while a source has fewer than 9 * 10^15 kept terms.
    """
    scratch = C.Scratch(spark, "divergence")
    counts = scratch.write(count_terms(docs, held, block).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("all_docs")).filter(F.col("all_docs") >= least_docs).drop("all_docs")
    kept_terms = scratch.write(kept_terms, "terms")
    kept = scratch.write(counts.join(kept_terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    many = kept.count()
    slices, blocks = max(1, -(-many // slice_rows)), 1
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept_terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = named.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = scratch.write(groups, "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // sources))
    # Every task gets all sources, which are no more than what it returns, and the terms of its slice. `held`: it compares with this source.
    cells = F.explode(F.expr(f"sequence(0L, {slices * blocks - 1}L)")).alias("cell")
    own = F.pmod(F.xxhash64("source"), F.lit(blocks))
    everywhere = groups.select("*", cells).select("cell", "lang", "source", F.lit(None).cast("string").alias("term"), (own == F.pmod("cell", F.lit(blocks))).alias("held"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "total", "lang_total", "terms")
    dealt = kept.select("*", F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).alias("slice")).select("*", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"))
    zero = F.lit(0).cast("long")
    dealt = dealt.select((F.col("slice") * blocks + F.col("b")).alias("cell"), "lang", "source", "term", F.lit(False).alias("held"), "n", "lang_n", zero.alias("total"), zero.alias("lang_total"), zero.alias("terms"))
    parts = everywhere.unionByName(dealt).groupBy("cell").applyInArrow(C.tidy_group(lambda t: _slice(t, top)), PARTS)
    parts = scratch.write(parts, "parts")
    # A language without kept terms has its pairs too.
    bare = groups.filter("terms = 0")
    pairs = bare.alias("a").join(bare.select("lang", F.col("source").alias("item")).alias("b"), "lang").filter("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", zero.alias("value"))
    summed = parts.filter("part = 'pair'").unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    leading = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return summed.withColumn("rank", rank).unionByName(leading)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all documents' sources by language; nulls, ties, repeats and empty tables as in audit."""
    return audit(spark, C.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
     k AS (SELECT lang, t, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
     v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     gc AS (SELECT o.lang, o.source, o.t, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.t = k.t GROUP BY ALL),
     g AS (SELECT lang, source, coalesce(any_value(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM gc GROUP BY ALL) USING (lang, source) GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.t, coalesce(gc.c, 0) AS c,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(gc.c, 0) + 1)) // (g.n + v.v) AS HUGEINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.c + 1)) // (v.n + v.v) AS HUGEINT) AS q
           FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.t = k.t),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source != b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, t AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
