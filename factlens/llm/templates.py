"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of templates are matched by
hash, and slots must map one to one, so that a re-parameterised question is found and a chance likeness is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm import common as C

WINDOW = 8
#: Items of fewer tokens than this are too common to tell a leak from chance by their template: they must be there verbatim,
#: and those of fewer than LEAST_INSIDE must be the whole document.
LEAST_WORDS, LEAST_INSIDE = 5, 3
#: Share of an item's tokens under matched, consistent windows from which a document is contaminated.
SHARE = 0.6
#: Literal words that a window needs to match by slots; with fewer it would match anything, so its slots must have equal values.
LITERALS = 0.5
#: Words of a benchmark that is broadcast whole; windows of a larger one are joined by hash, behind a bitmap of so many cells.
BLOCK_WORDS, CELLS = 500_000, (1 << 20, 1 << 29)
#: Documents with findings that are broadcast to mark them; beyond, a shuffle join does it.
BROADCAST_ROWS = 500_000
CACHE = 200_000
#: Unit words and signs. The shorter list has words that are units behind a number only.
UNITS = frozenset("% ° °c °f mm cm m km mi ft in inch inches yd mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph km/h kmh m/s hz khz mhz ghz w kw mw v a j kj cal kcal b kb mb gb tb $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents".split())
AFTER_NUMBER = frozenset("a c f g h in j l m s t v w min second seconds mins day days year years hour hours minute minutes week weeks month months".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
NUMBER = re.compile(r"[+-]?[$€£¥]?\d[\d.,:/]*(?:e[+-]?\d+)?(?:st|nd|rd|th)?%?", re.IGNORECASE)
JOINED = re.compile(r"([+-]?[$€£¥]?\d[\d.,]*)([a-zA-Z°%/]+)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
STOP = re.compile(r"[.,;!?:]['\")\]»”]*$")
WORD, NUM, NAME, UNIT, MAYBE = range(5)
SLOT = np.array([0, *(xxhash.xxh64_intdigest(s) for s in (b"<num>", b"<name>", b"<unit>"))], np.uint64)
VERBATIM = np.uint64(0xC2B2AE3D27D4EB4F)
PUNCTUATION = ".,;:!?\"'()[]"


def kind_of(word: str) -> tuple[int, str]:
    """Kind and value of a word. A name has an upper-case letter before lower-case ones, wherever it stands."""
    bare = word.strip(PUNCTUATION)
    if bare.isalpha():
        low = bare.lower()
        if low in NUMBERS:
            return NUM, low
        if low in UNITS:
            return (MAYBE if low in AFTER_NUMBER else UNIT), low
        return (NAME if bare[0] != low[0] and len(bare) > 1 and not bare.isupper() else WORD), low
    if (low := word.lower().strip(",;")) in UNITS:
        return UNIT, low
    bare = EDGE.sub("", word)
    if not bare:
        return WORD, ""
    low = bare.lower()
    if NUMBER.fullmatch(bare):
        return NUM, low.rstrip(".,:")
    if (m := JOINED.fullmatch(bare)) and m[2].lower() in UNITS:
        return NUM, low
    return (NAME if len(bare) > 1 and bare[0].isupper() and not bare.isupper() else WORD), low


class Words(dict):
    """word bytes -> number of a row of the tables below."""

    def __init__(self):
        super().__init__()
        self.value, self.kind, self.stops = np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)

    def add(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            self.__init__()
            new = list(words)
        if not new:
            return
        texts = b"\n".join(new).decode().split("\n")
        kinds, values = zip(*map(kind_of, texts), strict=True)
        base = len(self.value)
        self.value = np.concatenate((self.value, C.word_hashes([v.encode() for v in values])))
        self.kind = np.concatenate((self.kind, np.array(kinds, np.int8)))
        self.stops = np.concatenate((self.stops, [not t[-1].isalnum() and STOP.search(t) is not None for t in texts]))
        self.update(zip(new, range(base, base + len(new)), strict=True))


class Tokens:
    """Template tokens of several texts (lists of words): a run of names without punctuation between is one token.

    slot: template hash; value: hash of what stands there; kind; ends: where each text ends.
    """

    def __init__(self, known: Words, texts: list[list[bytes]]):
        known.add(set().union(*texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        value, kind = known.value[at], known.kind[at]
        opens = np.zeros(len(at) + 1, bool)
        opens[np.cumsum(sizes) - sizes] = True
        opens = opens[:-1]
        before = np.concatenate(([WORD], kind[:-1]))
        kind = np.where(kind == MAYBE, np.where((before == NUM) & ~opens, UNIT, WORD), kind)
        goes_on = (kind == NAME) & (before == NAME) & ~opens & ~np.concatenate(([True], known.stops[at][:-1]))[: len(at)]
        first = np.flatnonzero(~goes_on)
        of = np.cumsum(~goes_on)
        self.ends = np.concatenate(([0], of))[np.concatenate(([0], np.cumsum(sizes)))]
        self.kind = kind[first]
        place = (np.arange(len(at)) - first[of - 1]).astype(np.uint64) if len(at) else at.astype(np.uint64)
        self.value = C.mix(np.add.reduceat(C.mix(value + place * C.A), first)) if len(first) else np.empty(0, np.uint64)
        self.slot = np.where(self.kind == WORD, self.value, SLOT[self.kind])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows of k tokens, and their hashes: of templates, or of the values where there are few literals."""
        starts = C.starts_in_one_doc(self.ends, k)
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        literal = np.concatenate(([0], np.cumsum(self.kind == WORD)))
        few = literal[starts + k] - literal[starts] < LITERALS * k if k >= LEAST_WORDS else np.ones(len(starts), bool)
        hashes = C.ngrams(self.slot, k)[starts] if not few.all() else np.zeros(len(starts), np.uint64)
        return starts, np.where(few, C.ngrams(C.mix(self.value ^ VERBATIM), k)[starts], hashes) if few.any() else hashes


def _blocks(texts: list) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words) of texts, some at a time."""
    held, n, base = [], 0, 0
    for i, t in enumerate(texts):
        held.append(C.words_of(t))
        n += len(held[-1])
        if n >= C.BLOCK_WORDS or i == len(texts) - 1:
            yield base, held
            held, n, base = [], 0, i + 1


def share_found(hits: list[tuple[int, int]], k: int, kinds: list[int], values: list[int], there: dict[int, int]) -> tuple[float, bool]:
    """(share of an item's tokens found, whether a slot has another value), for hits (place in the item, position in the text).

    Windows count together that lie near one alignment, up to a quarter of the item apart, so that words may have been put in or left
    out, but fragments at other places of a text do not add up. All of them have one map of slots: a value of the item stands
    for one of the text, and the other way round. Alignments of more windows go first; what does not fit the map is left.
    """
    by: dict[int, set[int]] = {}
    for place, at in hits:
        by.setdefault(at - place, set()).add(place)
    shifts, groups = sorted(by), []
    for s in shifts:
        if groups and s - groups[-1][-1] <= max(4, len(kinds) // 4) and s - groups[-1][0] <= max(4, len(kinds) // 2):
            groups[-1].append(s)
        else:
            groups.append([s])
    best = (0.0, False)
    for group in groups:
        one: dict[int, int] = {}
        back: dict[int, int] = {}
        covered: set[int] = set()
        changed = False
        for s in sorted(group, key=lambda s: (-len(by[s]), s)):
            for place in sorted(by[s]):
                more, less = {}, {}
                pairs = [(values[p], there[p + s]) for p in range(place, place + k) if kinds[p] != WORD]
                for a, b in pairs:
                    if one.get(a, more.get(a, b)) != b or back.get(b, less.get(b, a)) != a:
                        break
                    more[a], less[b] = b, a
                else:
                    one |= more
                    back |= less
                    covered.update(range(place, place + k))
                    changed = changed or any(a != b for a, b in pairs)
        best = max(best, (len(covered) / len(kinds), changed))
    return best


class Benchmark:
    """Template windows of items, by hash: hash -> (item, place)."""

    def __init__(self, items: list[tuple[int, str | None]]):
        known = Words()
        self.items: list[tuple] = []
        self.sizes: set[int] = set()
        self.at: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (words := C.words_of(text.encode() if text is not None else None)):
                continue
            t = Tokens(known, [words])
            k = min(WINDOW, len(t.kind))
            self.sizes.add(k)
            for place, w in zip(*(x.tolist() for x in t.windows(k)), strict=True):
                self.at.setdefault(w, []).append((len(self.items), place))
            self.items.append((item_id, k, t.kind.tolist(), t.value.tolist()))
        self.hashes = np.array(sorted(self.at), np.uint64)

    def match(self, t: Tokens) -> dict[int, list[tuple]]:
        """Text -> (item_id, share of its tokens found, whether a slot has another value)."""
        hits: dict[tuple[int, int], list] = {}
        for k in sorted(self.sizes):
            starts, g = t.windows(k)
            near = np.searchsorted(self.hashes, g)
            near[near == len(self.hashes)] = 0
            found = np.flatnonzero(self.hashes[near] == g)
            docs = np.searchsorted(t.ends, starts[found], side="right") - 1
            for d, s, w in zip(docs.tolist(), starts[found].tolist(), g[found].tolist(), strict=True):
                for i, place in self.at[w]:
                    if self.items[i][1] == k:
                        hits.setdefault((d, i), []).append((place, s))
        out: dict[int, list[tuple]] = {}
        for (d, i), own in sorted(hits.items()):
            item_id, k, kinds, values = self.items[i]
            if len(kinds) < LEAST_INSIDE and t.ends[d + 1] - t.ends[d] > len(kinds):
                continue
            there = {p: int(t.value[p]) for _, s in own for p in range(s, s + k)}
            out.setdefault(d, []).append((item_id, *share_found(own, k, kinds, values, there)))
        return out


FOUND = "contaminated boolean, item_ids array<bigint>, best_share double, re_parameterised boolean"
FOUND_NAMES = ("contaminated", "item_ids", "best_share", "re_parameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` (doc_id, text, ...) with contaminated, item_ids, best_share, re_parameterised added.

    A document is contaminated by the items of `benchmark` (item_id, text) of which it holds at least `share` of the
    template tokens in matched windows of one map of slots. re_parameterised: such an item has another number, name or unit there.
    Items of three or four tokens must be there verbatim, those of one or two be the whole document. Null and empty items match
    nothing; a null or empty document holds nothing; an empty benchmark finds nothing. Repeated rows fare alike; repeated items
    (id and text) are one, other equal texts are all listed, those without an id are not but count. Columns of those names are replaced.
    """
    C.limit_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= 6 * block_words:
        out = _by_lookup(docs, Benchmark([tuple(r) for r in items.collect()]), share)
    else:
        out = _by_join(docs, items, share)
    best = F.coalesce("best_share", F.lit(0.0))
    added = {"contaminated": (best >= share) & (best > 0), "item_ids": F.coalesce("item_ids", F.array().cast("array<bigint>")), "best_share": best, "re_parameterised": F.coalesce("re_parameterised", F.lit(False))}
    return out.withColumns(added).select(*[F.col(f"`{c}`") for c in docs.columns if c not in FOUND_NAMES], *FOUND_NAMES)


def _summed(found: list[tuple], share: float) -> tuple[list, float, bool]:
    hits = [x for x in found if x[1] >= share]
    return sorted(x[0] for x in hits if x[0] is not None), max((x[1] for x in found), default=0.0), any(x[2] for x in hits)


def _by_lookup(docs: DataFrame, bench: Benchmark, share: float) -> DataFrame:
    """Findings by a benchmark of checked size in every task."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def start():
        known, bench = Words(), shared.value

        def judge(texts: list) -> list:
            rows = [([], 0.0, False)] * len(texts)
            if len(bench.hashes):
                for base, words in _blocks(texts):
                    for d, found in bench.match(Tokens(known, words)).items():
                        rows[base + d] = _summed(found, share)
            ids, best, changed = zip(*rows, strict=True) if rows else ((), (), ())
            return [pa.array(list(ids), pa.list_(pa.int64())), list(best), list(changed)]

        return judge

    return C.add_columns(docs, start, "item_ids array<bigint>, best_share double, re_parameterised boolean")


ITEM = "hash long, item long, item_id long, place int, k int, kinds binary, item_values binary"
HIT = "hash long, idk long, tkey long, position int, tokens long, doc_values binary"


def _by_join(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """Findings by a hash join of the windows of documents and items; a bitmap of the items' windows, of bounded size, goes before it."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "templates")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in ITEM.split(", ")}
            for item, item_id, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
                if words := C.words_of(text):
                    t = Tokens(known, [words])
                    k = min(WINDOW, len(t.kind))
                    for place, w in zip(*(x.tolist() for x in t.windows(k)), strict=True):
                        for c, v in zip(out.values(), (w - (w >> 63 << 64), item, item_id, place, k, t.kind.astype(np.int8).tobytes(), t.value.tobytes()), strict=True):
                            c.append(v)
            yield C.record(ITEM, **out)

    windows = scratch.write(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(item_windows, ITEM), "items")
    width = C.pow2(16 * windows.count(), *CELLS)
    sizes = [r.k for r in windows.select("k").distinct().collect()]  # WINDOW at most

    def bits(t: pa.Table) -> pa.Table:
        own = np.zeros(1 << 20, bool)
        own[t.column("cell").to_numpy() & (1 << 20) - 1] = True
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    cells = windows.select(F.pmod("hash", F.lit(width)).alias("cell")).distinct().withColumn("block", F.shiftright("cell", 20))
    bitmap = np.zeros(width // 8, np.uint8)
    for r in cells.groupBy("block").applyInArrow(bits, "block long, bits binary").toLocalIterator():
        bitmap[r.block << 17 : r.block + 1 << 17] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def document_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Words(), shared.value
        for batch in batches:
            idk, tkey = (batch.column(c).to_pylist() for c in ("idk", "tkey"))
            for base, words in _blocks(C.as_bytes(batch.column("text"))):
                t = Tokens(known, words)
                out: dict[str, list] = {c.split()[0]: [] for c in HIT.split(", ")}
                for k in sizes:
                    starts, g = t.windows(k)
                    cell = g & np.uint64(width - 1)
                    ok = np.flatnonzero(own[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & 1)
                    docs_ = np.searchsorted(t.ends, starts[ok], side="right") - 1
                    for d, s, w in zip(docs_.tolist(), starts[ok].tolist(), g[ok].astype(np.int64).tolist(), strict=True):
                        row = (w, idk[base + d], tkey[base + d], s - int(t.ends[d]), int(t.ends[d + 1] - t.ends[d]), t.value[s : s + k].tobytes())
                        for c, v in zip(out.values(), row, strict=True):
                            c.append(v)
                yield C.record(HIT, **out)

    # Repeated rows are one document here.
    hits = docs.select(C.id_key().alias("idk"), F.xxhash64("text").alias("tkey"), "text").mapInArrow(C.tidy(document_windows), HIT)
    pairs = hits.join(windows, "hash").filter("length(doc_values) = 8 * k")
    each = pairs.groupBy("idk", "tkey", "item").applyInArrow(_item_found, "idk long, tkey long, item_id long, share double, changed boolean")
    good = F.col("share") >= share
    found = scratch.write(each.groupBy("idk", "tkey").agg(F.array_sort(F.collect_list(F.when(good, F.col("item_id")))).alias("item_ids"), F.max("share").alias("best_share"), F.max(good & F.col("changed")).alias("re_parameterised")), "found")
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    plain = docs.drop(*FOUND_NAMES)
    row = plain.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in plain.columns]).alias("row"), C.id_key().alias("idk"), F.xxhash64("text").alias("tkey"))
    joined = row.join(found, ["idk", "tkey"], "left")
    return joined.select(*[F.col(f"row.`{c}`") for c in plain.columns], "item_ids", "best_share", "re_parameterised")


def _item_found(t: pa.Table) -> pa.Table:
    """What one document holds of one item."""
    first = {c: t.column(c)[0].as_py() for c in ("idk", "tkey", "item_id", "k", "kinds", "item_values", "tokens")}
    k, kinds, values = first["k"], np.frombuffer(first["kinds"], np.int8).tolist(), np.frombuffer(first["item_values"], "<u8").tolist()
    there: dict[int, int] = {}
    hits = list(zip(t.column("place").to_pylist(), t.column("position").to_pylist(), strict=True))
    for (_, s), raw in zip(hits, t.column("doc_values").to_pylist(), strict=True):
        there.update(zip(range(s, s + k), np.frombuffer(raw, "<u8").tolist(), strict=True))
    got, changed = share_found(hits, k, kinds, values, there) if len(kinds) >= LEAST_INSIDE or first["tokens"] == len(kinds) else (0.0, False)
    return pa.Table.from_batches([C.record("idk long, tkey long, item_id long, share double, changed boolean", idk=[first["idk"]], tkey=[first["tkey"]], item_id=[first["item_id"]], share=[got], changed=[changed])])


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of benchmark; nulls, ties, repeats and empty tables as in decontaminate."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, C.table(spark, sf_dir, "benchmark")).drop("text")
