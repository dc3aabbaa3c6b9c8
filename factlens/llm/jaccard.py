"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

Documents with equal shingle sets form a class at once. The global order of shingles is (frequency class
from merged partition sketches, hash): rare ones first. Two sets that link share one of the rarest shingles
of each (the prefix), so a class sends only those, and classes that share one are candidates, listed under the
least class of that list. The order is cut into FRAGMENTS of near equal use, and every set with it: a task gets the
pieces of one fragment alone and counts partial overlaps; they are shuffled and summed per pair, and the sums
decide. No task sees a whole set. A piece that overlaps too little for its pair to
reach the bound sends nothing, nor does one whose whole sets cannot share enough by the counts of their keys' last bits.
A group of few candidates counts all its pairs, SMALL / 2 a member at most. In larger ones all are counted against few partners
first (the least class, then others), and pairs of one component are not counted, so a large group of near copies costs a few
counts a member and not all its pairs; what is then left in other components, or is a few pairs a member to begin with, is counted, every pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm.components import components

FRAGMENTS = 4
#: Cells of the frequency sketch; what is broadcast is a byte a cell, 8 MB at most. Shingles rarer than one in so many are
#: not told apart by it; they are ordered by hash, so that only the lengths of lists depend on the sketch.
CELLS = (1 << 12, 1 << 23)
CLASS_SHIFT = np.uint64(58)
#: A block holds about so many classes and shingles; a larger group is split.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 4_000_000
#: Groups of so many classes count all their pairs at once.
SMALL = 32
#: While more pairs than this are open for each class of the larger groups, and get fewer, further partners are tried before all are
#: counted: HUBS in the largest component of a group and as many outside, STARS times at most.
OPEN_PAIRS, HUBS, STARS = 8, 8, 5
#: With fewer classes in larger groups the pairs of so many are counted all the same, once a turn of further partners has joined what
#: links densely: that takes less time than further turns. Without that turn a group of near copies would make links by the square of its size.
FEW_CLASSES = 125_000
#: Candidate (class, block) pairs that are broadcast to fetch texts; beyond, a shuffle join does it.
BROADCAST_ROWS = 500_000
FLUSH = 400_000
UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())


def _fold(t: bytes) -> bytes:
    return t.translate(FOLD)


def _sets(batches: Iterator[pa.RecordBatch], cols: list[str], k: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every document; a text of fewer than k words is one shingle."""
    for rows, h, offsets in C.blocks(batches, cols, fold=_fold):
        runs = C.ngrams(h, k)
        for row, a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                yield row, np.unique(runs[a : b - k + 1])
            else:
                yield row, C.ngrams(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _set_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return b"".join(int(x).to_bytes(8, "big") for x in (C.mix(s).sum(), C.mix(s ^ C.A).sum() ^ np.uint64(len(s))))


READ = "kind int, doc_id long, tkey long, n long, sid binary, slice int, cells binary, counts binary"


def read_sets(docs: DataFrame, k: int, width: int) -> DataFrame:
    """kind 0: doc_id, set size, set id (null: empty set) of a document. kind 1: parts of the frequency sketch."""

    def read(batches):
        count, n, out, held, waiting = np.zeros(width, np.uint32), 0, ([], [], [], []), [], 0

        def add():
            nonlocal waiting
            if not held:
                return
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            count[cells] += times.astype(np.uint32)
            held.clear()
            waiting = 0

        def sketch():
            for at in range(0, width, C.pow2(width, 1, 1 << 16)):
                part = count[at : at + (1 << 16)]
                cells = np.flatnonzero(part)
                if len(cells):
                    yield C.record(READ, kind=[1], doc_id=[None], tkey=[None], n=[None], sid=[None], slice=[at >> 16], cells=[cells.astype("<u2").tobytes()], counts=[part[cells].astype("<u4").tobytes()])

        for row, s in _sets(batches, ["doc_id", "tkey"], k):
            for x, y in zip(out, (*row, len(s), _set_id(s) if len(s) else None), strict=True):
                x.append(y)
            held.append((s % np.uint64(width)).astype(np.uint32))
            waiting += len(s)
            if waiting >= 2_000_000:
                add()
            n += len(s)
            if len(out[0]) >= 2000:
                yield _light(out)
                out = ([], [], [], [])
        yield _light(out)
        if n:
            add()
            yield from sketch()

    return docs.mapInArrow(C.tidy(read), READ)


def _light(out) -> pa.RecordBatch:
    none = [None] * len(out[0])
    return C.record(READ, kind=[0] * len(none), doc_id=out[0], tkey=out[1], n=out[2], sid=out[3], slice=none, cells=none, counts=none)


def frequency_classes(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency class (log2 of the merged count) of every cell, and the fragments' bounds in the global order."""

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.int64)
        for cells, counts in zip(t.column("cells").to_pylist(), t.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")
        level = np.zeros(1 << 16, np.uint8)
        level[total > 0] = np.log2(total[total > 0]).astype(np.uint8)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary()), "used": pa.array([np.bincount(level, weights=total, minlength=64).astype("<i8").tobytes()], pa.binary())})

    levels, used = np.zeros(max(width, 1 << 16), np.uint8), np.zeros(64)
    # A byte a cell, as they are broadcast: one job, not one for each shuffle partition.
    for r in parts.groupBy("slice").applyInArrow(merge, "slice int, level binary, used binary").collect():
        levels[r.slice << 16 : (r.slice + 1) << 16] = np.frombuffer(r.level, np.uint8)
        used += np.frombuffer(r.used, "<i8")
    return levels[:width], _bounds(used)


def _bounds(used: np.ndarray) -> np.ndarray:
    """Order keys that cut the global order into FRAGMENTS of near equal use."""
    total, run, out = float(used.sum()), np.concatenate(([0.0], np.cumsum(used))), [0]
    for i in range(1, FRAGMENTS):
        c = int(np.clip(np.searchsorted(run, total * i / FRAGMENTS, side="right") - 1, 0, 63))
        part = (total * i / FRAGMENTS - run[c]) / used[c] if used[c] else 0.0
        out.append((c << 58) + int(part * ((1 << 58) - 1)))
    return np.array([*out, (1 << 64) - 1], dtype=np.uint64)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set as sorted keys of the global order."""
    level = levels[(s % np.uint64(len(levels))).astype(np.int64)].astype(np.uint64)
    return np.sort((level << CLASS_SHIFT) | (s >> np.uint64(6)))


PREFIX = "slice int, token binary, place binary, at binary, size binary, sids binary"


def prefixes(docs: DataFrame, k: int, percent: int, levels, slices: int) -> DataFrame:
    """The prefix shingles of every class, per slice; each task sends a class once."""

    def search(batches):
        level, seen, sids, sizes, toks, owner, places, n = levels.value, set(), [], [], [], [], [], 0

        def flush():
            tok, own, place = np.concatenate(toks), np.concatenate(owner), np.concatenate(places)
            to = (C.mix(tok) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            tok, own, place, to = tok[order], own[order], place[order].astype("<i4"), to[order]
            size, first = np.array(sizes, "<i8"), C.segments(to[1:] != to[:-1])
            cols = {c: [] for c in ("slice", "token", "place", "at", "size", "sids")}
            for a, b in zip(first, np.append(first[1:], len(to)), strict=True):
                mine, code = np.unique(own[a:b], return_inverse=True)
                for c, x in zip(cols, (int(to[a]), tok[a:b].tobytes(), place[a:b].tobytes(), code.astype("<i4").tobytes(), size[mine].tobytes(), b"".join(sids[i] for i in mine)), strict=True):
                    cols[c].append(x)
            return C.record(PREFIX, **cols)

        for _, s in _sets(batches, ["doc_id"], k):
            if 100 * len(s) < percent * (len(s) + 1) or (sid := _set_id(s)) in seen:
                continue
            seen.add(sid)
            keys = ordered(s, level)
            p = len(s) - -(-percent * len(s) // 100) + 1
            owner.append(np.full(p, len(sids)))
            toks.append(keys[:p])
            places.append(np.arange(p))
            sids.append(sid)
            sizes.append(len(s))
            n += p
            if n >= FLUSH:
                yield flush()
                seen, sids, sizes, toks, owner, places, n = set(), [], [], [], [], [], 0
        if n:
            yield flush()

    return docs.mapInArrow(C.tidy(search), PREFIX)


def _lists(t: pa.Table, percent: int) -> pa.Table:
    """(leader, member) classes of the lists of one slice, cut where sizes are too far apart to link.

    Two sets that link have their first common shingle in some list, and share no more than what follows it in
    either. So a set leaves a list where less follows than it needs with the smallest partner there.
    """
    get = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
    sizes, sids = get("size", "<i8"), get("sids", ">u8")
    base = np.cumsum([0] + [len(x) for x in sizes])
    at = np.concatenate([x + b for x, b in zip(get("at", "<i4"), base, strict=False)])
    place = np.concatenate(get("place", "<i4"))
    tok, size, sid = np.concatenate(get("token", "<u8")), np.concatenate(sizes)[at], np.concatenate(sids).reshape(-1, 2)[at].astype(np.uint64)
    order = np.lexsort((size, tok))
    tok, size, sid = tok[order], size[order], sid[order]
    cut = np.concatenate(([True], (tok[1:] != tok[:-1]) | (100 * size[:-1] < percent * size[1:])))
    group = np.cumsum(cut)
    least = np.maximum(size[np.flatnonzero(cut)][group - 1], -(-percent * size // 100))
    ok = size - place[order] >= -(-percent * (size + least) // (100 + percent))
    group, sid = group[ok], sid[ok]
    if not len(group):
        return pa.table({"leader": pa.array([], pa.binary()), "sid": pa.array([], pa.binary())})
    order = np.lexsort((sid[:, 1], sid[:, 0], group))
    group, sid = group[order], sid[order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (sid[1:] != sid[:-1]).any(axis=1)))
    group, sid = group[new], sid[new]
    first = C.segments(group[1:] != group[:-1])
    many = np.diff(np.append(first, len(group)))
    leader, keep = np.repeat(sid[first], many, axis=0), np.repeat(many > 1, many)
    rows = np.unique(np.concatenate((leader, sid), axis=1)[keep], axis=0).astype(">u8")
    raw = rows.tobytes()
    return pa.table({"leader": pa.array([raw[i : i + 16] for i in range(0, len(raw), 32)], pa.binary()), "sid": pa.array([raw[i + 16 : i + 32] for i in range(0, len(raw), 32)], pa.binary())})


PIECES = "task int, hub binary, block long, fragment int, role int, comp binary, sid binary, n long, size int, tokens binary, shape binary"


#: Counts of a set's keys by their last bits, sent along where many pairs are counted: they bound what two sets can share.
SHAPE = 256


def fetch(docs: DataFrame, k: int, levels, bounds: np.ndarray, tasks: int, shaped: bool) -> DataFrame:
    """The sets of the classes asked for (sid, targets), cut at the bounds: a row for each fragment and target."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def search(batches):
        level, seen, out, n = levels.value, set(), {c: [] for c in names}, 0
        for (sid, targets, comp), s in _sets(batches, ["sid", "targets", "comp"], k):
            if sid in seen or _set_id(s) != sid:
                continue  # a repeated row, or another text of the same doc_id
            seen.add(sid)
            keys = ordered(s, level)
            cuts = np.searchsorted(keys, bounds[1:-1]).tolist()
            shape = np.bincount((keys & np.uint64(SHAPE - 1)).astype(np.int64), minlength=SHAPE).astype("<u4").tobytes() if shaped else b""
            for f, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
                raw = keys[a:b].tobytes()
                for t in targets:
                    task = hash((int.from_bytes(t["hub"], "big"), t["block"], f)) % tasks
                    for c, v in zip(names, (task, t["hub"], t["block"], f, t["role"], comp, sid, len(keys), b - a, raw, shape), strict=True):
                        out[c].append(v)
                    n += len(raw) + 100
                    if n > 8_000_000:
                        yield C.record(PIECES, **out)
                        out, n = {c: [] for c in names}, 0
        yield C.record(PIECES, **out)

    return docs.mapInArrow(C.tidy(search), PIECES)


PARTIAL = "a binary, b binary, fragment int, na long, nb long, overlap long"


def overlaps(piece: np.ndarray, others: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many keys of each of `others` (concatenated; ends[i]: where the i-th ends) are in `piece`."""
    if not len(piece) or not len(others):
        return np.zeros(len(ends), np.int64)
    at = np.searchsorted(piece, others)
    at[at == len(piece)] = 0
    hits = np.concatenate(([0], np.cumsum(piece[at] == others)))
    return np.diff(hits[np.concatenate(([0], ends))])


def _partial(t: pa.Table, percent: int) -> pa.Table:
    """Partial overlaps of one task's fragments: of role 1 with role 2 in a block, where the components differ."""
    groups: dict = {}
    for hub, block, fragment, *row in zip(*(t.column(c).to_pylist() for c in ("hub", "block", "fragment", "sid", "role", "comp", "n", "size", "tokens", "shape")), strict=True):
        groups.setdefault((hub, block, fragment), {}).setdefault(row[0], row)  # several texts may have the set
    out: dict[str, list] = {c.split()[0]: [] for c in PARTIAL.split(", ")}
    for (_, _, fragment), rows in groups.items():
        sid, role, comp, n, size, tokens, shape = map(list, zip(*sorted(rows.values(), key=lambda r: (r[3], r[0])), strict=True))
        label: dict = {}
        comp = np.array([label.setdefault(c or x, i) for i, (c, x) in enumerate(zip(comp, sid, strict=True))])
        n, size, role = np.array(n), np.array(size), np.array(role)
        keys, ends = np.frombuffer(b"".join(tokens), "<u8"), np.cumsum(size)
        shapes = np.frombuffer(b"".join(shape), "<u4").reshape(len(sid), -1)
        for x in np.flatnonzero(role & 1).tolist():
            lo, hi = np.searchsorted(n, (-(-percent * n[x] // 100), 100 * n[x] // percent + 1))  # sizes that can link
            near = np.arange(lo, hi)
            near = near[(role[lo:hi] & 2 > 0) & (comp[lo:hi] != comp[x]) & ((role[lo:hi] != 3) | (role[x] != 3) | (near > x))]
            need = -(-percent * (n[near] + n[x]) // (100 + percent))
            if len(near) and shapes.shape[1]:
                able = np.minimum(shapes[near], shapes[x]).sum(axis=1) >= need
                near, need = near[able], need[able]
            if not len(near):
                continue
            whole = len(near) == hi - lo
            others = keys[ends[lo] - size[lo] : ends[hi - 1]] if whole else np.concatenate([keys[ends[y] - size[y] : ends[y]] for y in near])
            got = overlaps(keys[ends[x] - size[x] : ends[x]], others, np.cumsum(size[near]))
            # What this fragment can add at most is in the sum already if all other fragments overlap in full.
            ok = (got > 0) & (got + np.minimum(n[near] - size[near], n[x] - size[x]) >= need)
            for y, c in zip(near[ok].tolist(), got[ok].tolist(), strict=True):
                for col, v in zip(out.values(), (sid[x], sid[y], fragment, int(n[x]), int(n[y]), c), strict=True):
                    col.append(v)
    return pa.Table.from_batches([C.record(PARTIAL, **out)])


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, broadcast_rows: int = BROADCAST_ROWS, open_pairs: int = OPEN_PAIRS, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text): see components_of."""
    more = {"block_sets": block_sets, "broadcast_rows": broadcast_rows, "open_pairs": open_pairs, "small": small}
    return components_of(spark, docs, k, percent, **more).select("doc_id", "n_shingles", "component_id")


def components_of(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, broadcast_rows: int = BROADCAST_ROWS, open_pairs: int = OPEN_PAIRS, small: int = SMALL) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, root) of every row of `docs` (doc_id, text): components of the links J >= percent / 100.

    Sets are distinct k-word shingles of the A-Z-lower-cased words; fewer words are one shingle; a null, empty or
    blank text has the empty set, links with nothing and is its own component. component_id is the smallest doc_id
    of the component (a null doc_id is passed over; null if all are). Repeated rows give repeated results. An
    empty table gives an empty result. Other columns are not read. tkey: xxhash64 of the text; root: the class that stands for the
    component, null for the empty set.
    """
    scratch = C.Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    width = C.pow2(total / 6 / 128, *CELLS)
    slices = max(C.shuffle_partitions(spark), total // 16_000_000)
    read = scratch.write(read_sets(docs, k, width), "read")
    light = read.filter("kind = 0").select("doc_id", "tkey", "n", "sid")
    levels, bounds = frequency_classes(read.filter("kind = 1").select("slice", "cells", "counts"), width)
    shared = spark.sparkContext.broadcast(levels)
    lists = prefixes(docs, k, percent, shared, slices).groupBy("slice").applyInArrow(C.tidy_group(lambda t: _lists(t, percent)), "leader binary, sid binary")
    members = scratch.write(lists.distinct(), "members")
    classes = light.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct(C.id_key().alias("idk"), "tkey")).alias("at"), F.first("n").alias("n")).select("sid", "at.*", "n")
    named = scratch.write(members.join(classes, "sid"), "named")

    def linked(targets: DataFrame, shaped: bool) -> DataFrame:
        return _linked(scratch, docs, targets, k, percent, shared, bounds, broadcast_rows, shaped)

    links = scratch.write(linked(_star(named.withColumns({"hub": F.col("leader"), "comp": F.lit(None).cast("binary")}), block_sets, small), False), "links-0")
    comps, last = scratch.write(components(spark, links, scratch, "comps-0"), "roots-0"), None
    for turn in range(1, STARS + 2):
        known, pairs = _open(named, comps, small)
        known = scratch.write(known, f"open-{turn}")
        now, many = known.agg(F.sum(pairs), F.count("*")).first()
        if not now:
            break
        final = turn > STARS or now <= open_pairs * many or (last is not None and (now <= open_pairs * FEW_CLASSES or now > 0.8 * last))
        targets = _across(known, block_sets) if final else _star(_hubs(known, turn), block_sets, 0)
        more = scratch.write(linked(targets, True), f"links-{turn}")
        # What was linked before is linked through its root.
        links = comps.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
        comps = scratch.write(components(spark, links, scratch, f"comps-{turn}"), f"roots-{turn}")
        if final:
            break
        last = now
    labelled = light.join(comps.select(F.col("node").alias("sid"), "root"), "sid", "left").select("doc_id", "tkey", "n", F.coalesce("root", "sid").alias("root"))
    least = labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "root", "left").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "root")


ASKED = ["hub", "sid", "idk", "tkey", "n", "comp", "block", "role"]


def _star(named: DataFrame, block_sets: int, small: int) -> DataFrame:
    """Targets for the pairs of a hub (role 1) with the other classes (role 2) of its group, in blocks; the hub is in all of them.

    Groups of at most `small` classes are one block, in which all meet all (role 3).
    """
    groups = named.groupBy("hub").agg(F.count("*").alias("many"), F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = named.join(groups, "hub").withColumn("role", F.when(F.col("many") <= small, 3).when(F.col("sid") == F.col("hub"), 1).otherwise(2))
    return placed.withColumn("block", F.explode(F.expr("CASE role WHEN 1 THEN sequence(0L, blocks - 1) WHEN 2 THEN array(pmod(xxhash64(sid), blocks)) ELSE array(0L) END"))).select(*ASKED)


def _open(named: DataFrame, comps: DataFrame, small: int):
    """The classes of larger groups with several components, with their component, and a column whose sum bounds the open pairs."""
    known = named.join(comps.select(F.col("node").alias("sid"), F.col("root").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    counts = known.groupBy("leader", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("leader").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).filter(f"all > most AND all > {small}")
    return known.join(main, "leader"), F.when(F.col("comp") != F.col("main"), F.col("all")).otherwise(0)


def _hubs(known: DataFrame, turn: int) -> DataFrame:
    """More hubs for each group, in its largest component and outside, by hash; each meets the classes of other components."""
    at, h = F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "comp"), F.pmod(F.xxhash64("sid", F.lit(-turn)), F.lit(HUBS))
    hubs = known.groupBy("leader", (F.col("comp") == F.col("main")).alias("inside"), h.alias("part")).agg(F.min(at).alias("hub")).select("leader", F.col("hub.sid").alias("hub"), F.col("hub.comp").alias("own"))
    return known.join(hubs, "leader").filter("comp != own OR sid = hub").dropDuplicates(["hub", "sid"])


def _across(known: DataFrame, block_sets: int) -> DataFrame:
    """Targets for all open pairs: classes outside the largest component of a group meet all classes of the group, block by block."""
    sized = known.withColumns({"blocks": F.ceil(F.col("all") / block_sets), "few": F.ceil((F.col("all") - F.col("most")) / block_sets)})
    sized = sized.withColumns({"at": F.expr("pmod(xxhash64(sid), blocks)"), "mine": F.expr("pmod(xxhash64(sid, 7), few)"), "hub": F.col("leader")})
    asks = sized.filter("comp != main").withColumn("block", F.explode(F.expr("transform(sequence(0L, blocks - 1), j -> mine * blocks + j)"))).withColumn("role", F.lit(1))
    gives = sized.withColumn("block", F.explode(F.expr("transform(sequence(0L, few - 1), i -> i * blocks + at)"))).withColumn("role", F.lit(2))
    return asks.select(*ASKED).unionByName(gives.select(*ASKED)).groupBy(*ASKED[:-1]).agg(F.sum("role").cast("int").alias("role"))


def _linked(scratch: C.Scratch, docs: DataFrame, targets: DataFrame, k: int, percent: int, shared, bounds: np.ndarray, broadcast_rows: int, shaped: bool) -> DataFrame:
    """(u, v) of the pairs of targets whose partial overlaps, summed over the fragments, reach the bound."""
    asked = targets.groupBy("sid", "idk", "tkey", "n", "comp").agg(F.collect_list(F.struct("hub", "block", "role")).alias("targets"))
    asked = scratch.write(asked, f"asked-{uuid.uuid4().hex[:8]}")
    size = asked.agg(F.sum(F.size("targets")).alias("targets"), F.sum(F.col("n") * F.size("targets")).alias("shingles")).first()
    tasks = max(C.shuffle_partitions(scratch.spark), int(size["shingles"] or 0) // 1_000_000)
    asked = asked.select("sid", "idk", "tkey", "comp", "targets")
    asked = F.broadcast(asked) if (size["targets"] or 0) <= broadcast_rows else asked.hint("merge")
    # A class is fetched by one document: the least doc_id, and of its texts one. Others of that id do not come along.
    texts = docs.select(C.id_key().alias("idk"), "tkey", "text").join(asked, ["idk", "tkey"]).select("sid", "targets", "comp", "text")
    partial = fetch(texts, k, shared, bounds, tasks, shaped).groupBy("task").applyInArrow(C.tidy_group(lambda t: _partial(t, percent)), PARTIAL)
    # A pair that lies in several groups is counted in each: one overlap of every fragment goes into the sum.
    once = [F.coalesce(F.max(F.when(F.col("fragment") == f, F.col("overlap"))), F.lit(0)) for f in range(FRAGMENTS)]
    summed = partial.groupBy("a", "b").agg(reduce(add, once).alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return summed.filter(f"100 * overlap >= {percent} * (na + nb - overlap)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at three-word shingles and 0.9; nulls, ties, repeats and empty tables as in components_of."""
    return jaccard_components(spark, C.table(spark, sf_dir, "documents"), k=3, percent=90)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
     sh AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
              ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sh),
     o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
           FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
     l AS (SELECT x, y FROM o WHERE 100 * c >= 90 * (nx + ny - c)),
     g AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
     r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM sh JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = sh.doc_id
"""
