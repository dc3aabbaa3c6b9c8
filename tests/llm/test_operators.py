"""The operators against brute force, round trips, held-out labels and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm import bpe, centroids, components, divergence, jaccard, packing, quality, queries, sharding, substrings, templates, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t) if t else []


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(compare, name, sf_dir):
    compare(queries.QUERIES[name], queries.ORACLE[name], sf_dir)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


def test_ngrams_tell_runs_apart():
    h = C.word_hashes([b"a", b"b", b"c", b"a", b"b", b"c", b"b"])
    for k in range(1, 8):
        g = C.ngrams(h, k)
        runs = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
        assert len(g) == len(runs) and all((g[i] == g[j]) == (runs[i] == runs[j]) for i, j in itertools.combinations(range(len(runs)), 2))


# 1 -------------------------------------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    docs = C.table(spark, SF, "documents")
    out, placed = sharding.shard(spark, docs, store=str(tmp_path / "map"))
    rows, source = out.collect(), dict(texts_of(docs))
    size, place = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len(source[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id].encode())
        size[r.shard] += r["size"]
        place[r.shard].append(r.slot)
    assert len(rows) == len(source) and set(size) == set(range(8))
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    assert max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 8
    assert placed.version == 2 and sharding.SlotMap.load(spark, str(tmp_path / "map")).shard_of == placed.shard_of
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == sharding.SlotMap.even(8).shard_of


def test_a_new_shard_fills_by_few_edits():
    rng = random.Random(1)
    size = {v: rng.randint(1, 1000) for v in range(4096)}
    old = sharding.SlotMap.even(8).edited(size)
    new = old.edited(size, shards=9)
    total = [sum(size[v] for v, s in enumerate(new.shard_of) if s == k) for k in range(9)]
    assert max(total) - min(total) <= 1000 and sum(size[v] for v, _, _ in new.moved) <= 1.1 * sum(total) / 9 and len(new.moved) <= 1.1 * 4096 / 9
    assert all(b == 8 for _, _, b in new.moved) and not new.edited(size).moved
    back = new.edited(size, shards=8)
    total = [sum(size[v] for v, s in enumerate(back.shard_of) if s == k) for k in range(8)]
    assert max(total) - min(total) <= 1000 and all(a == 8 for _, a, _ in back.moved if a == 8)


def test_a_stored_map_is_loaded_edited_and_stored(spark, tmp_path):
    docs, store = C.table(spark, SF, "documents"), str(tmp_path / "map")
    _, old = sharding.shard(spark, docs, store=store)
    rows, new = sharding.shard(spark, docs, shards=9, store=store, current=sharding.SlotMap.load(spark, store))
    assert new.version == 3 and {r.map_version for r in rows.collect()} == {3} and {r.shard for r in rows.collect()} <= set(range(9))
    assert sharding.SlotMap.load(spark, store) == sharding.SlotMap(new.shard_of, 9, 3) and sharding.SlotMap.load(spark, store, 2).shard_of == old.shard_of
    same, kept = sharding.shard(spark, docs, store=store, current=sharding.SlotMap.load(spark, store))
    assert kept.moved == () and same.count() == docs.count()


def test_equal_rows_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rows = sharding.shard(spark, spark.range(1000).selectExpr("CAST(NULL AS long) AS doc_id", "'x' AS text"), slots=16)[0].collect()
    assert sorted(r.slot for r in rows) == list(range(1000)) and len({r.shard for r in rows}) == 1


def test_sharding_edges(spark, edge):
    rows = sharding.shard(spark, edge, slots=16)[0].collect()
    assert len(rows) == edge.count() and sharding.shard(spark, edge.limit(0))[0].count() == 0
    assert sorted((r["size"], r.text_crc32) for r in rows if r.doc_id in (2, 3)) == [(1, 0), (1, 0)]


# 2 -------------------------------------------------------------------------------------------------


def greedy(word, vocabulary, longest):
    i = n = 0
    while i < len(word):
        i = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in vocabulary)
        n += 1
    return n


def test_piece_counts_against_greedy():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"ab_") for _ in range(rng.randint(1, 5))) for _ in range(12)}
        known = tokens.PieceCounts(list(pieces), b"_")
        vocabulary = pieces | {bytes([b]) for b in range(256)}
        for _ in range(20):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert known.count(b"_" + w) == greedy(b"_" + w, vocabulary, 5)


def test_token_counts(spark, edge):
    vocabulary = set(tokens.piece_vocabulary(tokens.default_pieces())) | {bytes([b]) for b in range(256)}
    longest = max(map(len, vocabulary))
    for df in (edge, C.table(spark, SF, "documents").limit(60)):
        got = sorted(map(tuple, tokens.count_pieces(df).collect()), key=str)
        want = []
        for i, t in texts_of(df):
            w = (t or "").encode().split()
            want.append((i, len(w), sum(c * greedy(tokens.MARK + x, vocabulary, longest) for x, c in Counter(w).items())))
        assert got == sorted(want, key=str)


# 3 -------------------------------------------------------------------------------------------------


def brute_substrings(docs, size):
    """docs: distinct (doc_id, text) in order of doc_id."""
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        w = words(t)
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), (i, s))
    out = {}
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] != (i, s):
                gone.update(range(s, s + size))
        out[(i, t)] = (" ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone))
    return out


@pytest.mark.parametrize("size", [5, 20])
def test_substrings_against_brute_force(spark, mixed, size):
    got = {(r.doc_id, r.text): (r.kept_text, r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark, mixed, size).collect()}
    assert got == brute_substrings(texts_of(mixed), size)


def test_substrings_edges(spark, edge):
    out = substrings.dedup_substrings(spark, edge)
    assert out.columns == [*edge.columns, "kept_text", "n_words", "n_removed"] and out.count() == edge.count()
    want = brute_substrings(list(dict.fromkeys(texts_of(edge))), 20)
    assert all(want[(r.doc_id, r.text)] == (r.kept_text, r.n_words, r.n_removed) for r in out.collect())
    assert substrings.dedup_substrings(spark, edge.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "cells"), [(2, (1 << 10, 1 << 24)), (5_000, (8, 8))])
def test_a_full_sketch_and_hot_anchors_lose_nothing(spark, mixed, monkeypatch, hot, cells):
    """With far too few cells all windows seem repeated, and hot anchors deal their windows out; the result is the same."""
    for name, value in (("FLUSH", 500), ("ANCHORS", 300), ("HOT", hot), ("CELLS", cells)):
        monkeypatch.setattr(substrings, name, value)
    got = {(r.doc_id, r.text): r.kept_text for r in substrings.dedup_substrings(spark, mixed, 20).collect()}
    assert got == {k: v[0] for k, v in brute_substrings(texts_of(mixed), 20).items()}


def test_hits_of_a_block_are_a_row_a_target(spark, mixed, tmp_path):
    """Rows between the blocks and the documents grow with neither documents times blocks nor hits; each document gets all its hits in one row."""
    keyed = mixed.select(C.id_key().alias("idk"), F.xxhash64("text").alias("tkey"), F.xxhash64("doc_id", "text").alias("dkey"), "text")
    found, _, blocks = substrings.repeated_anchors(spark, keyed, 20, 2000 * substrings.BLOCK_BYTES)
    assert blocks == 2000
    rows = found.collect()
    assert len({r.dkey for r in rows}) == len(rows) and all(len(r.hits) % 4 == 0 and r.hits for r in rows)
    t = C.record(substrings.HITS, dkey=[*range(-500, 500), None], keys=[bytes(4 * (1 + i % 3)) for i in range(1000)] + [bytes(8)])
    dealt = substrings._dealt(__import__("pyarrow").Table.from_batches([t]), 7)
    assert dealt.num_rows == 8
    back = {r["dkey"]: len(r["hits"]) for i in range(7) for r in substrings._by_document(dealt.filter([x == i for x in dealt.column("target").to_pylist()])).to_pylist()}
    assert back == {d: 4 * (1 + i % 3) for i, d in enumerate(range(-500, 500))}


def test_the_sketch_passes_few_unique_anchors(spark):
    """No block is held to a size: of anchors that occur once, few are estimated to repeat, however many blocks there are."""
    rng = np.random.default_rng(5)
    for n in (1_000, 300_000):
        keys, docs = rng.integers(0, 2**32, n).astype("<u4"), np.arange(n, dtype="<i8")
        t = C.record(substrings.SKETCH, slice=[0], once=[keys.tobytes()], once_docs=[docs.tobytes()], more=[None], times=[None], known=[None], known_docs=[None])
        out = substrings._estimated(__import__("pyarrow").Table.from_batches([t]), 10)
        assert out.num_rows - 1 < 0.03 * n


# 4 -------------------------------------------------------------------------------------------------


def brute_jaccard(docs, k, percent):
    sets = []
    for i, t in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if t else t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        least[root(a)].append(i)
    known = lambda g: min((i for i in g if i is not None), default=None)
    return sorted(((i, len(s), known(least[root(a)])) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("k", "percent", "more"), [(3, 90, {}), (5, 80, {}), (2, 60, {"block_sets": 4, "broadcast_rows": 0, "small": 2}), (2, 60, {"block_sets": 4, "open_pairs": 0, "small": 3})])
def test_jaccard_against_brute_force(spark, mixed, k, percent, more):
    got = sorted(map(tuple, jaccard.jaccard_components(spark, mixed, k, percent, **more).collect()), key=str)
    assert got == brute_jaccard(texts_of(mixed), k, percent)


def test_jaccard_edges(spark, edge):
    got = sorted(map(tuple, jaccard.jaccard_components(spark, edge, 3, 90).collect()), key=str)
    assert got == brute_jaccard(texts_of(edge), 3, 90)
    assert jaccard.jaccard_components(spark, edge.limit(0)).count() == 0


def test_a_pair_in_several_groups_is_summed_once(spark, monkeypatch):
    """Near misses that share rare shingles with several other sets lie in several groups; no overlap may be doubled."""
    rng, groups = random.Random(4), []
    base = [[f"w{b}-{i}" for i in range(60)] for b in range(6)]
    docs = []
    for i in range(90):
        w = list(base[i % 6])
        for at in rng.sample(range(2, 60, 5), rng.randint(2, 6)):
            w[at] = f"x{at}-{rng.randrange(5)}"
        docs.append((i, " ".join(w)))

    def star(named, block_sets, small):
        got = star_of(named, block_sets, small)
        groups.extend((r.hub, r.sid) for r in got.select("hub", "sid").distinct().collect())
        return got

    star_of = jaccard._star
    monkeypatch.setattr(jaccard, "_star", star)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard.jaccard_components(spark, df, 2, 80).collect()), key=str)
    of = defaultdict(set)
    for hub, sid in groups:
        of[bytes(hub)].add(bytes(sid))
    assert max(Counter(p for g in of.values() for p in itertools.combinations(sorted(g), 2)).values()) >= 3
    assert got == brute_jaccard(docs, 2, 80)


@pytest.mark.parametrize("nodes", [200_000, 0])
def test_components_end_without_another_round(spark, monkeypatch, nodes):
    """Against union by hand, joined by broadcast and by shuffle; links that are components already take one round, not one more to see it."""
    monkeypatch.setattr(components, "BROADCAST_NODES", nodes)
    rng, written = random.Random(8), []

    class Counted(C.Scratch):
        def write(self, df, name):
            written.append(name)
            return super().write(df, name)

    def roots(links):
        written.clear()
        return {r.node: r.root for r in components.components(spark, spark.createDataFrame(links, "u long, v long"), Counted(spark, "links"), "c").collect()}

    assert roots([(9, i) for i in range(10, 40)] + [(3, 4), (3, 3)]) == dict.fromkeys(range(9, 40), 9) | {3: 3, 4: 3} and len(written) == 2
    links = [(i, i + 1) for i in range(500, 560)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    root: dict = {}
    for u, v in (e for e in links if e[0] != e[1]):
        a, b = root.setdefault(u, u), root.setdefault(v, v)
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert roots(links) == root and roots([(5, 5)]) == {}


def test_near_copies_make_no_links_by_the_square(spark, monkeypatch):
    """A large group of which its leader links with none gets few partners first, however few its open pairs are."""
    base, many, star_of, write_of, links = [f"w{i}" for i in range(100)], 150, jaccard._star, C.Scratch.write, {}
    docs = [(i, " ".join(w if j != 5 + i % 90 else f"x{i}" for j, w in enumerate(base))) for i in range(many)]

    def star(named, block_sets, small):
        targets = star_of(named, block_sets, small)
        return targets.filter("sid = hub") if small else targets

    def write(self, df, name):
        out = write_of(self, df, name)
        if name.startswith("links-"):
            links[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "_star", star)
    monkeypatch.setattr(C.Scratch, "write", write)
    got = jaccard.jaccard_components(spark, spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    assert {r.component_id for r in got} == {0} and len(got) == many
    assert links["links-0"] == 0 and max(links.values()) <= 2 * jaccard.HUBS * many < many * (many - 1) // 2


@pytest.mark.parametrize("shape", [lambda s: b"", lambda s: np.bincount(s.astype(np.int64) % 16, minlength=16).astype("<u4").tobytes()])
def test_partial_overlaps_sum_to_the_whole(shape):
    """Sets cut into fragments: the partial counts of all fragments sum to the overlap; pairs out of reach may count less."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    bounds = np.array([0, 200, 450, 700, 2**64 - 1], dtype=np.uint64)
    base = np.unique(rng.integers(0, 900, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, len(base) - d, replace=False), rng.integers(0, 900, d // 2).astype(np.uint64)))) for d in (0, 4, 8, 20, 40, 60)]
    names = [(bytes([i]) * 16) for i in range(len(sets))]
    total = Counter()
    for f in range(4):
        pieces = [s[(s >= bounds[f]) & (s < bounds[f + 1])] for s in sets]
        n = len(sets)
        t = pa.Table.from_batches([C.record(jaccard.PIECES, task=[0] * n, hub=[names[0]] * n, block=[0] * n, fragment=[f] * n, role=[3] * n, comp=[None] * n, sid=names, n=[len(s) for s in sets], size=[len(p) for p in pieces], tokens=[p.tobytes() for p in pieces], shape=[shape(s) for s in sets])])
        for r in jaccard._partial(t, 80).to_pylist():
            total[frozenset((r["a"], r["b"]))] += r["overlap"]
    for i, j in itertools.combinations(range(len(sets)), 2):
        whole = len(np.intersect1d(sets[i], sets[j]))
        got = total[frozenset((names[i], names[j]))]
        assert got == whole if 100 * whole >= 80 * (len(sets[i]) + len(sets[j]) - whole) else got <= whole


def test_many_rows_of_one_id_are_fetched_once(spark, monkeypatch):
    """The join that fetches texts is on the id and the text, so rows without an id do not meet each other."""
    rng, sent = random.Random(3), []
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(40))
    base = [text() for _ in range(40)]
    docs = spark.createDataFrame([(None, t + f" {i % 2}") for t in base for i in range(2)], "doc_id long, text string")
    whole = jaccard.fetch

    def counted(texts, *more):
        sent.append(texts.count())
        return whole(texts, *more)

    monkeypatch.setattr(jaccard, "fetch", counted)
    assert jaccard.jaccard_components(spark, docs, 3, 80).filter("component_id IS NULL").count() == 80
    assert sent[0] <= 80


# 5 -------------------------------------------------------------------------------------------------

QUESTION = "A farmer named Alice sells 12 apples and 30 pears at the market for 5 dollars each so how much does Alice earn in 3 weeks"


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_ids, r.re_parameterised) for r in templates.decontaminate(d, b, **more).collect()}


def test_templates(spark):
    other = "The lazy river winds along green hills where many sheep graze until evening falls over quiet villages below"
    same = QUESTION.replace("Alice", "Robert").replace("12", "77").replace("30", "81").replace("5 dollars", "9 euros").replace("3", "6")
    mixed_up = QUESTION.replace("earn in 3", "earn in 12").replace("Alice earn", "Zoe earn")
    docs = [(1, f"before it. {QUESTION} after"), (2, f"Some words first. {same} and more"), (3, other), (4, mixed_up), (5, None), (6, ""), (7, "12 30 5 3 " * 30)]
    for more in ({}, {"block_words": 2}):
        got = found(spark, docs, [(1, QUESTION), (2, "the river"), (3, None), (4, other + " again and again it goes on for ever")], **more)
        assert got[1] == (True, [1], False) and got[2] == (True, [1], True)
        assert got[3] == (True, [4], False)
        assert not any(got[i][0] for i in (5, 6, 7))
    assert not any(x[0] for x in found(spark, docs, [(9, None)]).values())


def test_slots_must_agree(spark):
    item = "Bob gave 3 coins to Ann and then Ann gave 3 coins back to Bob who counted 3 coins with Ann at noon"
    ok = item.replace("Bob", "Tim").replace("Ann", "Eve").replace("3", "8")
    wrong = "Bob gave 1 coins to Ann and then Sue gave 2 coins back to Tim who counted 4 coins with Joe at noon"
    got = found(spark, [(1, f"So {ok}"), (2, f"So {wrong}")], [(1, f"So {item}")])
    assert got[1] == (True, [1], True) and got[2][0] is False


def test_verbatim_items_and_edges(spark, edge):
    docs, bench = C.table(spark, SF, "documents"), C.table(spark, SF, "benchmark")
    items = [(r.item_id, " ".join(words(r.text))) for r in bench.collect()]
    want = {i for i, t in texts_of(docs) if any(b in " ".join(words(t)) for _, b in items)}
    assert {r.doc_id for r in templates.decontaminate(docs, bench).filter("contaminated").collect()} == want
    out = templates.decontaminate(edge, bench)
    assert out.count() == edge.count() and out.columns == [*[c for c in edge.columns if c != "item_ids"], *templates.FOUND_NAMES]
    assert templates.decontaminate(edge, bench.limit(0)).filter("contaminated").count() == 0


def test_items_of_many_slots_are_found_verbatim(spark):
    items = ["What Is The Capital Of France And Who Was President There In 1995", "Alice Smith, Bob Jones, Carol White, Dan Brown and Eve Black met Frank Green", "Berlin 3 m, Paris 4 m, London 5 m, Rome 6 m: order the cities", "Solve: 3 4 5 6 7 8 9 10 next number in the sequence?"]
    docs = [(i, f"Some words first. {t} and more") for i, t in enumerate(items)]
    other = [(9, "Some words first. Fred Smith, Bob Lee, Carl Gray, Dan Short and Eve Long met Frank Hill"), (10, "1 2 3 4 5 6 7 8 9 " * 20)]
    got = found(spark, docs + other, list(enumerate(items)))
    assert all(got[i] == (True, [i], False) for i in range(4)) and not got[9][0] and not got[10][0]


def test_items_without_an_id_and_behind_a_heading(spark):
    short = "Which river flows past the old mill"
    got = found(spark, [(1, f"Heading, {short} today"), (2, "Heading, which road leads past the new town")], [(None, short)])
    assert got[1] == (True, [], False) and not got[2][0]
    assert found(spark, [(1, f"Heading: {short} today")], [(5, short)])[1] == (True, [5], False)


@pytest.mark.parametrize("more", [{}, {"block_words": 1}])
def test_slots_short_items_and_names(spark, more):
    """By look-up and by join: one map for all alignments, names that open sentences or have two words, short items verbatim."""
    bob = "Bob gave 3 coins to Ann and then Ann gave 3 coins back to Bob who counted 3 coins with Ann at noon"
    two = "Tim gave 1 coins to Ann and then also Sue gave 2 coins back to Bob who counted 4 coins with Joe at noon"
    same = bob.replace("Bob", "Tim Young").replace("Ann", "Eve").replace("3", "8").replace("and then", "and then also")
    alice, robert = "Alice has 12 red apples in the basket", "Robert has 77 red apples in the basket"
    far = "Bob gave 3 coins to Ann and then Ann gave 3 " + "filler words of no use at all " * 60 + "coins back to Bob who counted 3 coins with Ann at noon"
    items = [(1, bob), (2, alice), (3, "blue green yellow red"), (4, "yes indeed"), (5, None), (6, "")]
    docs = [(1, two), (2, same), (3, robert), (4, "we like blue green, yellow red"), (5, "yes indeed"), (6, "oh yes indeed"), (7, None), (8, "nothing"), (9, "it was blue green or yellow red"), (10, far), (None, alice), (None, None)]
    got = found(spark, docs, items, **more)
    assert got[1][0] is False and got[2] == (True, [1], True) and got[3] == (True, [2], True)
    assert got[4] == (True, [3], False) and got[5] == (True, [4], False) and got[None][0] in (True, False)
    assert not any(got[i][0] for i in (6, 7, 8, 9))
    assert got[10][0] is False


@pytest.mark.parametrize("more", [{}, {"block_words": 1}])
def test_templates_against_brute_force(spark, more):
    """Every window of every item held against every window of every document, word by word."""
    rng = random.Random(21)
    plain = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    names, make = ["Ann", "Bob", "Carl", "Dora"], lambda n: [rng.choice([rng.choice(plain)] * 5 + [str(rng.randrange(9)), rng.choice(names)]) for _ in range(n)]
    items = [make(rng.randint(9, 30)) for _ in range(25)]
    docs = []
    for i in range(80):
        w = list(items[i % 25])
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(plain)
        if i % 3:
            w = [str(int(x) + 1) if x.isdigit() else rng.choice(names) if x in names and i % 2 else x for x in w]
        docs.append((i, make(rng.randint(0, 12)) + w + make(rng.randint(0, 12))))

    def tokens_of(w):
        out = []
        for x in w:
            kind = "num" if x.isdigit() else "name" if x in names else "word"
            if kind == "name" and out and out[-1][0] == "name":
                out[-1] = ("name", out[-1][1] + " " + x)
            else:
                out.append((kind, x))
        return out

    want = {}
    for i, w in docs:
        d = tokens_of(w)
        for j, x in enumerate(items):
            t = tokens_of(x)
            hits = []
            for p in range(len(t) - 7):
                a = t[p : p + 8]
                for q in range(len(d) - 7):
                    b = d[q : q + 8]
                    slots = sum(k != "word" for k, _ in a)
                    if all(m == n and (m != "word" and slots <= 4 or u == v) for (m, u), (n, v) in zip(a, b, strict=True)):
                        hits.append((p, q))
            number = {v: n for n, v in enumerate(sorted({v for _, v in t + d}))}
            got = templates.share_found(hits, 8, [int(k != "word") for k, _ in t], [number[v] for _, v in t], {q: number[v] for q, (_, v) in enumerate(d)}) if hits else (0, False)
            if got[0] >= templates.SHARE:
                want.setdefault(i, []).append(j)
    got = found(spark, [(i, " ".join(w)) for i, w in docs], [(j, " ".join(x)) for j, x in enumerate(items)], **more)
    assert {i: r[1] for i, r in got.items() if r[0]} == want and 10 < len(want)


# 6, 9 ----------------------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizer(spark, edge):
    from tokenizers import Tokenizer

    t, known = Tokenizer.from_file(tokens.default_path()), tokens.WordIds(tokens.default_path())
    odd = ["it's we'll O'NEIL's x'sy 'S", "a1b2 3.14 C++", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "e\u0301 é", "tab\x1cin", "a\u00a0b\u2003c", "<|endoftext|>x", "日本語 text", "ÿ\u0149"]
    for _, text in [*texts_of(edge), *texts_of(C.table(spark, SF, "documents").limit(40)), *((0, o) for o in odd)]:
        if text and len(text) < 100_000:
            assert np.frombuffer(known.text(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_differencing_is_a_partition_and_balances():
    rng = random.Random(4)
    for _ in range(100):
        k, sizes = rng.randint(1, 9), [rng.randint(1, 512) for _ in range(rng.randint(1, 120))]
        part = packing.differencing(sizes, k)
        sums = np.bincount(part, weights=sizes, minlength=k)
        assert len(part) == len(sizes) and sums.sum() == sum(sizes) and len(sums) == k
        if len(sizes) > 12 * k:
            assert sums.max() - sums.min() <= 60
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    part, k = packing.windows([600, 600, 600], 1000)
    assert k == 3 and len(set(part)) == 3


def test_packing(spark, edge):
    docs = C.table(spark, SF, "documents").select("doc_id", "text").unionByName(edge.select("doc_id", "text").filter("doc_id IS NULL OR doc_id IN (2, 3, 5)").selectExpr("doc_id + 100000 AS doc_id", "text"))
    known = tokens.WordIds(tokens.default_path())
    ids = defaultdict(list)
    for i, t in texts_of(docs):
        ids[i].append(np.append(np.frombuffer(known.text(t.encode() if t else None), "<u4"), np.uint32(1)))
    rows = packing.pack(spark, docs).collect()
    held, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        held[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert held == {i: sum(map(len, x)) for i, x in ids.items()}
    for s in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(s)))
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(held.values()) > 0.95 * 2048 * len(sequences)
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_equal_pieces_are_dealt_out(spark):
    """Rows that are all equal still make bundles of like sizes."""
    docs = spark.range(30_000).selectExpr("CAST(NULL AS long) AS doc_id", "'one two three' AS text")
    rows = packing.pack(spark, docs).groupBy("sequence_id").sum("length").collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 7 and max(r[1] for r in rows) <= 2048


def test_wide_vocabularies_keep_their_ids(spark, tmp_path):
    import json

    spec = json.load(open(tokens.default_path()))
    spec["model"]["vocab"] = {t: i + (70_000 if i > 1 else 0) for t, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = []
    json.dump(spec, open(tmp_path / "wide.json", "w"))
    docs = spark.createDataFrame([(1, "some plain words here"), (2, "other words " * 3000)], "doc_id long, text string")
    rows = packing.matrices(spark, docs, path=str(tmp_path / "wide.json")).collect()
    known = tokens.WordIds(tokens.default_path())
    parts = sorted((d, s, x.tolist()) for r in rows for d, s, x in packing.unpack(r))
    for i, t in texts_of(docs):
        want = [x + 70_000 if x > 1 else x for x in np.frombuffer(known.text(t.encode()), "<u4").tolist()]
        assert [x for d, _, p in parts if d == i for x in p] == [*want, 1]
    assert {r.id_bytes for r in rows} == {4} and {r.id_bytes for r in packing.matrices(spark, docs).collect()} == {2}
    assert all(r.position_resets == r.cu_seqlens[:-4] and np.frombuffer(r.position_resets, "<i4")[0] == 0 for r in rows)


def test_best_fit_against_linear_search():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        space = []
        for s in sorted(sizes, reverse=True):
            fit = min((x for x in range(len(space)) if space[x] >= s), key=lambda x: space[x], default=None)
            if fit is None:
                space.append(capacity - s)
            else:
                space[fit] -= s
        bins = packing.best_fit(sizes, capacity)
        assert sorted(capacity - sum(sizes[i] for i in b) for b in bins) == sorted(space)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_matrices_round_trip(spark, edge, tmp_path):
    packing.write_matrices(spark, edge, str(tmp_path / "m"))
    known = tokens.WordIds(tokens.default_path())
    want = Counter((C.NULL_ID if i is None else i, known.text(t.encode() if t else None)) for i, t in texts_of(edge))
    parts = [p for r in spark.read.parquet(str(tmp_path / "m")).collect() for p in packing.unpack(r)]
    whole = Counter({k: n for k, n in want.items() if len(k[1]) // 4 < packing.CAPACITY})
    assert Counter((d, x[:-1].astype("<u4").tobytes()) for d, s, x in parts if s == 0 and len(x) < packing.CAPACITY) == whole
    for doc in (5, 6):
        got = np.concatenate([x for _, x in sorted(((s, x) for d, s, x in parts if d == doc), key=lambda p: p[0])])
        assert got[-1] == 1 and got[:-1].astype("<u4").tobytes() == next(k[1] for k in want if k[0] == doc)
    assert packing.matrices(spark, edge.limit(0)).count() == 0


# 7 -------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    for _ in range(1500):
        terms, word, most = {make(6): rng.random() for _ in range(6)}, make(7), rng.randint(0, 2)
        want = min(((distance(word, t), -w, t) for t, w in terms.items() if distance(word, t) <= most), default=None)
        assert toxicity.Trie(terms).search(word, most) == (None if want is None else (want[0], -want[1]))


def test_filter_before_the_trie_loses_no_misspelling():
    rng = random.Random(8)
    terms = {"".join(rng.choice("abcdef") for _ in range(n)): 3.0 for n in (5, 6, 8, 9, 11)}
    known = toxicity.Matcher(toxicity.Lexicon(tuple(terms.items())))
    for _ in range(3000):
        t = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"[:1]])
        word = "".join(t)
        want = min((distance(word, x) for x in terms), default=9)
        assert bool(known[word.encode()]) == (want <= toxicity.edits(len(word)) and bool(word))


def test_misspellings_of_stems_covered_words_and_short_terms():
    lexicon = toxicity.pruned([("idio*", 45, 4.0), ("idiot", 20, 4.0), ("idiots", 15, 4.0), ("idiotic", 10, 4.0), ("scum", 9, 5.0), ("ass", 9, 5.0)])
    known = toxicity.Matcher(lexicon)
    for word in ("idoit", "1diot", "ldiot", "idiiots", "idi0tic", "1diocy", "scumm", "scun", "scm"):
        assert known[word.encode()][:2] == ("hit", 1), word
    assert known[b"idiot"][:3] == ("hit", 0, 4.0) and known[b"scum"][:3] == ("hit", 0, 5.0)
    assert not known[b"peaceful"] and not known[b"as"] and not known[b"asss"]


def test_stem_misspellings_against_all_starts():
    rng = random.Random(13)
    make = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for _ in range(40):
        stems = {make(rng.randint(4, 8)) + "*": rng.random() + 1 for _ in range(3)}
        known = toxicity.Matcher(toxicity.Lexicon(tuple(stems.items())))
        for _ in range(60):
            word = make(rng.randint(1, 11))
            want = min((distance(word[:i], s[:-1]) for s in stems for i in range(len(word))), default=9)
            got = known[word.encode()]
            assert got[1] == want if got else want > min(toxicity.edits(len(word)), 1), (stems, word)


def test_terms_are_tested_and_pruned_before_they_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 4)
    long = "z" * 70
    docs = [(i, f"plain words here n{i}" + (" villainous" * (i < 24) + " scoundrel" * (i < 20) + f" {long}" * (i < 16)), int(i < 24)) for i in range(400)]
    got = toxicity.learn_lexicon(spark.createDataFrame(docs, "doc_id long, text string, toxic int"))
    assert [t for t, _ in got.terms] == ["scoundrel", "villainous", long]


def test_quotation_weighs_less_than_abuse():
    known = toxicity.Matcher(toxicity.Lexicon((("villain", 4.0),)))
    worth = lambda t: toxicity.features(t.encode().split(), known)[4]
    assert worth("he said “villain” was the word") < worth("you villain go away")
    assert worth("you vilain go away") > 0 and worth("a peaceful day") == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op7_toxicity(spark, sf).join(C.table(spark, sf, "labels"), "doc_id").filter("held_out").select("score", "toxic").collect()
    good, bad = ([r.score for r in rows if r.toxic == t] for t in (0, 1))
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(good) / len(bad) > 0.8
    assert sum(s >= toxicity.THRESHOLD for s in good) <= 0.02 * len(good)


def test_learning_drops_copies_only(spark):
    rng = random.Random(12)
    make = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    line, text = make(30), make(60)
    near = [*text[:50], "other", *text[51:]]
    share = [(i, " ".join(line + make(30)), i % 2) for i in range(40)]
    docs = [*share, (50, " ".join(text), 1), (51, " ".join(near), 1), (52, " ".join(text), 1), (53, " ".join(text), 0), (54, None, 0)]
    got = toxicity.one_of_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, toxic int")).collect()
    assert sorted((r.doc_id, r.toxic) for r in got) == [*((i, t) for i, _, t in share), (50, 1), (53, 0), (54, 0)]


def test_labels_that_contradict_each_other_are_left_out(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 7), (5, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, C.one_label(labels, "toxic").collect())) == [(2, 1), (5, 0)]


def test_scratch_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    class Remote:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        C.scratch_root(Remote)
    monkeypatch.setattr(C, "scratch_root", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(C, "WRITTEN", [])
    C.Scratch(spark, "x").write(spark.range(3), "t")
    assert len(list(tmp_path.iterdir())) == 1 and C.clear_scratch(spark) == 1 and not list(tmp_path.iterdir())


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, edge, labels)
    out = toxicity.score_toxicity(edge, model)
    assert out.count() == edge.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert out.columns == [*[c for c in edge.columns if c != "score"], "score", "n_hits"]
    assert toxicity.learn(spark, edge.limit(0), labels.limit(0)).terms == ()
    assert toxicity.score_toxicity(edge.limit(0), model).count() == 0


# 8 -------------------------------------------------------------------------------------------------


def brute_base(t):
    w = words(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    lines = [x for x in t.split("\n") if words(x)] if t else []
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)})


def test_base_counts(spark, edge):
    for _, t in [*texts_of(edge), *texts_of(C.table(spark, SF, "documents")), (0, "a b c d e a b c d e"), (0, "x\nx\n \n \ny")]:
        assert quality.base_counts(t.encode() if t is not None else None) == brute_base(t)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    for _ in range(100):
        chain = quality.Chain(tuple(map(tuple, rng.normal(size=(2, quality.N_FEATURES)))), tuple(map(tuple, rng.normal(size=(2, 2)))))
        xs = rng.normal(size=(rng.integers(1, 8), quality.N_FEATURES)).tolist()
        value = lambda p: sum(np.dot(chain.node[s], x) for s, x in zip(p, xs, strict=True)) + sum(chain.step[a][b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert tuple(chain.viterbi(xs)) == max(itertools.product((0, 1), repeat=len(xs)), key=value)


def test_held_out_quality(spark):
    """Learned from two thirds of the labels, tested on the rest."""
    sf = "/root/testdata/sf0.01"
    docs, labels = C.table(spark, sf, "documents").select("doc_id", "text"), C.table(spark, sf, "labels")
    chain = quality.learn(spark, docs, labels.filter(~toxicity.held_out()))
    rows = quality.quality(docs, chain).join(labels.filter(toxicity.held_out()), "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) >= 5 and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_lines_are_labelled_one_by_one(spark):
    """Junk and notices inside clean documents are boilerplate, the lines around them content; junk documents keep their clean lines."""
    sf = "/root/testdata/sf0.01"
    docs, labels = C.table(spark, sf, "documents").select("doc_id", "text"), C.table(spark, sf, "labels")
    chain = quality.learn(spark, docs, labels)
    clean = [r.text for r in docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").orderBy("doc_id").collect() if 8 <= len(quality.lines_of(r.text.encode())) <= 40 and not quality.NOTICE.search(r.text.encode())][:30]
    junk = ["| Home | About | Contact | Products | Help | Login |", "BUY!! NOW!! CHEAP!! DEALS!! TODAY!! ONLY!! BEST!! PRICES!!", "Copyright 2020 by the authors, all rights reserved"]
    right = mixed = 0
    for i, t in enumerate(clean):
        lines = t.split("\n")
        at = len(lines) // 2
        lines[at:at] = [junk[i % 3]]
        text = "\n".join(lines).encode()
        path = dict(zip(quality.lines_of(text), chain.viterbi(quality.document_features(text)), strict=True))
        right += path[junk[i % 3].encode()] == 0
        mixed += 0.8 * len(path) <= sum(path.values()) < len(path)
    assert len(clean) == 30 and right >= 27 and mixed >= 26
    shares = [r.content_share for r in quality.quality(docs, chain).join(labels.filter("quality = 0"), "doc_id").collect()]
    assert sum(0 < s < 1 for s in shares) >= 0.2 * len(shares)


def test_gradient_of_the_chain():
    rng = np.random.default_rng(4)
    sequences = [(rng.normal(size=(n, quality.N_FEATURES)), rng.integers(0, 2, n)) for n in (1, 3, 5, 2)]
    theta = rng.normal(size=2 * quality.N_FEATURES + 4)

    def likelihood(th):
        w, s = th[: 2 * quality.N_FEATURES].reshape(2, -1), th[2 * quality.N_FEATURES :].reshape(2, 2)
        total = 0.0
        for x, y in sequences:
            value = lambda p: sum(w[a] @ v for a, v in zip(p, x, strict=True)) + sum(s[a][b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
            total += value(y) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=len(y))))
        return total / sum(len(y) for _, y in sequences)

    got = quality._gradient(theta, [quality._padded(sequences)])
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - got[i]) < 1e-6


def test_all_lines_of_long_documents_are_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_chain", lambda sequences: seen.append(sum(len(y) for _, y in sequences)))
    docs = [(1, "\n".join(f"some line {i}." for i in range(700))), (2, "\n".join(f"junk {i}" for i in range(10))), (3, "x"), (3, None)]
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0)]
    quality.learn(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == [710]


def test_quality_edges(spark, edge):
    out = quality.quality(edge, quality.Chain())
    assert out.count() == edge.count() and out.filter("text IS NULL AND (n_words != 0 OR kept)").count() == 0
    assert quality.learn(spark, edge, spark.createDataFrame([(1, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")) == quality.Chain()
    assert quality.quality(edge.limit(0), quality.Chain()).count() == 0


# 10 ------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://foo.net", "http://example.net/en/a?b#c", "http://x.example.net/en", "http://example.com/de/", "http://notexample.com/de/x", "https://a.org/fr/b", "https://spam-farm.org/x", "https://www.spam-farm.co/", "http://a.b/cart?x", "http://a.b/robots.txt", "http://q.w/?action=login", "http://net/", "x://y://net/z", "http://casino-royal.biz/", "ftp://ex.org?u=http://a.net/"]


def test_urls_against_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(3, "http://", None), (None, "http://a.net/", None)], "page_id long, url string, html string")
    for r in urls.judge_urls(pages).join(pages.select("page_id", "url").distinct(), "page_id").collect():
        url = r.url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(h + p, v) for v, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
        if rule is None:
            hits = [x.verdict for x in urls.PATTERN_RULES if re.search(x.pattern, url.lower())]
            verdict = "allow" if "allow" in hits or not hits else "block"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url
    assert urls.judge_urls(pages.limit(0)).count() == 0 and urls.judge_urls(pages).count() == len(URLS) + 2


def test_the_index_uses_the_rarest_literal(spark):
    pages = spark.createDataFrame([(i, "http://farm.example/farm") for i in range(5)] + [(9, "http://spam.example/")], "page_id long, url string")
    index = urls.rarest_literals(pages, urls.PATTERN_RULES)
    assert 0 in index["spam"] and "farm" not in index


def test_digest_of_kept_text(spark):
    r = queries.QUERIES["op3_substring_dedup"](spark, SF).filter("n_removed = 0").first()
    text = dict(texts_of(C.table(spark, SF, "documents")))[r.doc_id]
    assert r.kept_sha256 == hashlib.sha256(" ".join(words(text)).encode()).hexdigest() and not math.isnan(r.n_words)


# 11 ------------------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_bpe_equals_the_library(spark, edge, mixed):
    """Ids and decoded texts of whole documents, of every edge case and of all documents of a small table."""
    lib = library()
    for docs in (edge, mixed, C.table(spark, SF, "documents")):
        got = bpe.decode(bpe.encode(docs))
        assert got.columns == [*docs.columns, "ids", "decoded"]
        want = sorted(((r.doc_id, r.text, lib.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()), key=str)
        rows = sorted(((r.doc_id, r.text, list(r.ids)) for r in got.collect()), key=str)
        assert rows == want
        assert {(r.text, r.decoded) for r in got.collect()} == {(t, lib.decode(i, skip_special_tokens=False)) for _, t, i in want}
    assert bpe.decode(bpe.encode(edge.limit(0))).count() == 0


def test_bpe_digests(spark, edge):
    lib = library()
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op11_bpe_trie(spark, SF).collect()}
    for r in C.table(spark, SF, "documents").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    empty = (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    rows = bpe.digests(edge).collect()
    assert len(rows) == edge.count() and {tuple(r)[1:] for r in rows if r.doc_id in (2, 3, 4)} == {empty} and bpe.digests(edge.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "aeinorst", "=-_|*!", "theand'sll", "aé漢ß😀\u0301 \u03a3\u0130\u212a\u00a0\x1c", "the <|endoftext|>"])
def test_bpe_of_random_texts(alphabet):
    """Long runs, repeats and odd characters: where tokens meet, merges across the boundary must be seen."""
    rng, lib, model = random.Random(9), library(), bpe.Bpe(tokens.default_path())
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 20, 90, 400]))) for _ in range(700)] + [alphabet * 200]
    got = [np.frombuffer(x, "<i4").tolist() for x in model.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_another_file():
    """A byte-level file without word ends; its decoder gives the text back."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, lib, names = bpe.Bpe(path), Tokenizer.from_file(path), bpe.Names(path)
    pieces = ["hello", "\u0120world", "\u0120the", "aaaaaaaa", "=====", "\u00c3\u00a9t\u00c3\u00a9"]
    got = model.insert([bytes(map(bpe.BYTES.__getitem__, p)) for p in pieces])
    for p in pieces:
        raw = bytes(map(bpe.BYTES.__getitem__, p))
        ids = np.frombuffer(got[raw], "<i4").tolist()
        assert ids == [t.id for t in lib.model.tokenize(p)] and names.decode(ids) == lib.decode(ids)
    assert names.decode([0, None, -1, 10**6]) == lib.decode([0]) and names.decode([]) == ""


def test_bpe_forgets_and_goes_on(monkeypatch):
    lib, model, rng = library(), bpe.Bpe(tokens.default_path()), random.Random(2)
    monkeypatch.setattr(bpe, "NODES", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(10)) for _ in range(5)]
        assert [np.frombuffer(x, "<i4").tolist() for x in model.encode([t.encode() for t in texts])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_shared_prefixes_are_encoded_once():
    model = bpe.Bpe(tokens.default_path())
    model.insert([b"international", b"internationally", b"internet", b"internal"])
    assert len(model.last) - 1 == len("internationall") + len("e") and model.insert([b"internationale"]) and len(model.last) - 1 == len("internationall") + len("e")


# 12 ------------------------------------------------------------------------------------------------


def brute_divergence(docs, least=3, top=200):
    split = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups, inside, of_lang = defaultdict(Counter), Counter(), defaultdict(Counter)
    for lang, source, text in docs:
        found = split.findall(low(text or ""))
        groups[lang or "", source or ""].update(found)
        of_lang[lang or ""].update(found)
        inside.update((lang or "", t) for t in set(found))
    out = []
    for (lang, source), count in groups.items():
        kept = [t for t in of_lang[lang] if inside[lang, t] >= least]
        total = {s: sum(c[t] for t in kept) for (x, s), c in groups.items() if x == lang}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        gap = lambda p, q: (p - q) ** 2 // q
        mine = {t: share(count[t], total[source]) for t in kept}
        pairs = [(s, sum(gap(mine[t], share(groups[lang, s][t], total[s])) for t in kept)) for s in total if s != source]
        whole = sum(of_lang[lang][t] for t in kept)
        terms = [(t, gap(mine[t], share(of_lang[lang][t], whole))) for t in kept if count[t] and mine[t] > share(of_lang[lang][t], whole)]
        for part, rows in (("pair", pairs), ("term", terms)):
            ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def source_rows(spark):
    rng, rows = random.Random(8), []
    vocab = [f"{a}{b}" for a in ("Ab", "b", "é", "Zo", "漢", "q") for b in ("x", "Yy", "ß", "😀", "")]
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "de", None, "fr"])
        text = None if i % 17 == 0 else rng.choice([" ", "-", "\x7f", "9"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, lang, rng.choice(["a", "b", "c", "d", "é", "", None])))
    rows += [(200, "only here", "xx", "a"), (201, "nor there", "xx", "b"), (202, None, "yy", "a"), (203, "AB ab Ab aB", "zz", "one"), (203, "ab", "zz", "one"), (203, "ab", "zz", "one")]
    return rows


@pytest.mark.parametrize("more", [{}, {"held": 30, "block": 200, "slice_rows": 7, "sources": 2}, {"top": 3, "slice_rows": 20, "sources": 3}, {"least_docs": 1}])
def test_divergence_against_brute_force(spark, more):
    rows = source_rows(spark)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n long, part string").repartition(3)
    got = sorted(map(tuple, divergence.audit(spark, docs, **more).collect()))
    assert got == brute_divergence([(lang, source, t) for _, t, lang, source in rows], more.get("least_docs", 3), more.get("top", 200))
    assert divergence.audit(spark, docs.limit(0)).count() == 0


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    class Same:
        @staticmethod
        def xxh64_intdigest(b):
            return len(b) % 2

    texts = [b"aa Bb c aa bb", b"", "é aaaa bb ddd".encode(), b"c c"]
    want = [(d, t, n) for d, x in enumerate(texts) for t, n in sorted(Counter(w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", x)).items())]
    for fake in (None, Same):
        if fake:
            monkeypatch.setattr(divergence, "xxhash", fake)
        terms, doc, term, n = divergence.terms_of(texts)
        assert len(set(terms[t] for t in term)) == len(set(term)) and sorted((d, terms[t], c) for d, t, c in zip(doc, term, n, strict=True)) == sorted(want)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 10**14, 500)
    total = count + rng.integers(0, 10**15, 500)
    got = divergence.share(count, total, np.int64(77777))
    assert got.tolist() == [1 + 10**9 * (int(c) + 1) // (int(t) + 77777) for c, t in zip(count, total, strict=True)]


# 13 ------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cent = [list(v) for _, v in sorted(kept, key=name)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for c, vs in groups.items():
            cent[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, c in found:
        total[c] += d
    whole, least = sum(total.values()), lambda x: x if x < 2**63 else None
    return sorted(((i, c, least(d), least(total[c]), least(whole), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, d, c in found), key=str)


@pytest.mark.parametrize("case", ["plain", "ties", "few", "wide", "huge"])
def test_clusters_against_brute_force(spark, case):
    rng, rows = random.Random(6), []
    for i in range(12 if case == "few" else 300):
        v = [rng.choice([-1.0, 0.0, 1.0]) if case == "ties" else rng.gauss(i % 7, 1.5) for _ in range(64)]
        if case == "wide" and i % 9 == 0:
            v[i % 64] = rng.choice([-1, 1]) * 2.0**27
        if case == "huge" and i % 9 == 0:
            v[i % 64] = rng.choice([-3.0e38, 1e30, 2.5e12])
        rows.append((i if i % 31 else None, v))
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [None]), (505, [float("nan")] + [0.0] * 63), (506, [float("inf")] * 64), (7, rows[7][1]), (8, rows[9][1])]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int").repartition(3)
    got = sorted(map(tuple, centroids.cluster(spark, df).collect()), key=str)
    assert got == brute_clusters(rows)
    assert centroids.cluster(spark, df.limit(0)).count() == 0


def test_screening_skips_most_distances_and_changes_none():
    rng = np.random.default_rng(5)
    cent = rng.integers(-300, 300, (16, 64)) * np.repeat(rng.integers(0, 2, (16, 8)), 8, axis=1)
    rows = cent[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 64))
    got, far, done = centroids.nearest(rows, centroids.norms_of(rows), cent)
    d = ((rows[:, None, :] - cent[None]) ** 2).sum(axis=2)
    assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all() and done < 0.5 * d.size
    assert (centroids.bounds(centroids.norms_of(rows), centroids.norms_of(cent)) <= d).all()
