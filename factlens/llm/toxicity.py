"""Toxicity by a fuzzy lexicon: Levenshtein automata walk a trie of terms; context windows tell quotation from abuse.

The lexicon comes from labels: terms that toxic training documents have far more often than others. Every term has a
weight (its log odds). Misspelled words are found by running the Levenshtein automaton of the word along the trie of
terms. Words near a hit decide its share: quotation marks, reporting verbs and negation make it a quotation, second
persons and intensity make it abuse. A logistic regression over the sums gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm import jaccard

#: Labelled rows used for learning, at most: a sample by hash of doc_id. All other work covers all rows.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
#: Terms and covered words of the lexicon, at most; the strongest that are left after all tests are kept. This bounds what is broadcast.
TERMS = 20_000
WINDOW = 6
#: A term that ends in STEM stands for all longer words that start with it; stems of these lengths are tried.
STEM, STEMS = "*", (4, 5, 6, 7, 8)
CACHE = 200_000
#: Words of texts that are looked up together.
LOOKED_UP = 100_000
#: Words that mark reported speech or denial, and words that address somebody.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes reported term word words sagte schrieb nannte zitat wort dit disait écrit appelé citation mot dijo escribió llamó cita palabra not never nicht nie pas jamais nunca".split())
ADDRESSING = frozenset("you your yours u ur youre du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros eres".split())
CONTEXT = dict.fromkeys(ADDRESSING, "address") | dict.fromkeys(REPORTING, "report")
QUOTES = "\"'“”„‟«»‹›‘’‚`"
EDGE = "!#$%&()*+,-./:;<=>?@[]^_{|}~\\…–—¿¡·•" + QUOTES


def normal(word: str) -> str:
    """A-Z and others lower-cased, without punctuation at the ends."""
    return word.lower().strip(EDGE)


def edits(length: int) -> int:
    """Misspellings allowed in a word of so many characters; a word of three can only come from a term of four."""
    return 0 if length < 3 else 1 if length < 9 else 2


#: Shorter terms are found as they are only.
LEAST_FUZZY = 4


class Trie:
    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for c in term.removesuffix(STEM):
                node = node.setdefault(c, {})
            node[STEM * 2 if term.endswith(STEM) else ""] = (term, weight)

    def search(self, word: str, most: int) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term within `most` edits; of ties the heaviest, then the first by name.

        The automaton's state is `most` + 1 bit sets: bit i of set e says that the first i characters of the word reach
        this node with e edits. A branch ends where the last set, which has the others in it, is empty. A stem is found
        where a start of the word, not all of it, reaches its node with the edits of a word of the stem's length.
        """
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, end = (1 << len(word) + 1) - 1, 1 << len(word)
        best: tuple | None = None
        stack = [(self.root, tuple((1 << e + 1) - 1 for e in range(most + 1)))]
        while stack:
            node, sets = stack.pop()
            for c, child in node.items():
                if len(c) != 1:
                    here, allowed = (end, most) if c == "" else (end - 1, min(most, edits(len(child[0]) - 1)))
                    for e, bits in enumerate(sets[: allowed + 1]):
                        if bits & here:
                            found = (e, -child[1], child[0])
                            best = found if best is None else min(best, found)
                            break
                    continue
                same = at.get(c, 0)
                new = [(sets[0] & same) << 1]
                for e in range(1, most + 1):
                    new.append(((sets[e] & same) << 1 | sets[e - 1] | sets[e - 1] << 1 | new[e - 1] << 1 | new[e - 1]) & full)
                if new[most]:
                    stack.append((child, tuple(new)))
        return (best[0], -best[1]) if best else None


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[tuple[str, float], ...]
    weights: tuple[float, ...] = ()
    version: str = ""
    #: Words that a stem stands for: their misspellings are sought, the words themselves weigh as the stem.
    covered: tuple[tuple[str, float], ...] = ()


#: Buckets of characters of a bag.
BAG = 32


def bags(words: list[str], most: int | None = None) -> np.ndarray:
    """How many characters of each bucket a word has, of its first `most` ones only where given: (words, BAG)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & (BAG - 1)
    owner = np.repeat(np.arange(len(words)), sizes)
    if most is not None:
        ok = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most
        chars, owner = chars[ok], owner[ok]
    return np.bincount(owner * BAG + chars, minlength=len(words) * BAG).reshape(-1, BAG).astype(np.int16)


def codes(bag: np.ndarray) -> np.ndarray:
    """64 bits of each bag: which buckets have a character, and which have two. Bags that differ by n characters differ in n bits at most."""
    bits = np.uint64(1) << np.arange(BAG, dtype=np.uint64)
    return ((bag >= 1) * bits).sum(axis=1, dtype=np.uint64) | ((bag >= 2) * bits).sum(axis=1, dtype=np.uint64) << np.uint64(BAG)


class Matcher(dict):
    """word bytes -> 0 for none, or (edits, weight); context words -> their kind.

    Two words within so many edits differ by at most twice as many characters, taken as bags; so do the starts that a
    stem asks for. Words are tested so against all terms at once, by 64 bits of a bag before the bag itself, and only the
    terms that pass make the trie that a word's automaton goes along.
    """

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.terms = dict(lexicon.terms)
        self.stems = {t[:-1]: w for t, w in self.terms.items() if t.endswith(STEM)}
        whole = {t: w for t, w in (lexicon.covered + lexicon.terms) if not t.endswith(STEM) and len(t) >= LEAST_FUZZY}
        self.whole, self.starts = list(whole.items()), [(t + STEM, w) for t, w in self.stems.items()]
        self.whole_bags, self.start_bags = bags([t for t, _ in self.whole]), bags([t[:-1] for t, _ in self.starts])
        self.whole_codes, self.start_codes = codes(self.whole_bags), codes(self.start_bags)

    def near(self, words: list[str]) -> dict[int, list[tuple[str, float]]]:
        """Index of a word -> the terms that may be within its edits."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sizes, words = sizes[order], [words[i] for i in order]
        allowed, found = np.where(sizes < 9, 1, 2), {}

        def put(terms, at, term):
            for i in at.tolist():
                found.setdefault(int(order[i]), []).append(terms[term])

        bag = bags(words)
        code, most = codes(bag), 2 * allowed
        lengths = [len(t) for t, _ in self.whole]
        bounds = dict(zip(lengths, np.searchsorted(sizes, [(n - 2, n + 3) for n in lengths]).tolist(), strict=True)) if lengths else {}
        for j, n in enumerate(lengths):
            a, b = bounds[n]
            at = a + np.flatnonzero(np.bitwise_count(code[a:b] ^ self.whole_codes[j]) <= most[a:b])
            at = at[(np.abs(bag[at] - self.whole_bags[j]).sum(axis=1) <= most[at]) & (np.abs(sizes[at] - n) <= allowed[at])]
            put(self.whole, at, j)
        for n in sorted({len(t) - 1 + d for t, _ in self.starts for d in (-1, 0, 1)}):
            a = int(np.searchsorted(sizes, n, side="right"))
            start = bags(words[a:], n)
            code = codes(start)
            for j, (t, _) in enumerate(self.starts):
                if abs(len(t) - 1 - n) <= 1:
                    at = np.flatnonzero(np.bitwise_count(code ^ self.start_codes[j]) <= 2)
                    put(self.starts, a + at[np.abs(start[at] - self.start_bags[j]).sum(axis=1) <= 2], j)
        return found

    def add(self, raws) -> None:
        """Looks up the words that are not known yet, together."""
        new = [w for w in raws if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(raws)
        if not new:
            return
        texts = b"\n".join(new).decode().split("\n")
        words = [w.strip(EDGE) for w in "\n".join(texts).lower().split("\n")]
        self.update(dict.fromkeys(new, 0))
        for i, (t, w) in enumerate(zip(texts, words, strict=True)):
            if w in CONTEXT:
                self[new[i]] = (CONTEXT[w],)
            elif t[0] in QUOTES or t[-1] in QUOTES:
                self[new[i]] = ("quote",)
        if not self.terms:
            return
        weights = {i: self.terms[w] for i, w in enumerate(words) if w in self.terms}
        for n in {len(t) for t in self.stems}:
            for i, w in enumerate(words):
                if w[:n] in self.stems and len(w) > n:
                    weights[i] = max(weights.get(i, 0.0), self.stems[w[:n]])
        for i, weight in weights.items():
            self[new[i]] = ("hit", 0, weight, any(c in QUOTES for c in texts[i]))
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= 3 and i not in weights:
                at.setdefault(w, []).append(i)
        far = list(at)
        for j, terms in self.near(far).items():
            if (got := Trie(dict(terms)).search(far[j], edits(len(far[j])))) is not None:
                for i in at[far[j]]:
                    self[new[i]] = ("hit", got[0], got[1], any(c in QUOTES for c in texts[i]))

    def __missing__(self, raw: bytes):
        self.add([raw])
        return self[raw]


FEATURES = 8


def features(words: list[bytes], known: Matcher) -> list[float]:
    """Sums over a document: exact, misspelled, quoted, addressed hits, their weights, the heaviest, and density."""
    got = [known[w] for w in words]
    at = [i for i, g in enumerate(got) if g]
    exact = fuzzy = quoted = addressed = weight = top = 0.0
    for p, i in enumerate(at):
        g = got[i]
        if g[0] != "hit":
            continue
        lo, hi, marks, report, address = p, p + 1, int(g[3]), 0, 0
        while lo and i - at[lo - 1] <= WINDOW:
            lo -= 1
        while hi < len(at) and at[hi] - i <= WINDOW:
            hi += 1
        for j in at[lo:hi]:
            kind = got[j][0]
            marks += kind == "quote"
            report += kind == "report"
            address += kind == "address"
        share = 0.25 if marks and (report or not address) and marks > 1 else 0.5 if report and not address else 1.0
        worth = share * g[2] / (1 + g[1])
        exact += g[1] == 0
        fuzzy += g[1] > 0
        quoted += share < 1
        addressed += address > 0
        weight += worth
        top = max(top, worth)
    hits = exact + fuzzy
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), math.log1p(weight), top / 5, 100 * hits / max(50, len(words)), float(hits > 0)]


def all_features(texts: list, known: Matcher) -> list[list[float]]:
    """The features of every text; the words of texts that come together are looked up together."""
    out, held, n = [], [], 0
    for i, t in enumerate(texts):
        held.append(C.words_of(t))
        n += len(held[-1])
        if n >= LOOKED_UP or i == len(texts) - 1:
            known.add(set().union(*held))
            out += [features(w, known) for w in held]
            held, n = [], 0
    return out


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms of `train` (doc_id, text, toxic) by a binomial test; weight: smoothed log odds."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        chars = 0
        known: dict[bytes, str] = {}
        for batch in batches:
            if len(known) > CACHE:
                known.clear()
            for text, toxic in zip(C.as_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = {known.get(w) or known.setdefault(w, normal(w.decode())) for w in set(C.words_of(text))}
                for w in words | {w[:n] + STEM for w in words for n in STEMS if n < len(w)}:
                    if w:
                        if w not in held:
                            held[w] = [0, 0]
                            chars += len(w)
                        held[w][toxic] += 1
                if len(held) > 2 * CACHE or chars > 64 * CACHE:
                    yield _counts(held)
                    held, chars = {}, 0
        yield _counts(held)

    counts = train.mapInArrow(C.tidy(terms), "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    size = train.groupBy("toxic").count().collect()
    docs = {r.toxic: r["count"] for r in size}
    bad, clean = docs.get(1, 0), docs.get(0, 0)
    if not bad or not clean:
        return Lexicon(())
    base = bad / (bad + clean)
    several = C.Scratch(train.sparkSession, "terms").write(counts.filter("bad >= 2"), "several")
    tried = max(1, several.count())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = lru_cache(maxsize=CACHE)(lambda k, n: _tail(k, n, base))
        for batch in batches:
            ok = [tail(b, b + c) * tried <= FALSE_TERMS for b, c in zip(batch.column("bad").to_pylist(), batch.column("clean").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    # Three times the base rate is asked for as well.
    likely = several.filter(F.col("bad") > 3 * base * (F.col("bad") + F.col("clean"))).mapInArrow(C.tidy(passed), several.schema)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    return strongest(pruned([(r.term, r.bad, round(r.odds, 6)) for r in likely.withColumn("odds", odds).collect()]))


def strongest(lexicon: Lexicon) -> Lexicon:
    """At most TERMS terms and covered words: terms first, then by weight."""
    if len(lexicon.terms) + len(lexicon.covered) <= TERMS:
        return lexicon
    terms, covered = (sorted(x, key=lambda t: (-t[1], t[0])) for x in (lexicon.terms, lexicon.covered))
    return replace(lexicon, terms=tuple(sorted(terms[:TERMS])), covered=tuple(sorted(covered[: max(0, TERMS - len(terms))])))


def pruned(found: list[tuple[str, int, float]]) -> Lexicon:
    """Terms (term, toxic documents, odds) without those that others stand for.

    A stem goes if one word has most of its documents, or a longer stem most of them at clearly higher odds. Longer
    stems go under a stem that is left with like odds. Words there are kept as covered, for their misspellings.
    """
    words = {t: b for t, b, _ in found if not t.endswith(STEM)}
    stems = {t[:-1]: (b, o) for t, b, o in found if t.endswith(STEM)}
    best: dict[str, int] = {}
    for w, b in words.items():
        for n in STEMS:
            if n < len(w):
                best[w[:n]] = max(best.get(w[:n], 0), b)
    longer: dict[str, list[tuple[int, float]]] = {}
    for t, x in stems.items():
        for n in STEMS:
            if n < len(t):
                longer.setdefault(t[:n], []).append(x)
    kept: dict[str, tuple[int, float]] = {}
    for s, (b, o) in stems.items():
        if b <= 1.3 * best.get(s, 0) or any(y > o + 0.5 and x >= 0.7 * b for x, y in longer.get(s, ())):
            continue
        kept[s] = (b, o)
    covered = lambda t, o: any(t[:n] in kept and kept[t[:n]][1] >= o - 0.5 for n in STEMS if n < len(t))
    known = [(s + STEM, o) for s, (_, o) in kept.items() if not covered(s, o)] + [(t, o) for t, _, o in found if not t.endswith(STEM) and not covered(t, o)]
    return Lexicon(tuple(sorted(known)), covered=tuple(sorted((t, o) for t, _, o in found if not t.endswith(STEM) and covered(t, o))))


def _counts(held: dict) -> pa.RecordBatch:
    return C.record("term string, clean long, bad long", term=list(held), clean=[c for c, _ in held.values()], bad=[b for _, b in held.values()])


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, by its first terms."""
    total, log = 0.0, [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 200) + 1)]
    for x in log:
        total += math.exp(x)
    return total


#: False terms that the tests of all terms may let in, on average.
FALSE_TERMS = 0.2
#: Documents whose three-word shingles are at least so alike, in percent, are copies.
COPIES = 80


def one_of_copies(spark: SparkSession, train: DataFrame) -> DataFrame:
    """`train` (doc_id, text, toxic) with one document, of the smallest doc_id, of each label in each group of copies.

    A group of copies is one piece of evidence: else any rare word of a toxic text that was copied often looks toxic.
    Groups are those of op 4's exact join, so what merely shares a line or a passage stays. Only learning uses this;
    all documents are scored.
    """
    texts = train.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).withColumn("key", F.xxhash64("text"))
    texts = C.Scratch(spark, "copies").write(texts, "texts")
    groups = jaccard.jaccard_components(spark, texts.select(F.col("key").alias("doc_id"), "text").distinct(), k=3, percent=COPIES).select(F.col("doc_id").alias("key"), "component_id").distinct()
    kept = texts.select("toxic", "key", "doc_id").join(groups, "key").groupBy("toxic", "component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("toxic", "least.key")
    return texts.join(kept, ["toxic", "key"], "left_semi").select("doc_id", "text", "toxic")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon and regression from labelled documents that are not held out; at most about `rows` of them, by hash.

    Labels other than 0 and 1, and of no doc_id, do not count; nor do those of a doc_id that has both. Repeated labels are
    one. Of several texts of a doc_id each is used. With no document of one of the labels there are no terms, and an empty table gives the empty model.
    """
    usable = C.one_label(labels, "toxic").filter(~held_out())
    total = usable.count()
    share = min(1.0, rows / total) if total else 1.0
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    train = C.Scratch(spark, "toxicity").write(one_of_copies(spark, train), "train")
    lexicon = learn_lexicon(train)
    if not lexicon.terms:
        return lexicon

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(all_features(C.as_bytes(batch.column("text")), known), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows_ = train.mapInArrow(C.tidy(shape), "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    return replace(lexicon, weights=tuple(logistic(np.array([r.x for r in rows_]), np.array([r.toxic for r in rows_], float), np.array([r["count"] for r in rows_], float))))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept, by Newton steps with a ridge; n: how often a row occurs."""
    z = np.column_stack((x, np.ones(len(x))))
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (y - p)) - pull * w
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(pull), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` (doc_id, text, ...) with score and n_hits added.

    score: 0 to 1. With no model (no labels of either kind) it is 0. A null or empty text has no hits and gets the score
    of a text without hits. Repeated rows score alike. Whole texts are read. Columns named score or n_hits are replaced.
    """
    weights = np.array(lexicon.weights)

    def start():
        known = Matcher(lexicon)

        def judge(texts: list) -> tuple[list, list]:
            if not len(weights):
                return [0.0] * len(texts), [0] * len(texts)
            xs = all_features(texts, known)
            z = np.clip(np.array(xs).reshape(-1, FEATURES) @ weights[:-1] + weights[-1], -30, 30)
            return (1 / (1 + np.exp(-z))).tolist(), [round(math.expm1(x[0]) + math.expm1(x[1])) for x in xs]

        return judge

    C.limit_batches(docs.sparkSession)
    return C.add_columns(docs, start, "score double, n_hits long")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, ties, repeats and empty tables as in learn and score_toxicity. A null doc_id is not held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(spark, docs, C.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
