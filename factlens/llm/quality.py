"""Quality rules: base counts of a text, and a linear-chain CRF whose Viterbi path marks lines as content or boilerplate.

Labels are given for documents, the chain needs them for lines. Lines of good documents are content, but for those that read
as a notice (licence, copyright, cookies, sign-in). In a bad document the lines that look like content by a logistic
regression over all lines are content, and the others, one at least, are boilerplate. So sequences change state, and
the chain learns when they do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C

#: Labelled documents used for learning, at most: a sample by hash of doc_id. All other work covers all rows.
TRAIN_DOCS = 4000
#: Lines of a training sequence; a longer document is several sequences. At most TRAIN_SEQUENCES of all sequences, the first by
#: a hash of document and place, are learned from, which bounds what goes to the driver to 13 MB.
TRAIN_LINES, TRAIN_SEQUENCES = 64, 4096
CONTENT_SHARE = 0.5
#: How notices read.
NOTICE = re.compile(rb"licen[cs]ed under|under the .{0,40}licen[cs]e|copyright|all rights reserved|\xc2\xa9|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|sign in|log ?in\b", re.IGNORECASE)
SYMBOLS = b"#*$%&|<>"
SHOUT = re.compile(rb"[!?]{2,}")
LINK = re.compile(rb"://|www\.|@")
LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")
N_FEATURES = 13


def line_features(line: bytes, times: int, first: bool, last: bool) -> list[float]:
    words = line.split()
    text = line.decode()
    n, w = max(1, len(text)), max(1, len(words))
    letters = len(LETTER.findall(text))
    upper = sum(map(str.isupper, text))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    return [
        1.0,
        upper / max(1, letters) if letters else 0.0,
        float(letters > 8 and upper > 0.7 * letters),
        min(1.0, 10 * symbols / n),
        float(line.count(b"|") >= 2),
        min(1.0, len(SHOUT.findall(line)) / w * 2),
        min(2.0, letters / w / 6),
        min(2.0, np.log1p(w) / 3),
        float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        float(times > 1),
        min(1.0, 5 * len(DIGIT.findall(text)) / n),
        float(LINK.search(line) is not None) + 0.1 * first + 0.1 * last,
        float(NOTICE.search(line) is not None),
    ]


def lines_of(text: bytes | None) -> list[bytes]:
    """\\n-split lines with a word."""
    return [x for x in text.split(b"\n") if x.split()] if text else []


def document_features(text: bytes | None) -> list[list[float]]:
    lines = lines_of(text)
    times, end = Counter(lines), len(lines) - 1
    known: dict = {}
    out = []
    for i, x in enumerate(lines):
        key = (x, i == 0, i == end)
        if key not in known:
            known[key] = line_features(x, times[x], i == 0, i == end)
        out.append(known[key])
    return out


@dataclass(frozen=True)
class Chain:
    """Weights of states (boilerplate, content) on features, and of transitions; empty: everything is content."""

    node: tuple[tuple[float, ...], ...] = ()
    step: tuple[tuple[float, ...], ...] = ()

    def viterbi(self, xs: list[list[float]]) -> list[int]:
        """The likeliest states of the lines; of ties, content."""
        if not self.node:
            return [1] * len(xs)
        (s00, s01), (s10, s11) = self.step
        scores = (np.array(xs) @ np.array(self.node).T).tolist()
        a, b = scores[0]
        back = []
        for p, q in scores[1:]:
            f0, f1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((f0, f1))
            a, b = (b + s10 if f0 else a + s00) + p, (b + s11 if f1 else a + s01) + q
        out = [1 if b >= a else 0]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]


def fit_chain(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, ridge: float = 1e-5) -> Chain:
    """Maximum likelihood by Adam over (features of the lines, state of each) of sequences; the same data give the same weights."""
    theta = np.zeros(2 * N_FEATURES + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    packs = [_padded([s for s in sequences if low < len(s[1]) <= high]) for low, high in zip((0, 4, 12, 32), (4, 12, 32, 1 << 30), strict=True)]
    for t in range(1, rounds + 1):
        grad = _gradient(theta, [p for p in packs if p]) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Chain(tuple(map(tuple, theta[: 2 * N_FEATURES].reshape(2, -1).round(9).tolist())), tuple(map(tuple, theta[2 * N_FEATURES :].reshape(2, 2).round(9).tolist())))


def _padded(sequences: list) -> tuple | None:
    """Features, mask and states of sequences of like lengths."""
    if not sequences:
        return None
    length = max(len(y) for _, y in sequences)
    xs, mask, gold = np.zeros((len(sequences), length, N_FEATURES)), np.zeros((len(sequences), length)), np.zeros((len(sequences), length, 2))
    for i, (x, y) in enumerate(sequences):
        xs[i, : len(y)], mask[i, : len(y)], gold[i, np.arange(len(y)), y] = x, 1, 1
    return xs, mask, gold


def _gradient(theta: np.ndarray, packs: list) -> np.ndarray:
    """Gradient of the mean log likelihood of a line's state, by the forward and backward sums."""
    w, s = theta[: 2 * N_FEATURES].reshape(2, -1), theta[2 * N_FEATURES :].reshape(2, 2)
    total, weight = np.zeros_like(theta), 0.0
    for xs, mask, gold in packs:
        n, length, _ = xs.shape
        node = xs @ w.T
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = node[:, 0]
        for i in range(1, length):
            new = np.logaddexp(fwd[:, i - 1, 0, None] + s[0], fwd[:, i - 1, 1, None] + s[1]) + node[:, i]
            fwd[:, i] = np.where(mask[:, i, None] > 0, new, fwd[:, i - 1])
        for i in range(length - 2, -1, -1):
            nxt = bwd[:, i + 1] + node[:, i + 1]
            new = np.logaddexp(s[None, :, 0] + nxt[:, None, 0], s[None, :, 1] + nxt[:, None, 1])
            bwd[:, i] = np.where(mask[:, i + 1, None] > 0, new, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pp = np.exp(fwd[:, :-1, :, None] + s + (node + bwd)[:, 1:, None, :] - z[:, None, None, None]) * (mask[:, 1:] * mask[:, :-1])[:, :, None, None]
        pairs = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        total += np.concatenate((np.einsum("nls,nlf->sf", gold - p, xs).ravel(), (pairs - pp).sum(axis=(0, 1)).ravel()))
        weight += mask.sum()
    return total / weight


def line_states(x: np.ndarray, good: np.ndarray, notice: np.ndarray, owner: np.ndarray, rounds: int = 3) -> np.ndarray:
    """States of lines (1: content) from the labels of their documents; owner: the sequence of a line, ascending."""
    y = (good & ~notice).astype(float)
    first = C.segments(owner[1:] != owner[:-1])
    for _ in range(rounds):
        p = _content_odds(x, y)
        worst = p == np.repeat(np.minimum.reduceat(p, first), np.diff(np.append(first, len(owner))))
        y = np.where(good, ~notice, (p > 0) & ~worst & ~notice).astype(float)
    return y.astype(np.int64)


def _content_odds(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Log odds of state 1 of every line, by a regression that gives both states the same weight."""
    n = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return x @ w


SHAPES = "doc_id long, quality int, at int, x binary, notice binary"


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, sequences: int = TRAIN_SEQUENCES) -> Chain:
    """A chain from labelled documents: at most about `most` of them, half of each label where there are enough, by hash of doc_id.

    Labels other than 0 and 1, and of no doc_id, do not count; nor do those of a doc_id that has both. Repeated labels are one.
    Of several texts of a doc_id each is used, of null or empty ones there are no lines. Without lines of documents of both labels
    the chain is empty.
    """
    usable = C.one_label(labels, "quality")
    count = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(count) < 2:
        return Chain()
    share = F.when(F.col("quality") == 1, F.lit(int(1e6 * min(1.0, most / 2 / count[1])))).otherwise(int(1e6 * min(1.0, most / 2 / count[0])))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SHAPES.split(", ")}
            for doc_id, quality_, t in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
                lines, x = lines_of(t), np.array(document_features(t), "<f4")
                notice = np.array([NOTICE.search(line) is not None for line in lines], np.uint8)
                for a in range(0, len(lines), TRAIN_LINES):
                    for c, v in zip(out.values(), (doc_id, quality_, a, x[a : a + TRAIN_LINES].tobytes(), notice[a : a + TRAIN_LINES].tobytes()), strict=True):
                        c.append(v)
            yield C.record(SHAPES, **out)

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").mapInArrow(shape, SHAPES)
    rows = shaped.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "x").limit(sequences).collect()
    if len({r.quality for r in rows}) < 2:
        return Chain()
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    sizes = [len(x) for x in xs]
    good, notice = np.repeat([r.quality == 1 for r in rows], sizes), np.frombuffer(b"".join(r.notice for r in rows), np.uint8) > 0
    states = line_states(np.concatenate(xs), good, notice, np.repeat(np.arange(len(rows)), sizes))
    return fit_chain(list(zip(xs, np.split(states, np.cumsum(sizes)[:-1]), strict=True)))


def repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words in windows of k words that occur twice or more."""
    g = C.ngrams(h, k)
    if len(g) < 2:
        return 0
    _, code, times = np.unique(g, return_inverse=True, return_counts=True)
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(times[code] > 1)
    edge[at] += 1
    np.subtract.at(edge, at + k, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    words = C.words_of(text)
    if not text:
        return 0, 0, 0, 0, 0
    seen, again = set(), 0
    for x in lines_of(text):
        again += x in seen
        seen.add(x)
    repeat = repeated_words(C.word_hashes(words)) if len(words) > 5 else 0
    return len(words), len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS)), again, repeat


def quality(docs: DataFrame, chain: Chain) -> DataFrame:
    """`docs` (text, ...) with the columns of BASE added.

    A null or empty text has no words and fails the base rule; its content share is 0. A text without a chain
    (no labels of both kinds) is all content. Repeated rows are judged alike. Columns of those names are replaced.
    """

    def judge(texts: list) -> list[list]:
        out: list[list] = [[] for _ in range(8)]
        for t in texts:
            n, chars, symbols, dup, repeat = base_counts(t)
            failed = n < 10 or 100 * repeat > 20 * n
            lines = lines_of(t)
            total = sum(map(len, lines))
            share = sum(len(x) for x, s in zip(lines, chain.viterbi(document_features(t)), strict=True) if s) / total if lines else 0.0
            for c, v in zip(out, (n, chars, symbols, dup, repeat, failed, share, not failed and share >= CONTENT_SHARE), strict=True):
                c.append(v)
        return out

    C.limit_batches(docs.sparkSession)
    return C.add_columns(docs, lambda: judge, BASE)


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents; nulls, ties, repeats and empty tables as in learn and quality."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, learn(spark, docs, C.table(spark, sf_dir, "labels"))).drop("text")
