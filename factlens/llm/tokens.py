"""Token ids of a public tokenizer file, word by word, and greedy piece counts by a linear automaton."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C

#: Words that a Python worker remembers.
CACHE = 300_000
END = b"\xff"
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Text for which splitting and lower-casing here is the tokenizer's own: printable ASCII and composed Latin letters.
PLAIN = regex.compile("[!-~À-įı-ɏ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordIds(dict):
    """word (bytes without white space) -> its ids, little-endian unsigned 32-bit; equal to the tokenizer's on whole texts."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        self.path, self.pieces = path, {}
        with open(path) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        #: Ids of this vocabulary fit into this kind of number.
        self.kind = "<u2" if max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or ())]) < 1 << 16 else "<u4"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, i in vocab.items():
            last = len(token) > 4 and token.endswith("</w>")
            ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + END * last] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            low = text.lower()
            out = b"".join(self._piece(p) for p in ((low,) if low.isalpha() else SPLIT.findall(low)))
        else:
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out

    def _piece(self, p: str) -> bytes:
        if (out := self.pieces.get(p)) is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            out = self.pieces[p] = np.array(self.piece(p.encode() + END), "<u4").tobytes()
        return out

    def text(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class PieceCounts(dict):
    """word -> number of its greedy longest-match pieces, by an automaton linear in the word's bytes.

    The trie holds the pieces (bytes; a word starts with the vocabulary's word mark) and all single bytes, so an
    unknown character counts its bytes. A node that is a piece fails to the root and pops one piece; another
    node pops what its parent's failure chain pops until the chain has its last byte.
    """

    def __init__(self, pieces: list[bytes], mark: bytes):
        super().__init__()
        self.mark, self.step, self.fail, self.pops = mark, {}, [0], [0]
        ends, parent, last = {0}, [0], [0]
        for piece in sorted({*pieces, *(bytes([b]) for b in range(256))} - {b""}):
            node = 0
            for b in piece:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(parent)
                    parent.append(node)
                    last.append(b)
                    self.fail.append(0)
                    self.pops.append(0)
                node = nxt
            ends.add(node)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if v in ends:
                self.pops[v] = 1
                continue
            u, n = self.fail[parent[v]], self.pops[parent[v]]
            while u << 8 | last[v] not in self.step:
                u, n = self.fail[u], n + self.pops[u]
            self.fail[v], self.pops[v] = self.step[u << 8 | last[v]], n

    def count(self, word: bytes) -> int:
        u, n, step = 0, 0, self.step
        for b in word:
            while (v := step.get(u << 8 | b)) is None:
                n += self.pops[u]
                u = self.fail[u]
            u = v
        while u:
            n += self.pops[u]
            u = self.fail[u]
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = self.count(self.mark + word)
        return n


MARK = "▁".encode()


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> tuple[bytes, ...]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(list(piece_vocabulary(path)), MARK)


COUNTS = "doc_id long, n_words long, n_tokens long"


def count_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of `docs` (doc_id, text): greedy longest-match pieces of each word.

    `path`: a sentence-piece model whose vocabulary is used, present on every machine. A null or empty text counts
    nothing; a null doc_id stays null; repeated rows count alike. Words are split at space and \\t to \\r.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_counts(path or default_pieces())
        for batch in batches:
            words = [C.words_of(t) for t in C.as_bytes(batch.column("text"))]
            yield C.record(COUNTS, doc_id=batch.column("doc_id").to_pylist(), n_words=[len(w) for w in words], n_tokens=[sum(map(known.__getitem__, w)) for w in words])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, COUNTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts of all documents; nulls, ties, repeats and empty tables as in count_pieces."""
    C.limit_batches(spark)
    return count_pieces(C.table(spark, sf_dir, "documents"))
