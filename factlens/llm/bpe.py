"""BPE encoding by a trie of words, and decoding.

The encoding of a prefix of a word ends in one token, and what stands before that token is the encoding of the shorter
prefix. So a trie node needs its last token and the node before it, and no more. Distinct words go into the trie in sorted order, which
visits it depth first: each node's state is set when the node is made, from those above it, so that a prefix that words
share is encoded once. A token can follow another if merging both texts together gives just these two, and of all tokens that
end at a node exactly one can follow the state it leans on.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C
from factlens.llm.tokens import PLAIN, SPLIT, default_path

#: What a Python worker remembers: nodes of its trie, words with their ids, pairs of tokens.
NODES, WORDS, PAIRS = 200_000, 300_000, 200_000
#: Longer pieces are encoded alone, without nodes of the trie.
LONG = 256
#: Packs so many ids.
PACK = [struct.Struct(f"<{n}i").pack for n in range(32)]
NEVER = 1 << 60


#: Bytes of the ASCII letters and of the characters from À to ÿ, of which × and ÷ are no letters; their lower case, byte by byte.
LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)])
TIMES, OVER = "×".encode(), "÷".encode()
LOWER = bytes(b + 32 if 65 <= b < 91 or 0x80 <= b < 0x9F else b for b in range(256))
MARKS = b".,;:!?"


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


BYTES = _byte_chars()


def _shared(ordered: list[bytes], most: int = 32) -> list[int]:
    """How many bytes, up to `most`, each word has in common with the one before it."""
    if not ordered:
        return []
    rows = np.array(ordered, f"S{most}").view(np.uint8).reshape(len(ordered), most)
    same = rows[1:] == rows[:-1]
    return [0, *np.where(same.all(axis=1), most, same.argmin(axis=1)).tolist()]


class Bpe:
    """The tokenizer of a file: byte-level BPE with word ends or without, no unknown tokens."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a BPE model of another kind")
        #: Tokens inside a word and at its end, by their bytes. Without word ends both are the same.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {} if suffix else self.inner
        for token, i in vocab.items():
            last = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            name = token[: len(token) - len(suffix)] if last else token
            if all(c in BYTES for c in name):
                (self.final if last else self.inner)[bytes(map(BYTES.__getitem__, name))] = i
        if any(bytes([b]) not in table for b in range(256) for table in (self.inner, self.final)):
            raise ValueError("a vocabulary without all bytes")
        #: Rank of the merge of two tokens; the two that a token is made of; the rank at which it is made.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, z = vocab[left], vocab[right], vocab[left + right]
            if z in self.made or max(self.made.get(a, -1), self.made.get(b, -1)) >= r:
                raise ValueError("merges that are not in the order of their making")
            self.rank[a, b], self.parts[z], self.made[z] = r, (a, b), r
        #: What tokens start with, inside a word and before its last byte.
        self.heads = {t[:i] for t in self.inner for i in range(1, len(t) + 1)} | {t[:i] for t in self.final for i in range(1, len(t))}
        #: States of the automaton over starts of tokens, the tokens that end in each, and its moves, as they are needed.
        self.states, self.state_of, self.ending, self.moves = [b""], {b"": 0}, [[]], {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        #: By state and last byte: the last tokens that a word could end in.
        self.finals: dict[int, list[tuple[int, int]]] = {}
        self._clear_trie()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        if any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(regex.search(r"\s", t) for t in self.special):
            raise ValueError("added tokens of another kind")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.marked = [t.encode() for t in self.special]
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        #: Words of these letters hold no special token.
        letters_only = all(t.encode().translate(None, LETTERS + MARKS) for t in self.special)
        #: Whether the fast way to split words is that of this file: lower case, and the one pattern.
        self.plain = any(n.get("type") == "Lowercase" for n in normal.get("normalizers") or ()) and first.get("pattern") == {"Regex": SPLIT.pattern} and first.get("invert") is True
        self.quick = self.plain and letters_only

    def _clear_trie(self) -> None:
        self.child: dict[int, int] = {}
        #: Of each node: its last token, the node before that token, the state of the automaton.
        self.last, self.back, self.at = [-1], [0], [0]

    # Tokens side by side ---------------------------------------------------------------------------

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """No merge across the boundary before `limit`, while both tokens are made from their bytes.

        A part is at the boundary from the merge that makes it to the merge that uses it up; of equal merges the left one is first.
        """
        a, until = left, limit
        while True:
            b, end = right, limit
            while True:
                m = self.rank.get((a, b))
                if m is not None and m < until and m <= end:
                    return False
                if b not in self.parts:
                    break
                b, end = self.parts[b][0], self.made[b]
            if a not in self.parts:
                return True
            a, until = self.parts[a][1], self.made[a]

    def fits(self, left: int, right: int) -> bool:
        """Whether the texts of both tokens together are encoded as these two; left -1: the start of the word."""
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.is_whole(right) and (left < 0 or self._apart(left, right, NEVER))
        return known

    def is_whole(self, token: int) -> bool:
        """Whether the text of a token is encoded as that token."""
        if (known := self.whole.get(token)) is None:
            a, b = self.parts.get(token, (-1, -1))
            known = self.whole[token] = a < 0 or self.is_whole(a) and self.is_whole(b) and self._apart(a, b, self.made[token])
        return known

    # Words -----------------------------------------------------------------------------------------

    def _state(self, state: int, byte: int) -> int:
        """The automaton's state after one more byte: the longest end of the text so far that a token starts with."""
        text = self.states[state] + bytes([byte])
        while text not in self.heads:
            text = text[1:]
        if (known := self.state_of.get(text)) is None:
            known = self.state_of[text] = len(self.states)
            self.states.append(text)
            self.ending.append([(self.inner[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in self.inner])
        self.moves[state << 8 | byte] = known
        return known

    def _step(self, ending: list[tuple[int, int]], last: list[int], line, end: int) -> tuple[int, int]:
        """(token, its length) of `ending` that ends the encoding of the first `end` bytes; last[line[i]]: the last token of i bytes."""
        known = self.pairs.get
        for t, n in ending:
            left = last[line[end - n]]
            fit = known(left << 20 | t)
            if fit or fit is None and self.fits(left, t):
                return t, n
        raise ValueError("no token ends a word")

    def _final(self, move: int) -> list[tuple[int, int]]:
        """(token, its length) of all last tokens of a word that ends in this byte after this state, the longest first."""
        if len(self.finals) >= PAIRS:
            self.finals.clear()
        text = self.states[move >> 8] + bytes([move & 255])
        found = self.finals[move] = [(self.final[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in self.final]
        return found

    def insert(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces, which are encoded along the trie in sorted order."""
        last, back, at, step, finals = self.last, self.back, self.at, self._step, self.finals
        child, moves, pairs, ending, out = self.child, self.moves, self.pairs, self.ending, {}
        ordered, line = sorted(pieces), [0]
        for p, same in zip(ordered, _shared(ordered), strict=True):
            size = len(p)
            if size > LONG:
                out[p] = self._alone(p)
                line = [0]
                continue
            # The path of the word before is this one's as far as both are the same.
            same = min(same, size - 1, len(line) - 1)
            del line[same + 1 :]
            node = line[same]
            for i, byte in enumerate(p[same:-1], same + 1):
                key = node << 8 | byte
                if key in child:
                    node = child[key]
                else:
                    move = at[node] << 8 | byte
                    state = moves[move] if move in moves else self._state(at[node], byte)
                    for t, n in ending[state]:
                        left = last[line[i - n]]
                        fit = pairs.get(left << 20 | t)
                        if fit or fit is None and self.fits(left, t):
                            break
                    node = child[key] = len(last)
                    last.append(t)
                    back.append(line[i - n])
                    at.append(state)
                line.append(node)
            move = at[node] << 8 | p[-1]
            t, n = step(finals.get(move) or self._final(move), last, line, size)
            node = line[-n]
            if not node:
                out[p] = PACK[1](t)
                continue
            ids = [t]
            while node:
                ids.append(last[node])
                node = back[node]
            ids.reverse()
            out[p] = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}i", *ids)
        return out

    def _alone(self, p: bytes) -> bytes:
        before, size, state, places = [-1], [0], 0, range(len(p) + 1)
        for i, byte in enumerate(p[:-1], 1):
            state = self.moves.get(state << 8 | byte) or self._state(state, byte)
            t, n = self._step(self.ending[state], before, places, i)
            before.append(t)
            size.append(n)
        t, n = self._step(self._final(state << 8 | p[-1]), before, places, len(p))
        ids, at = [t], len(p) - n
        while at:
            ids.append(before[at])
            at -= size[at]
        return np.array(ids[::-1], "<i4").tobytes()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[bytes]:
        """The pieces that are encoded apart, of text without special tokens: normalized and split as the file says."""
        if self.plain and PLAIN.fullmatch(text):
            low = text.lower()
            return [low.encode()] if low.isalpha() else [p.encode() for p in SPLIT.findall(low)]
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(BYTES.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _split_all(self, words) -> dict[bytes, list | tuple]:
        """word -> its parts, as _parts_of has them. Words of plain letters, and of a mark after them, are split here."""
        if not self.quick:
            return {w: self._parts_of(w) for w in words}
        out = {}
        for w in words:
            rest = w.translate(None, LETTERS)
            if len(rest) > 1 or rest and (rest not in MARKS or not w.endswith(rest) or len(w) == 1) or not w.isascii() and (TIMES in w or OVER in w):
                out[w] = self._parts_of(w)
            elif rest:
                out[w] = (w[:-1].translate(LOWER), rest)
            else:
                out[w] = (w.translate(LOWER),)
        return out

    def _parts_of(self, word: bytes) -> list:
        """Pieces (bytes) and ids of special tokens (int) of one word."""
        for t in self.marked:
            if t in word:
                break
        else:
            return self.split(word.decode())
        text, out, at = word.decode(), [], 0
        for m in self.marks.finditer(text):
            out += [*(self.split(text[at : m.start()]) if m.start() > at else ()), self.special[m[0]]]
            at = m.end()
        return out + (self.split(text[at:]) if at < len(text) else [])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of every text, little-endian 32-bit; a null text has none.

        Words end at ASCII white space, across which nothing is normalized, split or merged together.
        """
        out, words = [], self.words
        rows = [t.split() if t else [] for t in texts]
        here = set().union(*rows)
        new = here.difference(words)
        if len(words) + len(new) > WORDS:
            # Words that came back are kept; most others never do.
            words = self.words = {w: words[w] for w in here if w in words}
        parts = self._split_all(new)
        if len(self.last) > NODES:
            self._clear_trie()
        ids = self.insert(list({p for ps in parts.values() for p in ps if type(p) is bytes}))
        for w, ps in parts.items():
            words[w] = ids[ps[0]] if len(ps) == 1 and type(ps[0]) is bytes else b"".join([ids[p] if type(p) is bytes else PACK[1](p) for p in ps])
        for r in rows:
            out.append(b"".join(map(words.__getitem__, r)))
        return out


class Names:
    """What decoding needs of a file: the name of every id."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind}")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or ()}
        #: What each id adds to a text: its name, or its bytes where the file has a byte-level decoder.
        self.table: list[bytes | None] = [None] * (max(names) + 1)
        for i, t in names.items():
            self.table[i] = bytes(map(BYTES.__getitem__, t)) if kind and all(c in BYTES for c in t) else t.encode()
        self.between = b"" if kind else b" "

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ones, or null, add nothing. Without a decoder names are joined by spaces, as the library does."""
        table, top = self.table, len(self.table)
        try:
            found = [table[i] for i in ids]
            if None in found or ids and min(ids) < 0:
                raise TypeError
        except (TypeError, IndexError):
            found = [t for i in ids if i is not None and 0 <= i < top and (t := table[i]) is not None]
        return self.between.join(found).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def names(path: str) -> Names:
    return Names(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` (text, and any other columns) with `ids` array<int> added (replaced if there): the tokenizer's ids of the whole text.

    A null or empty text, or one of white space, has no ids (an empty array). Repeated rows give repeated results; an empty
    table stays empty. Special tokens that stand in a text become their ids, as the library does by default.
    """
    path = path or default_path()

    def start():
        model = bpe(path)

        def judge(texts):
            rows = model.encode(texts)
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))]

        return judge

    C.limit_batches(docs.sparkSession)
    return C.add_columns(docs, start, "ids array<int>")


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """`df` with `decoded` string added (replaced if there): the text of its ids, special tokens included.

    Null ids give null, no ids the empty text; repeated rows give repeated results; an empty table stays empty.
    """
    path, df = path or default_path(), df.drop("decoded")
    boxed = df.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        model = names(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    C.limit_batches(df.sparkSession)
    out = boxed.mapInArrow(C.tidy(run), boxed.drop("ids").withColumn("decoded", F.lit("")).schema)
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns], "decoded")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `docs` (doc_id, text): encoded and decoded in one pass.

    The digests are of the ids in decimal, joined by one space, and of the decoded text. A null text has no ids, so both are of the empty text.
    Repeated rows give repeated results; an empty table stays empty; other columns are not read.
    """
    path = path or default_path()

    def run(batches):
        model, table = bpe(path), names(path)
        decimal = [str(i).encode() for i in range(len(table.table))]
        for batch in batches:
            out = ([], [], [])
            for raw in model.encode(C.as_bytes(batch.column("text"))):
                ids = np.frombuffer(raw, "<i4").tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                out[2].append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield C.record(DIGESTS, doc_id=batch.column("doc_id").to_pylist(), n_tokens=out[0], ids_sha256=out[1], decoded_sha256=out[2])

    C.limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.tidy(run), DIGESTS)


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document; nulls, repeats and empty tables as in digests."""
    return digests(C.table(spark, sf_dir, "documents"))
