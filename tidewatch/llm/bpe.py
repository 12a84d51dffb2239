"""Byte-level BPE encoding and decoding by a dynamic programme over prefixes.

For each prefix of a piece exactly one token can be the last of its encoding. An automaton over the vocabulary gives the
tokens that are suffixes of the prefix, longest first; the first one that may follow the last token of what stands before
it is kept, and the encoding is read off backwards. Whether two tokens may stand side by side is found by undoing merges
at their border. Time is linear in the text, whatever its length.

Null is encoded as the empty text: no ids. The strings of special tokens become those tokens. Every id decodes to its
bytes; bytes that are not UTF-8 become U+FFFD, unknown ids and null decode to nothing.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import kept, lean, ship, table

#: Bounds on what a worker remembers, in entries: of what stands between spaces, of pieces of it, and of pairs of tokens;
#: together about 70 MB beside the tokenizer's 45 MB.
UNITS, WORDS, PAIRS, LONGEST_UNIT = 150_000, 20_000, 250_000, 48
#: Fixed value: the split into pieces that byte-level vocabularies of this kind are made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such a vocabulary: itself, or the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Tokenizer:
    def __init__(self, spec: str):
        import ahocorasick
        import regex

        spec = json.loads(spec)
        model, self.letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        back = {c: b for b, c in self.letters.items()}
        self.bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        #: By id: its rank, and the two parts it is merged from.
        self.rank = {vocab[c]: -1 for c in self.letters.values() if c in vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for n, (x, y) in enumerate(merges):
            whole, pair = vocab[x + y], (vocab[x], vocab[y])
            self.pairs.setdefault(pair, n)
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = n, pair
        self.automaton = ahocorasick.Automaton()
        #: What is known of each token: after which others it may stand.
        self.after, self.known = [], 0
        self.sizes = {i: len(t) for t, i in vocab.items()}
        for t, i in vocab.items():
            if i in self.rank:
                self.after.append({})
                self.automaton.add_word(t, (i, len(t), self.after[-1]))
        self.automaton.make_automaton()
        self.table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.pieces = regex.compile(PIECES).findall
        self.odd, self.joints = re.compile(r"[^\S \n]").search, re.compile(r"(?<=\S) (?=\S)").split
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        #: The last pieces seen and those before them.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.units = _Units(self)

    def compatible(self, left: int, right: int, after: dict[int, bool]) -> bool:
        """Whether merging leaves these two side by side: no merge across the border comes before those that made them.

        Undoes the later of the two outermost merges again and again; a merge across that border with a rank below
        what was undone so far would have been taken first. On equal ranks the left one was made first.
        """
        first = left
        rank, parts, pairs = self.rank, self.parts, self.pairs
        bound, tied, ok = 1 << 60, False, True
        while True:
            across = pairs.get((left, right))
            if across is not None and (across < bound or tied and across == bound):
                ok = False
                break
            p, q = rank[left], rank[right]
            if p < 0 and q < 0:
                break
            # the right token's own merge lies behind the border: at an equal rank the border, further left, goes first
            if p > q:
                bound, tied, left = p, False, parts[left][1]
            else:
                bound, tied, right = q, True, parts[right][0]
        if self.known >= PAIRS:
            for x in self.after:
                x.clear()
            self.known = 0
        self.known += 1
        after[first] = ok
        return ok

    def word(self, piece: str) -> bytes:
        """The ids of one piece, as packed 32-bit numbers."""
        known = self.words.get(piece) or self.older.get(piece)
        if known is None:
            known = self.cheapest(piece)
            if len(piece) <= LONGEST_UNIT:
                if len(self.words) >= WORDS:
                    self.words, self.older = {}, self.words
                self.words[piece] = known
        return known

    def cheapest(self, piece: str) -> bytes:
        """The ids that the programme finds."""
        if piece.isascii() and piece.isprintable():
            s = piece.replace(" ", self.letters[32])
        else:
            s = piece.encode().decode("latin-1").translate(self.table)
        last, at = [], -1
        add = last.append
        for end, (token, size, after) in self.automaton.iter(s):
            if end != at:  # else the last token of this prefix is known
                start = end - size
                if start < 0:
                    add(token)
                    at = end
                else:
                    before = last[start]
                    ok = after.get(before)
                    if ok or ok is None and self.compatible(before, token, after):
                        add(token)
                        at = end
        ids, k, sizes = [], len(s) - 1, self.sizes
        while k >= 0:
            ids.append(token := last[k])
            k -= sizes[token]
        ids.reverse()
        return struct.pack(f"={len(ids)}i", *ids)

    def unit(self, text: str) -> bytes:
        """What stands between spaces is kept whole, so its one piece needn't be."""
        if text[1:].isalpha() and text[0] == " ":
            return self.cheapest(text)
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in ".,":
            return (self.units.get(text[1:-1]) or self.cheapest(text[:-1])) + self.word(text[-1])
        return b"".join(map(self.word, self.pieces(text)))

    def plain(self, text: str) -> bytes:
        """No piece reaches over a space between two characters that aren't space, so texts are cut there first."""
        odd = "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or self.odd(text)
        units = self.joints(text) if odd else text.split(" ")
        return self.unit(units[0]) + b"".join(map(self.units.__getitem__, units[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.cut is None or not any(t in text for t in self.special):
            return np.frombuffer(self.plain(text), np.int32)
        out = [np.array([self.special[x]], np.int32).tobytes() if x in self.special else self.plain(x) for x in self.cut(text) if x]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int] | None) -> str:
        if ids is None:
            return ""
        try:
            raw = b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


class _Units(dict):
    """By what follows a space up to the next one: the ids of both. What was last used before it was full is kept aside."""

    def __init__(self, tokenizer: Tokenizer):
        self.unit, self.older = tokenizer.unit, {}

    def __missing__(self, rest: str) -> bytes:
        packed = self.older.get(rest) or self.unit(" " + rest)
        if len(rest) <= LONGEST_UNIT:
            if len(self) >= UNITS:
                self.older = dict(self)
                self.clear()
            self[rest] = packed
        return packed


def _tokenizer(spec) -> Tokenizer:
    return kept(("bpe", hash(spec.value)), lambda: Tokenizer(spec.value))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def _spec(spark: SparkSession, path: str):
    """The tokenizer's file is read on the driver and broadcast: it is of a fixed size, whatever the corpus."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int>: the ids of each text."""
    spec = _spec(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(spec)
        for texts in batches:
            yield _lists([t.encode(x.as_py()) for x in texts])

    return F.arrow_udf(lean(run, keeps=True), "array<int>")(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """string: the text of each list of ids."""
    spec = _spec(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(spec)
        for lists in batches:
            yield pa.array([t.decode(None if x is None else [i for i in x if i is not None]) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(lean(run, keeps=True), "string")(ids)


def round_trip(spark: SparkSession, text: Column, path: str) -> Column:
    """struct<ids: array<int>, decoded: string> in one pass: the ids of each text, and what those ids decode to."""
    spec = _spec(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(spec)
        for texts in batches:
            ids = [t.encode(x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array([t.decode(x.tolist()) for x in ids], pa.string())], ["ids", "decoded"])

    return F.arrow_udf(lean(run, keeps=True), "struct<ids: array<int>, decoded: string>")(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(spark, F.col("text"), path or default_path()).alias("r"))
    return docs.select(
        "doc_id",
        F.size("r.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("r.decoded"), 256).alias("decoded_sha256"),
    )
