"""Byte-level BPE by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds the longest token from each position in one pass. Tokens are taken from
the left, longest first. Two neighbours are compatible if merging by rank would not have
joined or cut them otherwise; where the next token is not compatible with the last, a
shorter one is tried, then the last one is given up. A position that failed is never
tried again, which bounds the work by the text's length. Compatibility is remembered.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import SLICE_BYTES
from goldpan.llm.pieces import LONGEST, Encoder, Memory

PAIRS = 300_000  # neighbour decisions remembered by a Python worker
PIECES = 120_000  # pieces of which it remembers the ids
TEXTS = 256  # texts encoded at once


class Vocabulary:
    """Tokens by rank, and what backtracking asks of them."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.split_text = regex.compile(pattern).findall
        self.rank = {token.decode("latin-1"): i for i, token in enumerate(tokens)}
        if any(chr(i) not in self.rank for i in range(256)):
            raise ValueError("a byte-level vocabulary has every single byte")
        self.automaton = ahocorasick.Automaton()
        for text, i in self.rank.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        names = list(self.rank)
        self.length = [len(name) for name in names]
        self.shorter = [self._shorter(name) for name in names]
        self.fits: dict[int, bool] = {}
        self.memory = Memory(PIECES)
        # The two tokens that merge into each; a single byte is its own pair.
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, name in enumerate(names):
            self.halves.append(self._halves(i, name))
            if self.halves[i][0] != i:
                self.merged[self.halves[i]] = i
        self.fits.clear()  # those were decided on a part of the vocabulary

    def _shorter(self, name: str) -> int:
        """The longest token that the given text begins with, besides the text itself."""
        for end in range(len(name) - 1, 0, -1):
            if (found := self.rank.get(name[:end])) is not None:
                return found
        return -1

    def _halves(self, i: int, name: str) -> tuple[int, int]:
        left = self.shorter[i]
        while left >= 0:
            right = self.rank.get(name[self.length[left] :])
            if left < i and right is not None and right < i and self._decide(left, right):
                return left, right
            left = self.shorter[left]
        return i, i

    def _decide(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the two tokens as neighbours.

        Undoes their last merges, latest first, and looks whether the tokens that then
        touch would have merged with each other before that merge happened.
        """
        before = 1 << 32
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    part = self.halves[left][1]
                    if part != left:
                        before, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        before, right = right + 1, part
                        break
                before = left if undo_left else right + 1
                undo_left = not undo_left
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._decide(left, right)
        return found

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece of text."""
        return self.named(text.decode("latin-1"))

    def named(self, name: str) -> list[int]:
        """Ids of one piece whose bytes are Latin-1 characters."""
        whole = self.rank.get(name)
        if whole is not None:
            return [whole]
        # Longest matches that do not overlap are right if all neighbours are compatible.
        taken = [i for _, (i, _) in self.automaton.iter_long(name)]
        known, last = self.fits.get, taken[0]
        for k, token in enumerate(taken[1:], 1):
            fits = known(last << 32 | token)
            if fits is None:
                fits = self.compatible(last, token)
            if not fits:
                return self._backtrack(name, taken[:k], token)
            last = token
        return taken

    def _backtrack(self, name: str, taken: list[int], refused: int) -> list[int]:
        """Ids of a piece of which ``taken`` came first and ``refused`` does not follow."""
        length, shorter, known = self.length, self.shorter, self.fits.get
        closed: set[int] = set()
        at = sum([length[i] for i in taken])
        # Matches that begin before the last token are looked for only where it is given up.
        begin = at - length[taken[-1]]
        longest = self._longest(name, begin)
        token = shorter[refused]
        while at < len(name):
            last = taken[-1] if taken else -1
            while token >= 0:
                if at + length[token] not in closed:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += length[token]
                token = longest[at] if at < len(name) else -1
            else:
                closed.add(at)
                taken.pop()
                at -= length[last]
                token = shorter[last]
                if at < begin:
                    begin = 0
                    longest = self._longest(name, begin)
        return taken

    def _longest(self, name: str, begin: int) -> list[int]:
        """The longest token that begins at each place from ``begin`` on."""
        longest = [-1] * len(name)
        for end, (i, n) in self.automaton.iter(name, begin):
            longest[end + 1 - n] = i  # ends ascend: the last match from a start is the longest
        return longest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, its pieces encoded separately, as bytes."""
        # A word of ASCII letters is one piece, and the caller remembers it.
        plain = [x.isascii() and x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) for x in texts]
        cut = [() if word else self.split_text(x) for x, word in zip(texts, plain)]
        new = self.memory.missing(set().union(*cut))
        found = self.memory.young
        for text in new:
            found[text] = array("I", self.piece(text.encode())).tobytes()
        joined = [
            array("I", self.named(x)).tobytes() if word else b"".join([found[p] for p in pieces])
            for x, word, pieces in zip(texts, plain, cut)
        ]
        for text in new:
            if len(text) > LONGEST:
                del found[text]
        return joined

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, read once by a Python worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not gapless from 0")
    return Vocabulary(tokens, pattern)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(path, pattern).encode)


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ids array<int>) of every whole text; NULL is an empty text, with no ids.

    The vocabulary's path must exist on every executor. Strings of special tokens are
    ordinary text. Repeated rows stay; other columns are ignored.
    """
    chosen = docs.select(
        docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part in small(batches):
            found = own.ids(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), lists(found)], names=["key", "ids"]
            )

    return chosen.mapInArrow(run, f"key {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to (key, ids): the bytes of the ids."""
    kind = encoded.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for part in small(batches):
            ids = part.column("ids")
            bounds = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)
            decoded = [own.decode(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), ids, pa.array(decoded, pa.binary())],
                names=["key", "ids", "decoded"],
            )

    chosen = encoded.select("key", "ids")
    return chosen.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of the given numbers."""
    sizes = np.array([0] + [len(x) for x in arrays], np.int64)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat.astype(np.int32))
    )


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches of a bounded number of rows and, on average, bytes."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = min(TEXTS, max(1, SLICE_BYTES // 4 // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
