"""Splitting texts for byte-level BPE, each distinct stretch being encoded once.

The split pattern never lets a piece cross from before a single space to after it where a
non-blank follows: a text is the concatenation of stretches cut before such spaces, and
the ids of a text are the ids of its stretches, one after the other. Stretches repeat far
more than texts do, so tasks remember their ids, in memories of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

MEMORY = 250_000  # stretches in each of the two halves of a worker's memory
LONGEST = 64  # characters of a stretch worth remembering
ID = "<u4"  # ids as stored between stretches and texts

blank_after_space = re.compile(r" (?=\s|\Z)").search


def stretches(text: str) -> list[str]:
    """The text, cut at each space that a non-blank follows; that space is left out.

    Every stretch but the first begins with the space left out.
    """
    parts = text.split(" ")
    if blank_after_space(text) is None:
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:  # blanks in a row stay with what is before them
            out[-1] += " " + part
    return out


class Memory:
    """A dictionary of bounded size that keeps what was used lately.

    Two halves: what a full young half pushes out becomes the old half, and what is
    found there is young again.
    """

    def __init__(self, size: int = MEMORY) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys not known. Those known stay known until the next call."""
        absent: Iterable[str] = [key for key in keys if key not in self.young]
        if len(self.young) + len(absent) > self.size:
            self.old, self.young = self.young, {}
            absent = keys
        out = []
        for key in absent:
            found = self.old.get(key)
            if found is None:
                out.append(key)
            else:
                self.young[key] = found
        return out


class Encoder:
    """Ids of texts by a function that encodes stretches."""

    def __init__(
        self, encode: Callable[[Iterable[str]], list[bytes]], memory: int = MEMORY
    ) -> None:
        self.encode = encode
        self.memory = Memory(memory)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        cut = [stretches(text) for text in texts]
        firsts = self.encode([parts[0] for parts in cut])
        tails = [parts[1:] for parts in cut]
        # Values are looked up once; only stretches not found are looked at again.
        get = self.memory.young.get
        known = [list(map(get, tail)) for tail in tails]
        unknown = {
            part
            for tail, values in zip(tails, known)
            for part, value in zip(tail, values)
            if value is None
        }
        new = self.memory.missing(unknown)
        found = self.memory.young
        found.update(zip(new, self.encode([" " + part for part in new])))
        joined = [
            np.frombuffer(
                first + b"".join([found[t] if v is None else v for t, v in zip(tail, values)]), ID
            )
            for first, tail, values in zip(firsts, tails, known)
        ]
        for part in new:
            if len(part) > LONGEST:
                del found[part]
        return joined
