"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A text is a weighted set: its words, ASCII case folded, with their counts as weights. For
each of ``SAMPLES`` positions every word draws two gamma variates and an offset from its
hash; the word of the smallest sampled value, with the quantised weight it was sampled
at, is the text's sample. Two texts agree at a position with the probability of their
generalised Jaccard similarity: the sum of lower weights over the sum of higher ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.llm.common import batched, rows, stored

SAMPLES = 64
TERMS = 20_000  # distinct words sampled at once
KEPT = 30_000  # distinct words of which a task keeps what it has drawn
BLOCK = 256  # words whose hashes are mixed at once: they stay in a core's cache
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed values of the splitmix64 generator
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def _uniforms(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers above 0 and below 1 from each hash: of its upper and its lower half."""
    halves = np.ascontiguousarray(bits, "<u8").view("<u4") >> np.uint32(8)
    numbers = halves.view("<i4").astype(np.float32)  # 24 bits, signed or not
    numbers += np.float32(0.5)
    numbers *= np.float32(2.0**-24)
    return numbers[:, 1::2], numbers[:, ::2]


def draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word and position: a gamma variate, the logarithm of another, an offset."""
    steps = np.arange(1, 3 * samples + 1, dtype=np.uint64) * GOLDEN
    out = tuple(np.empty((len(hashes), samples), np.float32) for _ in range(3))
    for at in range(0, len(hashes), BLOCK):
        rate, log_c, offset = (x[at : at + BLOCK] for x in out)
        with np.errstate(over="ignore"):
            bits = _mix(hashes[at : at + BLOCK, None] + steps[None, :])
        high, low = _uniforms(bits)
        both = high[:, : 2 * samples] * low[:, : 2 * samples]
        logs = np.log(both, out=both)
        np.negative(logs, out=logs)
        rate[:] = logs[:, :samples]
        np.log(logs[:, samples:], out=log_c)
        offset[:] = high[:, 2 * samples :]
    return out


def words(text: str) -> Counter:
    return Counter(text.encode().lower().split())


def _drawn(terms: list[bytes], samples: int) -> tuple[np.ndarray, ...]:
    """Hashes of terms, the logarithm of their values at weight 1, and what these come from."""
    hashes = np.array([xxhash.xxh64_intdigest(term, 1) for term in terms], np.uint64)
    rate, log_c, offset = draws(hashes, samples)
    # At weight 1 the quantised weight is 0.
    return hashes, log_c - rate * (1 - offset), rate, log_c, offset


def _least(
    at: np.ndarray,
    weights: np.ndarray,
    hashes: np.ndarray,
    single: np.ndarray,
    rate: np.ndarray,
    log_c: np.ndarray,
    offset: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The lowest value per position among the terms ``at``, and the mark of its term and step."""
    values = single[at]
    many = np.flatnonzero(weights > 1)
    chosen_rate, chosen_offset = rate[at[many]], offset[at[many]]
    steps = np.floor(np.log(weights[many])[:, None] / chosen_rate + chosen_offset)
    values[many] = log_c[at[many]] - chosen_rate * (steps - chosen_offset + 1)
    best = values.argmin(axis=0)
    step = np.zeros(len(best), np.uint64)
    row = np.full(len(at), -1)
    row[many] = np.arange(len(many))
    heavy = np.flatnonzero(row[best] >= 0)
    step[heavy] = steps[row[best[heavy]], heavy].astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        mark = _mix(hashes[at[best]] + (step + np.uint64(1)) * GOLDEN) >> np.uint64(48)
    return values[best, np.arange(len(best))], mark


def _sketch_long(weights: Counter, samples: int) -> np.ndarray:
    """The samples of one set, a block of terms at a time: memory does not follow its size."""
    least, marks = np.full(samples, np.inf), np.zeros(samples, np.uint64)
    items = iter(weights.items())
    while block := list(islice(items, TERMS)):
        counts = np.array([n for _, n in block], np.float32)
        drawn = _drawn([term for term, _ in block], samples)
        values, mark = _least(np.arange(len(block)), counts, *drawn)
        lower = values < least
        least[lower], marks[lower] = values[lower], mark[lower]
    return marks


class _Places(dict):
    """The row of each term; a new one gets the next."""

    def __missing__(self, term: bytes) -> int:
        self[term] = row = len(self)
        return row


class Terms:
    """What was drawn for terms, kept for later sets: of ``KEPT`` terms at most, the most used."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples, self.size = samples, 0
        self.place = _Places()
        self.table = [np.empty(0, np.uint64), *(np.empty((0, samples), np.float32) for _ in range(4))]
        self.uses = np.empty(0, np.uint32)

    def rows(self, weights: Counter) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, weights), np.int64, len(weights))

    @property
    def new(self) -> int:
        return len(self.place) - self.size

    def draw(self) -> None:
        """Draws what is new."""
        if not self.new:
            return
        size, self.size = self.size, len(self.place)
        if self.size > len(self.uses):
            more = 2 * self.size - size
            for i, old in enumerate([*self.table, self.uses]):
                wide = np.zeros((more, *old.shape[1:]), old.dtype)
                wide[:size] = old[:size]
                if i < len(self.table):
                    self.table[i] = wide
                else:
                    self.uses = wide
        drawn = _drawn(list(islice(self.place, size, None)), self.samples)
        for whole, part in zip(self.table, drawn):
            whole[size : self.size] = part
        self.uses[size : self.size] = 0

    def trim(self) -> None:
        """Beyond the limit, forgets all but the half of it that was used most."""
        if self.size <= KEPT:
            return
        few = KEPT // 2
        used = self.uses[: self.size]
        left = np.sort(np.argpartition(used, self.size - few)[self.size - few :])
        terms = list(self.place)
        self.place = _Places((terms[row], i) for i, row in enumerate(left.tolist()))
        for whole in self.table:
            whole[:few] = whole[left]
        self.uses[:few] = used[left] // 2  # what was used long ago counts less
        self.size = few


def sketch(
    texts: list[Counter], samples: int = SAMPLES, known: Terms | None = None
) -> np.ndarray:
    """A row of 16-bit samples per weighted set.

    An empty set has the samples 0; those of others are never all 0 but by chance. Terms are
    drawn ``TERMS`` at a time, those of a set with more a block after the other. Those in
    ``known`` are not drawn again; samples are the same with and without it.
    """
    known = known or Terms(samples)
    out = np.zeros((len(texts), samples), np.uint16)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        known.draw()
        for i, at in held:
            counts = np.fromiter(texts[i].values(), np.float32, len(at))
            out[i] = _least(at, counts, *known.table)[1]
            known.uses[at] += 1
        held.clear()
        known.trim()

    for i, weights in enumerate(texts):
        if len(weights) > TERMS:
            out[i] = _sketch_long(weights, samples)
        elif weights:
            held.append((i, known.rows(weights)))
            if known.new >= TERMS:
                flush()
    if held:
        flush()
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal samples: an estimate of the similarity, exact for equal sets.

    A text without words is like one without words and unlike any other.
    """
    return float(np.mean(one == other)) if one.any() == other.any() else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): the samples of every whole text as hexadecimal digits.

    NULL and blank texts have the fingerprint of no words. Equal texts have equal ones.
    """
    chosen = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = chosen.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in batches:
            found = sketch([words(x) for (x,) in rows(iter([batch]), "text")], known=known)
            digits = pa.array([x.astype(">u2").tobytes().hex() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), digits], ["key", "fingerprint"])

    return chosen.mapInArrow(run, f"key {kind.simpleString()}, fingerprint string")


COLUMNS = [
    ("key", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
PLACED = pa.schema(
    [*COLUMNS, ("kind", pa.string()), ("part", pa.int32()), ("text", pa.string())]
)
PLACED_SQL = (
    "key long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "kind string, part int, text string"
)
GROUP = 64  # texts sketched at once


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compared(pairs: list[tuple[int, str, str]], known: Terms | None = None) -> list[tuple]:
    """Results for (key, text, next text)."""
    edited = [_edited(text, following) for _, text, following in pairs]
    texts = [text for _, text, _ in pairs]
    nexts = [following for _, _, following in pairs]
    found = sketch([words(x) for x in [*texts, nexts[-1], *edited]], known=known)
    n = len(pairs)
    # Texts come in order: the next text of all but the last is the following one.
    return [
        (
            key,
            len(text),
            sha256(edited[i].encode()).hexdigest(),
            found[i].astype(">u2").tobytes().hex(),
            found[n + 1 + i].astype(">u2").tobytes().hex(),
            likeness(found[i], found[n + 1 + i]),
            likeness(found[i], found[i + 1]),
        )
        for i, (key, text, _) in enumerate(pairs)
    ]


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against its edited form and the next text, in order of an integer key.

    The last quarter of the edited text, rounded down, is the beginning of the next text;
    after the last key comes the first, and a single row is its own next. Rows of equal
    keys follow each other by their texts' hashes; a NULL key comes first; a NULL text is
    empty. Texts are shuffled once, into ranges of keys; only the first and last text of
    each range meet those of the ranges beside it.
    """
    chosen = docs.select(
        docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")
    ).withColumn("order", F.xxhash64("text"))
    # The input position lets a range end between rows alike in key and text.
    spread = chosen.withColumn("at", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("key", "order", "at").sortWithinPartitions("key", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known = Terms()

        def records() -> Iterator[tuple]:
            held: list[tuple[int, str]] = []
            empty = (None,) * 6
            for record in rows(batches, "key", "text"):
                if not held:
                    yield (*(record[0], *empty), "first", part, record[1])
                held.append(record)
                if len(held) > GROUP:
                    pairs = [(k, t, u) for (k, t), (_, u) in zip(held, held[1:])]
                    yield from ((*x, "done", part, None) for x in _compared(pairs, known))
                    held = held[-1:]
            if len(held) > 1:
                pairs = [(k, t, u) for (k, t), (_, u) in zip(held, held[1:])]
                yield from ((*x, "done", part, None) for x in _compared(pairs, known))
            if held:
                yield (*(held[-1][0], *empty), "last", part, held[-1][1])

        return batched(records(), PLACED)

    placed = stored(ranged.mapInArrow(run, PLACED_SQL))
    firsts, lasts = placed.where("kind = 'first'"), placed.where("kind = 'last'")
    # One narrow row per range: which range is next.
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part").select(
        "part", F.coalesce(F.lead("part").over(every), F.first("part").over(whole)).alias("next")
    )
    edges = (
        lasts.select("key", "text", "part")
        .join(after, "part")
        .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
        .select("key", "text", "following")
    )
    schema = pa.schema(COLUMNS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        found = (_compared([pair], known)[0] for pair in rows(batches, "key", "text", "following"))
        return batched(found, schema)

    names = [name for name, _ in COLUMNS]
    ends = edges.mapInArrow(join, PLACED_SQL.split(", kind")[0])
    return placed.where("kind = 'done'").select(*names).unionByName(ends)
