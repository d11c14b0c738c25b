"""Packing of token ids into sequences of equal room and nearly equal cost of attention.

A piece of n tokens costs what is linear in n and what attention adds, which grows as its square.
Descending pieces go to the sequence of lowest cost that has room for them. Where no sequence
has, the one of lowest cost with any room takes what it holds, and the rest waits among the
shorter pieces. There are just as many sequences as the tokens fill; what is left of
them goes into sequences of powers of two, which need no padding either.

Pieces of one length are interchangeable and so are sequences of the same past: all is decided
on the number of pieces per length, on groups of sequences, and is what placing one piece
after the other gives. How many groups there are follows from the lengths, not from the
documents. Documents are numbered where they are encoded, by task and length, so that no
order over all of them is needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.llm.byte_bpe import small
from goldpan.llm.common import batched, rows, stored
from goldpan.llm.quick_ids import library_ids

CAPACITY = 2048
# Tokens at which attention costs as much as what is linear: six times the width of a model.
ATTENTION = 6 * 4096
RANKS = 40  # bits of a piece's number among those of its length


def cost(length: int, attention: int = ATTENTION) -> int:
    """Of a piece, as a whole number: attention is within pieces, not between them."""
    return length * attention + length * length


@dataclass
class Group:
    """Sequences alike in all they hold, with consecutive numbers."""

    cost: int
    first: int
    count: int
    room: int
    used: int = 0
    fits: bool = False  # waits among those with room for the present length

    def __lt__(self, other: Group) -> bool:
        return (self.cost, self.first) < (other.cost, other.first)


@dataclass(frozen=True)
class Place:
    """Consecutive pieces that go to consecutive sequences, one each.

    ``origin`` is the length of the pieces before any was cut, ``first`` the first one's number
    among those, ``start`` where in them these parts begin.
    """

    origin: int
    first: int
    count: int
    start: int
    length: int
    sequence: int
    offset: int


def plan(
    counts: Mapping[int, int], capacity: int = CAPACITY, attention: int = ATTENTION
) -> list[Place]:
    """Places for the number of pieces of each length."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("pieces have at least a token and fit a sequence")
    whole, left = divmod(sum(n * c for n, c in counts.items()), capacity)
    groups = [Group(0, 0, whole, capacity)] if whole else []
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            number = groups[-1].first + groups[-1].count if groups else 0
            groups.append(Group(0, number, 1, 1 << bit))
    waiting: dict[int, list[tuple[int, int, int, int]]] = {  # (origin, first, count, start)
        n: [(n, 0, c, 0)] for n, c in counts.items() if c
    }
    fitting: list[Group] = []
    narrow: list[Group] = []  # too little room now; some have come to fit since
    by_room: dict[int, list[Group]] = {}
    places: list[Place] = []

    def offer(group: Group, length: int) -> None:
        group.fits = group.room >= length
        if group.fits:
            heapq.heappush(fitting, group)
        elif group.room:
            heapq.heappush(narrow, group)
            by_room.setdefault(group.room, []).append(group)

    for group in groups:
        offer(group, capacity)
    for length in range(capacity, 0, -1):
        for group in by_room.pop(length, ()):
            if group.room == length and not group.fits:
                group.fits = True
                heapq.heappush(fitting, group)
        for origin, first, count, start in waiting.pop(length, ()):
            while count:
                if fitting:
                    group, part = heapq.heappop(fitting), length
                else:
                    group = heapq.heappop(narrow)
                    while group.fits or not group.room:
                        group = heapq.heappop(narrow)
                    part = group.room
                n = min(group.count, count)
                places.append(Place(origin, first, n, start, part, group.first, group.used))
                taken = Group(
                    group.cost + cost(part, attention), group.first, n, group.room - part,
                    group.used + part,
                )
                if group.count > n:
                    offer(
                        Group(group.cost, group.first + n, group.count - n, group.room, group.used),
                        length,
                    )
                group.room = 0  # replaced wherever it still waits
                offer(taken, length)
                if part < length:
                    waiting.setdefault(length - part, []).append((origin, first, n, start + part))
                first += n
                count -= n
    return places


class Placement:
    """Where each piece goes, looked up for many pieces at once."""

    def __init__(self, places: list[Place], capacity: int) -> None:
        kinds = sorted({(p.origin, p.start) for p in places})
        code = {kind: i for i, kind in enumerate(kinds)}
        ordered = sorted(places, key=lambda p: (p.origin, p.start, p.first))
        self.keys = np.array([code[p.origin, p.start] << RANKS | p.first for p in ordered], np.int64)
        columns = [(p.first, p.start, p.length, p.sequence, p.offset) for p in ordered]
        self.first, self.start, self.length, self.sequence, self.offset = (
            np.array(columns, np.int64).reshape(-1, 5).T
        )
        self.next = np.array([code.get((p.origin, p.start + p.length), -1) for p in ordered], np.int64)
        self.begin = np.full(capacity + 1, -1, np.int64)
        for (origin, start), i in code.items():
            if not start:
                self.begin[origin] = i

    def of(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(piece, start, length, sequence, offset) of first parts, then of second ones, ..."""
        piece, code = np.arange(len(length)), self.begin[length]
        while len(piece):
            row = np.searchsorted(self.keys, code << RANKS | rank, "right") - 1
            yield (
                piece,
                self.start[row],
                self.length[row],
                self.sequence[row] + rank - self.first[row],
                self.offset[row],
            )
            code = self.next[row]
            more = code >= 0
            piece, rank, code = piece[more], rank[more], code[more]


def encoded(
    docs: DataFrame, path: str, end_id: int, capacity: int, key: str, text: str
) -> DataFrame:
    """The ids of every text and the end id, and numbers of its pieces within its task (``chunk``).

    ``rest`` tokens are left after ``whole`` pieces of the full capacity; ``rest_at`` documents of
    the task before it have the same rest, ``whole_at`` is the number of full pieces before.
    """
    chosen = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    names = ["key", "chunk", "n_tokens", "rest", "rest_at", "whole", "whole_at", "width", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, chunk = library_ids(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        before = 0
        for part in small(batches):
            rest, rest_at, whole, whole_at, sizes, widths, blobs = ([] for _ in range(7))
            for ids in ids_of(part.column("text").to_pylist()):
                ids.append(end_id)
                own = np.array(ids, "<u4")
                width = 2 if own.max() < 1 << 16 else 4
                blobs.append(own.astype(f"<u{width}").tobytes())
                widths.append(width)
                sizes.append(len(ids))
                full, left = divmod(len(ids), capacity)
                whole.append(full)
                whole_at.append(before)
                before += full
                rest.append(left)
                rest_at.append(seen.get(left, 0))
                seen[left] = rest_at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array([chunk] * len(sizes), pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array(rest, pa.int32()),
                    pa.array(rest_at, pa.int64()),
                    pa.array(whole, pa.int64()),
                    pa.array(whole_at, pa.int64()),
                    pa.array(widths, pa.int8()),
                    pa.array(blobs, pa.binary()),
                ],
                names=names,
            )

    shape = (
        f"key {kind}, chunk int, n_tokens long, rest int, rest_at long, whole long, "
        "whole_at long, width tinyint, ids binary"
    )
    return chosen.mapInArrow(run, shape)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    attention: int = ATTENTION,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence, offset) of every piece of every document.

    A document is its whole text's ids by a file of the tokenizers library, and ``end_id``. ``ids``
    are the piece's, as unsigned 32-bit numbers, lowest byte first. ``start`` counts the document's
    ids before the piece, ``offset`` those of the sequence. Documents longer than the capacity
    are cut into full sequences and a rest. A NULL text is empty: it has the end id alone. NULL
    keys and repeated rows are documents of their own; an empty table gives no rows; other
    columns are ignored. The file must exist on every executor.
    """
    if capacity < 1:
        raise ValueError("a sequence holds at least a token")
    items = stored(encoded(docs, path, end_id, capacity, key, text))
    # Pieces per task and length; those of the full capacity have a row per task.
    counts = items.groupBy("chunk", "rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum("whole").alias("full")
    )
    counts = stored(counts)
    whole = counts.groupBy("chunk").agg(F.sum("full").alias("n"))
    before = Window.partitionBy("rest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    rest_from = counts.select("chunk", "rest", earlier.alias("rest_from"))
    whole = whole.withColumn("rest", F.lit(capacity))
    whole_from = whole.select(F.col("chunk").alias("of"), earlier.alias("whole_from"))
    starts = rest_from.join(whole_from, F.col("chunk") == F.col("of")).drop("of")
    # At most a row per token of a sequence.
    lengths = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    lengths.pop(0, None)
    lengths[capacity] = counts.agg(F.sum("full")).first()[0] or 0
    placement = Placement(plan(lengths, capacity, attention), capacity)
    kind = items.schema["key"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field("key").type
            schema = pa.schema(
                [
                    ("key", key_type), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence", pa.int64()),
                    ("offset", pa.int64()),
                ]
            )
            yield from batched(_records(batch, placement, capacity), schema)

    joined = items.join(starts, ["chunk", "rest"]).select(
        "key",
        "n_tokens",
        "rest",
        (F.col("rest_from") + F.col("rest_at")).alias("rest_rank"),
        "whole",
        (F.col("whole_from") + F.col("whole_at")).alias("whole_rank"),
        "width",
        "ids",
    )
    return joined.mapInArrow(
        settle,
        f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence long, offset long",
    )


def _records(batch: pa.RecordBatch, placement: Placement, capacity: int) -> Iterator[tuple]:
    rest, rest_rank, whole, whole_rank = (
        batch.column(c).to_numpy().astype(np.int64)
        for c in ("rest", "rest_rank", "whole", "whole_rank")
    )
    # Full pieces of each document, then its rest.
    doc = np.repeat(np.arange(len(whole)), whole)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    ends = np.flatnonzero(rest)
    doc = np.concatenate([doc, ends])
    length = np.concatenate([np.full(len(within), capacity), rest[ends]])
    rank = np.concatenate([whole_rank[doc[: len(within)]] + within, rest_rank[ends]])
    base = np.concatenate([within, whole[ends]]) * capacity
    parts = [
        np.stack([doc[piece], base[piece] + start, size, sequence, offset])
        for piece, start, size, sequence, offset in placement.of(length, rank)
    ]
    table = np.concatenate([*parts, np.zeros((5, 0), np.int64)], axis=1)
    table = table[:, np.lexsort((table[1], table[0]))]
    bounds = np.searchsorted(table[0], np.arange(len(whole) + 1))
    for i, (key, n, width, raw) in enumerate(rows(iter([batch]), "key", "n_tokens", "width", "ids")):
        ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
        for _, start, size, sequence, offset in table[:, bounds[i] : bounds[i + 1]].T.tolist():
            yield key, start, size, ids[start : start + size].tobytes(), n, sequence, offset


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence, tokens, pieces, ids) of every sequence: its pieces in order, ids joined."""
    piece = F.struct("offset", "key", "start", "length", "ids")
    whole = packed.groupBy("sequence").agg(
        F.sum("length").alias("tokens"), F.sort_array(F.collect_list(piece)).alias("held")
    )
    parts = F.transform("held", lambda p: p["ids"])
    return whole.select(
        "sequence",
        "tokens",
        F.transform("held", lambda p: F.struct(p["offset"], p["key"], p["start"], p["length"])).alias(
            "pieces"
        ),
        F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
    )
