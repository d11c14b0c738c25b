"""Best-fit packing of documents into sequences of several permitted lengths.

Best-fit decreasing for variable bins: the longest piece first, into the open bin with the
least room that still holds it; where none does, the permitted length of least cost per
token that holds it is opened; at the end each bin takes the cheapest length that holds its
contents. Pieces of one length are interchangeable, so the packing is decided on the
count of pieces per length, a table of at most as many rows as the longest sequence has
tokens. It is the packing of all pieces one by one: equal pieces fill runs of equal bins.
Which piece takes which place is then settled in Spark.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.byte_bpe import encoder, small
from goldpan.llm.common import WORD_PATTERN, numbered, stored
from goldpan.llm.quick_ids import rank_ids


def cost(size: int, overhead: int = 64, attention: int = 32768) -> float:
    """Of a sequence: its tokens, a fixed overhead, and attention, which grows as the square."""
    return size + overhead + size * size / attention


SIZES = {size: cost(size) for size in (512, 1024, 2048, 4096, 8192)}


@dataclass
class Bins:
    """Bins alike in contents, with consecutive numbers.

    ``contents`` has (length, number of the first piece among those of the length, pieces in
    each bin, offset of the first) in the order in which they came.
    """

    first: int
    count: int
    size: int
    room: int
    contents: list[tuple[int, int, int, int]] = field(default_factory=list)

    def cut(self, count: int) -> Bins:
        """Takes the first ``count`` bins out."""
        taken = Bins(self.first, count, self.size, self.room, self.contents)
        self.contents = [(n, at + each * count, each, o) for n, at, each, o in self.contents]
        self.first += count
        self.count -= count
        return taken

    def add(self, length: int, first: int, each: int) -> None:
        offset = self.size - self.room
        self.contents = [*self.contents, (length, first, each, offset)]
        self.room -= each * length


def plan(counts: Mapping[int, int], sizes: Mapping[int, float]) -> list[Bins]:
    """The bins for the number of pieces of each length.

    Of bins with the same room the lowest number comes first. A bin that got a piece has
    less room than all others that hold one more, so it is filled before the next.
    """
    if any(not 0 < length <= max(sizes) for length in counts):
        raise ValueError("pieces have at least a token and fit the largest size")
    open_bins: dict[int, list[tuple[int, Bins]]] = {}  # by room, heaps by first number
    rooms: list[int] = []  # keys of open_bins in order
    closed: list[Bins] = []
    numbers = 0

    def put(group: Bins) -> None:
        if not group.room:
            closed.append(group)
            return
        if group.room not in open_bins:
            open_bins[group.room] = []
            insort(rooms, group.room)
        heapq.heappush(open_bins[group.room], (group.first, group))

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                _, group = heapq.heappop(open_bins[rooms[at]])
                if not open_bins[rooms[at]]:
                    del open_bins[rooms[at]], rooms[at]
            else:
                fitting = (size for size in sizes if size >= length)
                size = min(fitting, key=lambda s: (sizes[s] / s, -s))
                group = Bins(numbers, -(-(total - done) // (size // length)), size, size)
                numbers += group.count
            each = group.room // length
            full = min(group.count, (total - done) // each)
            if full:
                taken = group.cut(full)
                taken.add(length, done, each)
                done += full * each
                put(taken)
            if group.count and done < total:
                taken = group.cut(1)
                taken.add(length, done, total - done)
                done = total
                put(taken)
            if group.count:
                put(group)
    every = closed + [group for heap in open_bins.values() for _, group in heap]
    for group in every:
        held = group.size - group.room
        group.size = min((s for s in sizes if s >= held), key=lambda s: (sizes[s], s))
        group.room = group.size - held
    return sorted(every, key=lambda b: b.first)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words of every text, and one token that ends a document."""
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD_PATTERN))
    return docs.select(docs[key].alias("doc_id"), (words + 1).alias("n_tokens"))


def counted_ids(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens): byte-level BPE ids of every whole text, and one token that ends a document.

    NULL is an empty text. The vocabulary's path must exist on every executor.
    """
    chosen = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Packing needs lengths alone: the compiled library counts in a quarter of the time.
        ids_of = rank_ids(path, pattern, lambda texts: encoder(path, pattern).ids(texts))
        for part in small(batches):
            counts = [len(ids) + 1 for ids in ids_of(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
            )

    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def pieces(items: DataFrame, key: str, length: str, largest: int) -> DataFrame:
    """(key, piece, start, length): items cut into full pieces and a rest.

    An item without tokens, or with a NULL length, is one piece of length 0.
    """
    whole = items.select(
        items[key].alias("key"),
        F.greatest(F.coalesce(items[length], F.lit(0)), F.lit(0)).cast("long").alias("whole"),
    )
    last = F.greatest(F.ceil(F.col("whole") / largest) - 1, F.lit(0))
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * largest
    return cut.select(
        "key",
        "piece",
        start.alias("start"),
        F.least(F.col("whole") - start, F.lit(largest)).cast("int").alias("length"),
    )


def pack(
    items: DataFrame, key: str, length: str, sizes: Mapping[int, float] = SIZES
) -> DataFrame:
    """(key, piece, start, length, bin, bin_size, offset) of every piece of every item.

    Items longer than the largest size are cut, never truncated. Pieces without tokens need
    no bin: bin, size and offset are NULL. Pieces of one length take their places in order
    of key and piece number, so equal tables are packed alike. Repeated rows are items of
    their own; an empty table gives no rows; other columns are ignored.
    """
    cut = numbered(pieces(items, key, length, max(sizes)), ["length"], ["key", "piece"], "rank")
    cut = stored(cut)
    # At most a row per token of the largest size.
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    counts.pop(0, None)
    places = np.array(
        sorted(
            (n, at, b.first, each, offset, b.size)
            for b in plan(counts, sizes)
            for n, at, each, offset in b.contents
        ),
        np.int64,
    ).reshape(-1, 6)
    kind = cut.schema["key"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are ordered by length and first number: the last that begins before a piece.
        starts = places[:, 0] << 48 | places[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            empty = length == 0
            row = np.searchsorted(starts, length.astype(np.int64) << 48 | rank, "right") - 1
            run = places[np.where(empty, 0, row)] if len(places) else np.ones((len(row), 6), np.int64)
            number = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("key", "piece", "start", "length")),
                    pa.array(run[:, 2] + number // run[:, 3], pa.int64(), mask=empty),
                    pa.array(run[:, 5], pa.int32(), mask=empty),
                    pa.array(run[:, 4] + number % run[:, 3] * length, pa.int32(), mask=empty),
                ],
                names=["key", "piece", "start", "length", "bin", "bin_size", "offset"],
            )

    shape = f"key {kind}, piece long, start long, length int, bin long, bin_size int, offset int"
    return cut.mapInArrow(settle, shape)


def sequences(packed: DataFrame) -> DataFrame:
    """(bin, bin_size, tokens, pieces) of every bin: its pieces in order of their offsets."""
    piece = F.struct("offset", "key", "piece", "start", "length")
    return (
        packed.where("bin IS NOT NULL")
        .groupBy("bin", "bin_size")
        .agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    )
