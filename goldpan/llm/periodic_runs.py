"""Periodic runs of words, found by splitting at rare words and scanning lags.

A run is a stretch of consecutive words with smallest period q that is long enough and that no
neighbouring word extends. Each of its words comes at least as often as the run has whole
periods, so a word that is rarer within a segment is in none of the segment's runs: it
splits the segment. The parts are counted anew until no word is rare. What survives is scanned
lag by lag: a run of three periods covers two neighbouring blocks of q words that begin at
multiples of q, and these are equal. Blocks are compared by sums of powers, and what
they find is compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import batched, rows

LEAST = 24  # words of a run
PERIODS = 3  # of a run, at least; no less, or its blocks may be missed
PAIRS = 1 << 18  # pairs of blocks compared at once
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def segments(codes: np.ndarray, least: int = LEAST, times: int = PERIODS) -> list[tuple[int, int]]:
    """The parts in which every word comes at least ``times``, of ``least`` words or more."""
    found = []
    waiting = [(0, len(codes))]
    while waiting:
        low, high = waiting.pop()
        if high - low < least:
            continue
        _, place, counts = np.unique(codes[low:high], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[place] < times)
        if not len(rare):
            found.append((low, high))
            continue
        edges = np.concatenate(([-1], rare, [high - low])) + low
        for i in np.flatnonzero(np.diff(edges) > least):
            waiting.append((int(edges[i]) + 1, int(edges[i + 1])))
    return sorted(found)


def _ahead(codes: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on (``b`` is the later one)."""
    same, step = 0, 64
    while b + same < len(codes):
        n = min(step, len(codes) - b - same)
        differ = codes[a + same : a + same + n] != codes[b + same : b + same + n]
        first = int(differ.argmax())
        if differ[first]:
            return same + first
        same += n
        step *= 2
    return same


def _covered(at: np.ndarray, end: np.ndarray, known: list[tuple[int, int]]) -> np.ndarray:
    """Which of the stretches from ``at`` to ``end`` lie within a known one."""
    if not known:
        return np.zeros(len(at), bool)
    bounds = np.array(sorted(known), np.int64)
    furthest = np.maximum.accumulate(bounds[:, 1])
    last = np.searchsorted(bounds[:, 0], at, "right") - 1
    return (last >= 0) & (furthest[np.maximum(last, 0)] >= end)


def scan(codes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, in no order.

    Lags ascend. Two equal blocks within a known stretch belong to it, since its period divides
    the lag, so what is new has the lag as its smallest period.
    """
    m = len(codes)
    own = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    own ^= own >> np.uint64(29)
    power = np.full(m + 1, BASE)
    power[0] = 1
    power = np.cumprod(power)
    # sums[b] - sums[a] is the sum of the words from a to b, each times a power of its place.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * power[:m])))
    found: list[tuple[int, int, int]] = []
    known: list[tuple[int, int]] = []  # also stretches too short for a run
    back = codes[::-1]
    low, most = 1, m // periods
    while low <= most:
        high, pairs = low, 0
        while high <= most and (high == low or pairs + m // high - 1 <= PAIRS) and high <= 2 * low:
            pairs += m // high - 1
            high += 1
        lags = np.arange(low, high)
        each = m // lags - 1
        lag = np.repeat(lags, each)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(each) - each, each)) * lag
        hit = codes[at] == codes[at + lag]
        lag, at = lag[hit], at[hit]
        first, second = sums[at + lag] - sums[at], sums[at + 2 * lag] - sums[at + lag]
        hit = first * power[lag] == second
        lag, at = lag[hit], at[hit]
        new = ~_covered(at, at + 2 * lag, known)
        lag, at = lag[new], at[new]
        for q in np.unique(lag).tolist():
            places = at[np.searchsorted(lag, q) : np.searchsorted(lag, q, "right")]
            places = places[~_covered(places, places + 2 * q, known)]
            i = 0
            while i < len(places):
                place = int(places[i])
                after = _ahead(codes, place, place + q)
                if after < q:  # equal sums of different words
                    i += 1
                    continue
                before = _ahead(back, m - place - q, m - place)
                start, end = place - before, place + q + after
                known.append((start, end))
                if end - start >= max(least, periods * q):
                    found.append((start, end - start, q))
                i = max(i + 1, int(np.searchsorted(places, end - 2 * q, "right")))
        low = high
    return found


def of_words(
    words: list[bytes], least: int = LEAST, periods: int = PERIODS
) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if periods < 3:
        raise ValueError("runs have at least three periods")
    index: dict[bytes, int] = {}
    codes = np.array([index.setdefault(word, len(index)) for word in words], np.int64)
    found = []
    for low, high in segments(codes, least, periods):
        for start, length, period in scan(codes[low:high], least, periods):
            found.append((low + start, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, counted exactly; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    periods: int = PERIODS,
) -> DataFrame:
    """(key, runs, strongest, collapsed) of every whole text.

    ``runs`` holds (start, length, period) in words, by start and period; ``collapsed`` is the
    text without the repetitions of runs, its words joined by one space. Words are what
    white space of ASCII parts. A NULL, empty or blank text has no runs and collapses to an
    empty one; repeated rows and NULL keys stay, an empty table gives no rows, other columns
    are ignored. Memory follows the longest text of a task, some hundred bytes a word; time is
    nearly linear in its length, whatever repeats in it.
    """
    chosen = docs.select(
        docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("text")
    )
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    names = ("start", "length", "period")
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def records(batch: pa.RecordBatch) -> Iterator[tuple]:
            for own, body in rows(iter([batch]), "key", "text"):
                words = body.split()
                found = of_words(words, least, periods)
                best = strongest(found)
                yield (
                    own,
                    [dict(zip(names, one)) for one in found],
                    best and dict(zip(names, best)),
                    b" ".join(kept_words(words, found)),
                )

        for batch in batches:
            schema = schema or pa.schema(
                [
                    ("key", batch.schema.field("key").type),
                    ("runs", pa.list_(run_type)),
                    ("strongest", run_type),
                    ("collapsed", pa.binary()),
                ]
            )
            yield from batched(records(batch), schema)

    one = "struct<start: bigint, length: bigint, period: bigint>"
    shape = f"key {kind}, runs array<{one}>, strongest {one}, collapsed binary"
    found = chosen.mapInArrow(run, shape)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
