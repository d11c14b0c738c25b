"""Clusters around centroids, with bounds loosened by the norm of the whole displacement.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound to every
other, each with the round in which it was evaluated. The centroids of all rounds are kept, so
a bound is loosened by how far its centroid is now from where it was then: the norm
of the sum of its moves, never more than the sum of their norms. A vector whose loosened upper
bound is below all its lower bounds stays where it is and no distance is calculated. Otherwise
its upper bound is made exact, and centroids that still may be as near are evaluated.

Components are whole numbers, squared distances exact, bounds whole numbers rounded to
the safe side: the clusters are those of comparing every vector with every centroid.
Vectors lie in blocks, a row each, and never move between tasks: per round each block
is rewritten with its bounds and its sums per cluster, which Spark adds up.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import deleted, stored_at

LIMIT = 1 << 27  # largest component, so that squared distances stay below 2^62 at 64 components
EXACT = 1 << 53  # whole numbers below are exact as doubles
CELLS = 1 << 18  # vectors of a block times centroids or components
ROUNDS = 250  # most rounds: their numbers are stored as bytes

TOTALS = "array<struct<cluster: int, n: bigint, inertia: bigint, sums: array<bigint>>>"
BLOCK = (
    f"keys array<bigint>, x binary, own binary, upper binary, upper_at binary, lower binary, "
    f"lower_at binary, totals {TOTALS}, evaluated bigint"
)
_SCHEMA = pa.schema(
    [
        ("keys", pa.list_(pa.int64())),
        *((name, pa.binary()) for name in ("x", "own", "upper", "upper_at", "lower", "lower_at")),
        (
            "totals",
            pa.list_(
                pa.struct(
                    [
                        ("cluster", pa.int32()),
                        ("n", pa.int64()),
                        ("inertia", pa.int64()),
                        ("sums", pa.list_(pa.int64())),
                    ]
                )
            ),
        ),
        ("evaluated", pa.int64()),
    ]
)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, the number of bytes in front."""
    most = max(int(numbers.max()), -1 - int(numbers.min())) if numbers.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def unpacked(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(shape)


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, rounded down."""
    near = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    near -= near * near > squares
    return near + ((near + 1) * (near + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    down = root(squares)
    return down + (down * down < squares)


def to_each(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = np.float64 if x.shape[1] * most * most < EXACT else np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    squares = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    return squares.astype(np.int64)


def to_own(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to a centroid each (or one for all)."""
    gap = x - centroids
    return (gap * gap).sum(1)


@dataclass
class Block:
    """Vectors with their bounds. ``*_at`` is the round in which a bound was evaluated."""

    x: np.ndarray
    own: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray
    lower_at: np.ndarray
    evaluated: int = 0


def first(x: np.ndarray, centroids: np.ndarray) -> Block:
    """All distances of the first round. Of equal distances the smaller number wins."""
    squares = to_each(x, centroids)
    own = squares.argmin(1)
    nearest = squares[np.arange(len(x)), own]
    zero = np.zeros(len(x), np.int64)
    block = Block(x, own, root_up(nearest), zero, root(squares), np.zeros_like(squares))
    block.evaluated = squares.size
    return block


def advance(block: Block, history: np.ndarray) -> None:
    """Assigns a block anew, for the last of the centroids in ``history`` (round, number, component)."""
    now = len(history) - 1
    centroids, k = history[now], history.shape[1]
    moved = root_up(((history - centroids) ** 2).sum(2))  # since each round, per centroid
    block.evaluated = 0
    upper = block.upper + moved[block.upper_at, block.own]
    lower = block.lower - moved[block.lower_at, np.arange(k)]
    lower[np.arange(len(lower)), block.own] = np.iinfo(np.int64).max
    rows = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(rows):
        return
    own = block.own[rows]
    nearest = to_own(block.x[rows], centroids[own])
    block.evaluated += len(rows)
    _evaluated(block, rows, own, nearest, now)
    open_ = lower[rows] <= root_up(nearest)[:, None]
    for j in np.flatnonzero(open_.any(0)).tolist():
        which = np.flatnonzero(open_[:, j])
        squares = to_own(block.x[rows[which]], centroids[j])
        block.evaluated += len(which)
        _evaluated(block, rows[which], j, squares, now)
        before = nearest[which]
        nearer = (squares < before) | ((squares == before) & (j < own[which]))
        own[which[nearer]] = j
        nearest[which[nearer]] = squares[nearer]
    block.own[rows] = own
    block.upper[rows] = root_up(nearest)
    block.upper_at[rows] = now


def _evaluated(block: Block, rows: np.ndarray, j: np.ndarray | int, squares: np.ndarray, now: int) -> None:
    block.lower[rows, j] = root(squares)
    block.lower_at[rows, j] = now


def _record(keys: list, block: Block, k: int, squares: np.ndarray | None) -> pa.RecordBatch:
    order = np.argsort(block.own, kind="stable")
    clusters, starts = np.unique(block.own[order], return_index=True)
    sums = np.add.reduceat(block.x[order], starts)
    sizes = np.diff(np.append(starts, len(order)))
    inertia = np.zeros(len(starts), np.int64)
    if squares is not None:
        inertia = np.add.reduceat(squares[order], starts)
    totals = [
        {"cluster": c, "n": n, "inertia": i, "sums": s}
        for c, n, i, s in zip(clusters.tolist(), sizes.tolist(), inertia.tolist(), sums.tolist())
    ]
    row = {
        "keys": keys,
        "x": packed(block.x),
        "own": packed(block.own),
        # The last round has exact squares in place of bounds.
        "upper": packed(block.upper if squares is None else squares),
        "upper_at": packed(block.upper_at),
        "lower": packed(block.lower) if squares is None else b"",
        "lower_at": packed(block.lower_at) if squares is None else b"",
        "totals": totals,
        "evaluated": block.evaluated,
    }
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def blocks(
    vectors: DataFrame, key: str, vector: str, dims: int, scale: int, k: int
) -> DataFrame:
    """(keys, x): vectors of ``dims`` finite components as whole numbers, floor(scale * x), in blocks."""
    chosen = vectors.select(
        vectors[key].cast("long").alias("key"), vectors[vector].cast("array<double>").alias("v")
    )
    size = max(1, CELLS // max(k, dims))
    schema = pa.schema([("keys", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dims), False)
            batch = batch.filter(whole)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, dims)
            finite = np.isfinite(x).all(1)  # NULL components have become NaN
            keys = batch.column("key").filter(pa.array(finite))
            x = np.floor(x[finite] * scale)
            if not (np.abs(x) <= LIMIT).all():
                raise ValueError(f"components beyond {LIMIT} after scaling: distances may pass 64 bits")
            x = x.astype(np.int64)
            for at in range(0, len(x), size):
                row = {"keys": keys.slice(at, size).to_pylist(), "x": packed(x[at : at + size])}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return chosen.mapInArrow(run, "keys array<bigint>, x binary")


def seeds(cut: DataFrame, dims: int, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``salt:key``, in its order; at most k rows are sent."""
    schema = pa.schema([("h", pa.string()), ("v", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[tuple[str, list[int]]] = []
        for batch in batches:
            for keys, raw in zip(*(batch.column(c).to_pylist() for c in ("keys", "x"))):
                x = unpacked(raw, len(keys), dims)
                names = (f"{salt}:{'' if own is None else own}" for own in keys)
                hashed = [hashlib.sha256(name.encode()).hexdigest() for name in names]
                near = heapq.nsmallest(k, zip(hashed, range(len(keys))))
                own = [(h, x[i].tolist()) for h, i in near]
                # Of rows with one key the smaller vectors: ties go beyond the k-th by number.
                last = near[-1][0]
                held = {i for _, i in near}
                own += [(h, x[i].tolist()) for i, h in enumerate(hashed) if h == last and i not in held]
                least = heapq.nsmallest(k, least + own)
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*least), schema.types)], schema=schema)

    found = cut.select("keys", "x").mapInArrow(run, "h string, v array<bigint>")
    chosen = found.orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(-1, dims)


def _step(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    dims, k = history.shape[2], history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.slice(row, 1).to_pylist()[0]
                keys = held["keys"]
                n = len(keys)
                x = unpacked(held["x"], n, dims)
                if len(history) == 1:
                    block = first(x, history[0])
                else:
                    vectors = (unpacked(held[c], n) for c in ("own", "upper", "upper_at"))
                    bounds = (unpacked(held[c], n, k) for c in ("lower", "lower_at"))
                    block = Block(x, *vectors, *bounds)
                    advance(block, history)
                squares = to_own(x, history[-1][block.own]) if last else None
                yield _record(keys, block, k, squares)

    return state.mapInArrow(run, BLOCK)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty clusters stay."""
    each = state.select(F.explode("totals").alias("c")).select(
        "c.cluster", "c.n", F.posexplode("c.sums").alias("place", "part")
    )
    # A row per centroid and component: as many numbers as the centroids themselves are.
    added = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    new = centroids.copy()
    for r in added.collect():
        new[r["cluster"], r["place"]] = r["total"] // r["n"]
    return new


@dataclass
class Clusters:
    """``assigned`` (key, cluster, distance) of every vector, ``summary`` (cluster, n, inertia) of
    clusters that are not empty, the final ``centroids``, and the distances calculated per round."""

    assigned: DataFrame
    summary: DataFrame
    centroids: np.ndarray
    evaluated: list[int]


def cluster(
    vectors: DataFrame,
    k: int,
    rounds: int,
    key: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    scale: int = 256,
    salt: str = "2",
) -> Clusters:
    """``rounds`` times assigned to the nearest centroid and moved, then assigned once more.

    Kept are vectors of exactly ``dims`` components, none NULL, NaN or infinite, as whole numbers
    floor(scale * x). Equal distances go to the smaller number. Centroids move to the
    componentwise floor of the mean; empty clusters stay. The first centroids are the k vectors of
    smallest sha256 of ``salt:key``, or all where there are fewer. A NULL key is hashed as an empty
    text; rows with one key are vectors of their own, ordered by components. Without kept vectors
    there are no rows. Other columns are ignored. Scaled components beyond 2^27 raise
    ``ValueError``: distances might not fit 64 bits.
    """
    if not 0 <= rounds <= ROUNDS or k < 1:
        raise ValueError(f"at least one cluster, at most {ROUNDS} rounds")
    spark = vectors.sparkSession
    state, folder = stored_at(blocks(vectors, key, vector, dims, scale, k))
    centroids = seeds(state, dims, k, salt)
    history = [centroids]
    evaluated = []
    if len(centroids):
        for left in range(rounds, -1, -1):
            state, new_folder = stored_at(_step(state, np.stack(history), last=not left))
            deleted(spark, folder)  # what later rounds need is in the new one
            folder = new_folder
            evaluated.append(state.agg(F.sum("evaluated")).first()[0])
            if left:
                history.append(_moved(state, history[-1]))
    else:
        state = state.select("keys", "x", F.expr(f"cast(NULL AS {TOTALS})").alias("totals"))
        state = state.withColumns({"own": F.lit(None).cast("binary"), "upper": F.lit(None).cast("binary")})

    shape = pa.schema([("key", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["keys"])
                columns = [row["keys"], unpacked(row["own"], n), unpacked(row["upper"], n)]
                arrays = [pa.array(c, t) for c, t in zip(columns, shape.types)]
                yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    assigned = state.select("keys", "own", "upper").mapInArrow(
        run, "key bigint, cluster int, distance bigint"
    )
    each = state.select(F.explode("totals").alias("c"))
    summary = each.groupBy("c.cluster").agg(
        F.sum("c.n").alias("n"), F.sum("c.inertia").alias("inertia")
    )
    return Clusters(assigned, summary, history[-1], evaluated)
