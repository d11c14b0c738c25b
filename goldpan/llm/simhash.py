"""SimHash near-duplicates by exact tiled comparison.

Equal fingerprints collapse first. Distinct ones are cut into cells of like population
counts (upper half, lower half) and cells into tiles of a bounded size. Two fingerprints
within the radius differ by at most the radius in the sum of their half counts, so a tile
meets only the tiles of the few cells that near. Cells are as wide as a third of the
radius: narrower ones would send each tile to many more. Tile pairs are compared in full with
numpy: exclusive-or and bit counts, block by block, blocks skipped by quarter counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import batched, quoted, rows, stored
from goldpan.llm.components import components

SEED = 42
TILE = 1 << 15  # fingerprints in a tile, on average at most
BLOCK = 128  # side of the blocks that a tile pair is compared in
WINDOW = 1 << 16  # shingles hashed at once
SLICE = 1 << 20  # fingerprints in a batch that a task returns
QUARTERS = np.array([48, 32, 16, 0], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bits set in over half of the hashes of the text's word shingles, repeats included."""
    words = (text or b"").lower().split()  # ASCII case and ASCII white space only
    if not words:
        return 0
    width = min(width, len(words))
    votes = np.zeros(64, np.int64)
    count = len(words) - width + 1
    for at in range(0, count, WINDOW):
        part = words[at : at + WINDOW + width - 1]
        shingles = zip(*(part[i:] for i in range(width)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3
) -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long.

    NULL, empty and blank texts have fingerprint 0; a text shorter than a shingle is one
    shingle. Other columns are ignored.
    """
    chosen = docs.select(docs[key].alias("key"), docs[text].cast("binary").alias("text"))
    kind = chosen.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, width) for (x,) in rows(iter([batch]), "text")]
            fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), fps], ["key", "fp"])

    return chosen.mapInArrow(run, f"key {kind.simpleString()}, fp long")


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    quarters = (fps[:, None] >> QUARTERS[None, :]) & np.uint64(0xFFFF)
    return np.bitwise_count(quarters).astype(np.int64)


def _boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest quarter counts of each block."""
    counts, starts = _counts(fps), np.arange(0, len(fps), BLOCK)
    return np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple]:
    """Index arrays of the pairs within the radius, a block pair at a time."""
    if not len(left) or not len(right):
        return
    (low, high), (low2, high2) = _boxes(left), _boxes(right)
    gaps = np.maximum(low[:, None] - high2[None], low2[None] - high[:, None])
    apart = np.maximum(gaps, 0).sum(axis=2)
    for i, j in zip(*np.nonzero(apart <= radius)):
        a, b = left[i * BLOCK : (i + 1) * BLOCK], right[j * BLOCK : (j + 1) * BLOCK]
        x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        if len(x):
            yield x + i * BLOCK, y + j * BLOCK


def merge(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lowers the labels of linked indexes until each link joins equal labels."""
    while True:
        differ = labels[x] != labels[y]
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        lower, upper = np.minimum(labels[x], labels[y]), np.maximum(labels[x], labels[y])
        np.minimum.at(labels, upper, lower)
        labels[:] = labels[labels]


def groups_within(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of the first fingerprint of each one's group in a tile."""
    labels = np.arange(len(fps))
    for x, y in near(fps, fps, radius):
        merge(labels, x, y)
    while not np.array_equal(labels, labels[labels]):
        labels = labels[labels]
    return labels


def links_between(
    left: np.ndarray, left_roots: np.ndarray, right: np.ndarray, right_roots: np.ndarray, radius: int
) -> list[tuple[int, int]]:
    """Links between the groups of two tiles, enough to join what they join."""
    found: set[tuple[int, int]] = set()
    for x, y in near(left, right, radius):
        pairs = np.unique(np.stack([left_roots[x], right_roots[y]], axis=1), axis=0)
        found.update(map(tuple, pairs.tolist()))
    return sorted(found)


def width(radius: int) -> int:
    """Population counts that share a cell."""
    return max(1, radius // 3)


def cells_near(radius: int) -> list[tuple[int, int]]:
    """Steps between cells that may hold fingerprints within the radius, each pair once."""
    wide = width(radius)

    def gap(step: int) -> int:
        return max(0, (abs(step) - 1) * wide + 1)

    span = range(-radius - 1, radius + 2)
    return [
        (x, y) for x in span for y in span if gap(x) + gap(y) <= radius and (x, y) >= (0, 0)
    ]


def tiles(distinct: DataFrame, radius: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Tiles (hi, lo, chunk, fps, roots) of distinct fingerprints, and the chunks per cell.

    There are at most 33 x 33 cells, so the chunk counts are a proven small table. Fingerprints in a tile are ordered by quarter counts; roots are those of their groups
    within the tile.
    """
    lower = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    wide = width(radius)
    celled = distinct.select(
        "fp",
        F.floor(F.bit_count(F.shiftrightunsigned("fp", 32)) / wide).cast("int").alias("hi"),
        F.floor(F.bit_count(lower) / wide).cast("int").alias("lo"),
        F.bit_count(F.shiftrightunsigned("fp", 48)).alias("first"),
        F.bit_count(F.shiftrightunsigned(lower, 16)).alias("third"),
    )
    chunks = stored(
        celled.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    held = (
        celled.join(F.broadcast(chunks), ["hi", "lo"])
        .groupBy("hi", "lo", chunk.alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "third", "fp"))).alias("held"))
        .select("hi", "lo", "chunk", F.col("held.fp").alias("fps"))
    )
    schema = "hi int, lo int, chunk int, fps array<long>, roots array<long>"
    arrow = pa.schema(
        [("hi", pa.int32()), ("lo", pa.int32()), ("chunk", pa.int32())]
        + [(name, pa.list_(pa.int64())) for name in ("fps", "roots")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for hi, lo, at, fps in rows(batches, "hi", "lo", "chunk", "fps"):
                values = np.array(fps, np.int64)
                roots = values[groups_within(values.view(np.uint64), radius)]
                yield hi, lo, at, fps, roots.tolist()

        return batched(records(), arrow, limit=SLICE)

    return stored(held.mapInArrow(run, schema)), chunks


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that lie within the radius.

    Within a tile each member links to its group's root, between tiles groups link once:
    a dense group of copies costs about a link a member, never all its pairs.
    """
    held, chunks = tiles(distinct, radius, tile)
    inside = (
        held.select(F.explode(F.arrays_zip("fps", "roots")).alias("x"))
        .select(F.col("x.fps").alias("a"), F.col("x.roots").alias("b"))
        .where("a <> b")
    )
    steps = cells_near(radius)
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))
    # One row for each cell that a tile must meet, then for each tile there.
    to_cells = held.select(
        F.col("hi").alias("own_hi"),
        F.col("lo").alias("own_lo"),
        F.col("chunk").alias("own_chunk"),
        F.col("fps").alias("own_fps"),
        F.col("roots").alias("own_roots"),
        F.explode(offsets).alias("step"),
    ).withColumns({"hi": F.col("own_hi") + F.col("step.x"), "lo": F.col("own_lo") + F.col("step.y")})
    same = (F.col("step.x") == 0) & (F.col("step.y") == 0)
    to_tiles = (
        to_cells.join(F.broadcast(chunks), ["hi", "lo"])
        .withColumn("from", F.when(same, F.col("own_chunk") + 1).otherwise(0))
        .where(F.col("from") < F.col("chunks"))
        .withColumn("chunk", F.explode(F.sequence("from", F.col("chunks") - 1)))
    )
    met = to_tiles.join(held, ["hi", "lo", "chunk"]).select("own_fps", "own_roots", "fps", "roots")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for record in rows(batches, "own_fps", "own_roots", "fps", "roots"):
                left, left_roots, right, right_roots = (np.array(x, np.int64) for x in record)
                yield from links_between(
                    left.view(np.uint64), left_roots, right.view(np.uint64), right_roots, radius
                )

        return batched(records(), arrow, size=10_000)

    return inside.unionByName(met.mapInArrow(run, "a long, b long"))


def groups(hashed: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(key, fp, component): smallest key reachable over links of at most ``radius`` bits.

    ``hashed`` has (key, fp). Rows with equal fingerprints are linked; keys that are NULL
    count only where a component has no other.
    """
    firsts = stored(hashed.groupBy("fp").agg(F.min("key").alias("first")))
    roots = components(links(firsts.select("fp"), radius, tile))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    labels = rooted.join(lowest, "root").select("fp", "component")
    return hashed.join(labels, "fp").select("key", "fp", "component")


def unique(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, tile: int = TILE
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one of the lowest key.

    Components are those of ``groups``: NULL, empty and blank texts have one fingerprint and are one
    of them. A NULL key comes last; of rows with one key the text of the lower digest stays,
    of rows alike in key and text any one. All columns, whatever their names, stay as they
    are; an empty table gives no rows.
    """
    body = F.coalesce(docs[quoted(text)], F.lit(""))
    own = docs[quoted(key)]
    row = F.struct(own.isNull().alias("unknown"), own.alias("key"), F.sha2(body, 256).alias("digest"))
    hashed = stored(fingerprints(docs.select(row.alias("row"), body.alias("body")), "row", "body"))
    other = ~F.col("key").eqNullSafe(F.col("component"))
    gone = groups(hashed, radius, tile).where(other).select("key").distinct()
    held = next(name for name in ("row_", "row__", "row___") if name not in docs.columns)
    marked = docs.select("*", row.alias(held))

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        fields = ("unknown", "key", "digest")
        same = [rows[f"{held}.{f}"].eqNullSafe(some[f"key.{f}"]) for f in fields]
        # Shuffled at every size: neither side has a bound to broadcast it by.
        return rows.join(some.hint("merge"), same, how)

    staying = among(marked, stored(gone), "left_anti")
    repeated = hashed.groupBy("key").count().where("count > 1").select("key")
    if not repeated.isEmpty():
        once = among(staying, repeated, "left_anti")
        staying = once.unionByName(among(staying, repeated, "left_semi").dropDuplicates([held]))
    return staying.drop(held)
