"""Token ids in files of compressed planes.

Ids are cut into blocks of a fixed size. A block is transposed into bit or byte planes
(all lowest bytes, then all second bytes, ...), each plane compressed by zstandard on its
own. A file ends with an index: where each plane of each block lies, and the key and
number of ids of each document. Blocks can be read one at a time.

    magic | planes of block 0 | planes of block 1 | ... | index | index length | magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldpan.llm.byte_bpe import small
from goldpan.llm.common import batched, stored
from goldpan.llm.quick_ids import library_ids
from goldpan.sources.storage import new_folder

MAGIC = b"GOLDPL01"
BLOCK = 1 << 16
LEVEL = 1


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The ids (unsigned 32-bit) as 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, i].tobytes() for i in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, i], bitorder="little").tobytes() for i in range(32)]


def joined(parts: list[bytes], count: int) -> np.ndarray:
    """The ids of planes."""
    if len(parts) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        each = [np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in parts]
        raw = np.packbits(np.stack(each, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Writes documents one after the other into an open file."""

    def __init__(self, file: BinaryIO, bits: bool = False, block: int = BLOCK) -> None:
        self.file, self.bits, self.block = file, bits, block
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.ids = self.held = 0
        self.sizes = array("I")  # compressed plane sizes, block after block
        self.keys, self.counts = array("q"), array("q")
        self.known = bytearray()  # whether the key is not NULL
        file.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.counts.append(len(ids))
        self.ids += len(ids)
        for at in range(0, len(ids), self.block):
            self.waiting.append(ids[at : at + self.block])
            self.held += len(self.waiting[-1])
            if self.held >= self.block:
                flat = np.concatenate(self.waiting)
                self._flush(flat[: self.block])
                self.waiting = [flat[self.block :]]
                self.held = len(self.waiting[0])

    def _flush(self, ids: np.ndarray) -> None:
        for plane in planes(ids, self.bits):
            packed = self.press.compress(plane)
            self.sizes.append(len(packed))
            self.file.write(packed)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        head = struct.pack(
            "<BIQQQ", self.bits, self.block, self.ids, len(self.keys), len(self.sizes)
        )
        body = b"".join(x.tobytes() for x in (self.sizes, self.keys, self.counts))
        index = self.press.compress(head + body + bytes(self.known))
        self.file.write(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """Reads the index of a file; blocks on demand."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.open = file, zstandard.ZstdDecompressor()
        length = file.size()
        tail = len(MAGIC) + 8
        file.seek(length - tail)
        end = file.read(tail)
        if end[8:] != MAGIC:
            raise ValueError("not a complete file of token planes")
        (size,) = struct.unpack("<Q", end[:8])
        file.seek(length - tail - size)
        index = self.open.decompress(file.read(size))
        at = struct.calcsize("<BIQQQ")
        bits, self.block, self.ids, docs, planes_ = struct.unpack("<BIQQQ", index[:at])
        self.width = 32 if bits else 4
        sizes = np.frombuffer(index, "<u4", planes_, at)
        self.sizes = sizes.reshape(-1, self.width).astype(np.int64)
        at += 4 * planes_
        self.keys = np.frombuffer(index, "<i8", docs, at)
        self.counts = np.frombuffer(index, "<i8", docs, at + 8 * docs)
        self.known = np.frombuffer(index, np.uint8, docs, at + 16 * docs)
        ends = len(MAGIC) + np.cumsum(self.sizes.sum(axis=1))
        self.starts = ends - self.sizes.sum(axis=1)

    def read(self, number: int) -> np.ndarray:
        """The ids of one block."""
        count = min(self.block, self.ids - number * self.block)
        self.file.seek(int(self.starts[number]))
        parts = [self.open.decompress(self.file.read(int(n))) for n in self.sizes[number]]
        return joined(parts, count)

    def documents(self) -> Iterator[tuple[int | None, int, Iterable[np.ndarray]]]:
        """(key, first id's place in the file, id arrays) of each document, in order.

        The arrays of a document must be read before the next document is.
        """
        start, number, rest = 0, 0, np.zeros(0, "<u4")

        def take(count: int) -> Iterator[np.ndarray]:
            nonlocal number, rest
            while count:
                if not len(rest):
                    rest = self.read(number)
                    number += 1
                part, rest = rest[:count], rest[count:]
                count -= len(part)
                yield part

        for key, known, count in zip(self.keys.tolist(), self.known, self.counts.tolist()):
            yield (key if known else None), start, take(count)
            start += count


@dataclass(frozen=True)
class LibraryEncoder:
    """Encodes by a tokenizer file, with the ids that the tokenizers library gives.

    Added tokens in a text become their own ids, as in the library; none are put around it.
    """

    path: str

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u4") for ids in library_ids(self.path)(texts)]


def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(
    docs: DataFrame,
    path: str,
    end_id: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    bits: bool = False,
) -> DataFrame:
    """Writes the ids of every whole text, in ascending key order; returns the manifest.

    The manifest (part, file, documents, ids) has a row per file, in order of ``part``.
    Files lie in ``folder``, one below the shared folder if not given. A task that is
    repeated writes a file of another name, and the manifest, stored itself, names only
    files of tasks that succeeded. ``end_id`` ends every document. NULL texts are empty;
    a NULL key comes first; rows of equal keys follow each other by their texts' hashes.
    """
    folder = folder or f"{new_folder(docs.sparkSession)}"
    chosen = docs.select(
        docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")
    ).withColumn("order", F.xxhash64("text"))
    # The input position lets a range end between rows alike in key and text.
    spread = chosen.withColumn("at", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("key", "order", "at").sortWithinPartitions("key", "order")
    schema = pa.schema(
        [("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, file = library_encoder(path), None, None
        store, root = fs.FileSystem.from_uri(folder)
        name = f"ids-{uuid.uuid4().hex}.planes"
        for part in small(batches):
            if writer is None:
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{root}/{name}")
                writer = Writer(file, bits)
            end = np.array([end_id], "<u4")
            found = encoder.ids(part.column("text").to_pylist())
            for own, ids in zip(part.column("key").to_pylist(), found):
                writer.add(own, np.append(ids, end))
        if writer is not None:
            writer.close()
            file.close()
            number = TaskContext.get().partitionId()
            record = (number, f"{folder}/{name}", len(writer.keys), writer.ids)
            yield from batched(iter([record]), schema)

    return stored(ranged.mapInArrow(run, "part int, file string, documents long, ids long"))


def read(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the files.

    ``start`` counts the ids of all documents before it. An empty manifest gives no rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row per file.
    started = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    schema = pa.schema(
        [(name, pa.int64()) for name in ("key", "start", "n_tokens", "ids_crc32")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                for file, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start"))):
                    store, name = fs.FileSystem.from_uri(file)
                    with store.open_input_file(name) as opened:
                        for key, at, arrays in Reader(opened).documents():
                            count = crc = 0
                            for ids in arrays:
                                count += len(ids)
                                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
                            yield key, start + at, count, crc

        return batched(records(), schema, size=10_000)

    shape = "key long, start long, n_tokens long, ids_crc32 long"
    # As many tasks as files: an exact number is not coalesced, however small the manifest.
    files = max(1, manifest.count())
    spread = started.select("part", "file", "start").repartition(files, "part")
    return spread.mapInArrow(run, shape)
