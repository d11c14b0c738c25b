from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers as public
from goldpan.llm import token_files as tf

PATH = public.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("count", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, count):
    ids = np.random.default_rng(count).integers(0, 2**32, count, dtype=np.uint32)
    parts = tf.planes(ids, bits)
    assert len(parts) == (32 if bits else 4)
    assert np.array_equal(tf.joined(parts, count), ids)


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip_over_blocks(bits):
    draw = np.random.default_rng(5)
    docs = [(k, draw.integers(0, 60_000, n).astype("<u4")) for k, n in [(1, 5), (None, 0), (2, 700), (3, 64), (-4, 1)]]
    file = io.BytesIO()
    writer = tf.Writer(file, bits, block=64)
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    reader = tf.Reader(pa.PythonFile(io.BytesIO(file.getvalue()), "r"))
    at = 0
    for (key, ids), (got, start, arrays) in zip(docs, reader.documents(), strict=True):
        back = np.concatenate([*arrays, np.zeros(0, "<u4")])
        assert got == key and start == at and np.array_equal(back, ids)
        at += len(ids)
    assert np.array_equal(reader.read(2), np.concatenate([x for _, x in docs])[128:192])
    cut = pa.PythonFile(io.BytesIO(file.getvalue()[:-3]), "r")
    with pytest.raises(ValueError):
        tf.Reader(cut)


def check(docs):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    manifest = tf.write(docs, PATH, 2)
    found = sorted(tf.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in found] == [r["doc_id"] for r in rows]
    start, seen = 0, []
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
        seen.append((str(r["key"]), r["n_tokens"], r["ids_crc32"]))
    want = []
    for r in rows:
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(r["doc_id"]), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(seen) == sorted(want)


def test_added_tokens_as_the_unaltered_library(spark):
    own = Tokenizer.from_file(PATH)
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no such token", "",
        "one two  <|endoftext|>\n three <|endoftext| four",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = sorted(tf.read(tf.write(docs, PATH, 2)).collect(), key=lambda r: r["key"])
    start = 0
    for text, r in zip(texts, found, strict=True):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert 50256 in tf.library_encoder(PATH).ids(texts)[0]


def test_lake(documents):
    check(documents.repartition(3))


def test_awkward_and_empty(awkward, nothing):
    check(awkward)
    manifest = tf.write(nothing, PATH, 2)
    assert manifest.count() == 0 == tf.read(manifest).count()
