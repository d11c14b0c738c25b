from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from goldpan.llm import balanced_packing as bp
from goldpan.llm import queries, quick_ids

PATH = public.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def one_by_one(lengths, capacity, attention):
    """[(origin, number, start, length, sequence, offset)], each piece placed on its own."""
    whole, left = divmod(sum(lengths), capacity)
    rooms = [capacity] * whole + [1 << b for b in reversed(range(12)) if left >> b & 1]
    costs, used = [0] * len(rooms), [0] * len(rooms)
    numbers = Counter()
    waiting = defaultdict(list)
    for n in lengths:
        waiting[n].append((n, numbers[n], 0))
        numbers[n] += 1
    placed = []
    for length in range(capacity, 0, -1):
        for origin, number, start in waiting[length]:
            fits = [i for i in range(len(rooms)) if rooms[i] >= length]
            free = fits or [i for i in range(len(rooms)) if rooms[i]]
            i = min(free, key=lambda i: (costs[i], i))
            part = min(length, rooms[i])
            placed.append((origin, number, start, part, i, used[i]))
            rooms[i] -= part
            used[i] += part
            costs[i] += part * attention + part * part
            if part < length:
                waiting[length - part].append((origin, number, start + part))
    assert not any(rooms)
    return placed


@settings(max_examples=200, deadline=None)
@given(
    st.sampled_from([1, 7, 16, 30]), st.lists(st.integers(1, 30), max_size=70), st.integers(0, 40),
    st.sampled_from([1, 50]),
)
def test_groups_are_placed_as_single_pieces(capacity, lengths, copies, attention):
    lengths = [min(n, capacity) for n in [*lengths, *[5] * copies]]
    found = [
        (p.origin, p.first + i, p.start, p.length, p.sequence + i, p.offset)
        for p in bp.plan(Counter(lengths), capacity, attention)
        for i in range(p.count)
    ]
    assert sorted(found) == sorted(one_by_one(lengths, capacity, attention))


def test_plan_of_very_many_pieces():
    draw = np.random.default_rng(2)
    counts = {n: int(draw.integers(0, 10**9)) for n in range(1, 2049)}
    places = bp.plan(counts)
    assert sum(p.length * p.count for p in places) == sum(n * c for n, c in counts.items())
    assert len(places) < 100_000
    held = Counter()
    for p in places:
        if not p.start:
            held[p.origin] += p.count
    assert held == Counter({n: c for n, c in counts.items() if c})


def test_costs_are_balanced():
    """Attention of sequences of short documents differs far less than if they were filled in turn."""
    draw = np.random.default_rng(4)
    lengths = np.minimum(draw.lognormal(5, 0.7, 20_000).astype(int) + 1, 700).tolist()
    balanced, in_turn = Counter(), Counter()
    for p in bp.plan(Counter(lengths)):
        for i in range(p.count):
            balanced[p.sequence + i] += p.length**2
    at = 0
    for n in lengths:  # one after the other, cut where a sequence ends
        while n:
            part = min(n, 2048 - at % 2048)
            in_turn[at // 2048] += part**2
            at, n = at + part, n - part
    most = lambda costs: max(costs.values()) / np.mean(list(costs.values()))
    assert most(balanced) < 1.3 < 2 < most(in_turn)


@lru_cache(maxsize=None)
def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(spark, docs, tmp_path, **options):
    got = bp.pack(docs, PATH, 1, **options).collect()
    capacity = options.get("capacity", 2048)
    pieces, held = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["key"], r["doc_tokens"]].append(r)
        held[r["sequence"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0  # no padding anywhere
    assert sorted(held) == list(range(len(held)))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"], np.array([*ids_of(r["text"]), 1], "<u4").tobytes()] += 1
    for (key, n), count in Counter({(k, len(b) // 4): 0 for k, b in want}).items():
        copies = sum(c for (k, b), c in want.items() if (k, len(b) // 4) == (key, n))
        own = sorted(pieces.pop((key, n)), key=lambda r: r["start"])
        covered = Counter()
        for r in own:
            covered[r["start"]] += 1
            covered[r["start"] + r["length"]] -= 1
        assert covered[0] == copies and covered[n] == -copies
        assert not any(c for place, c in covered.items() if 0 < place < n)
        if copies == 1:
            (body,) = [b for k, b in want if (k, len(b) // 4) == (key, n)]
            assert b"".join(r["ids"] for r in own) == body
    assert not pieces
    return got


def test_awkward_and_empty(spark, awkward, nothing, tmp_path):
    check(spark, awkward.repartition(3), tmp_path)
    check(spark, awkward, tmp_path, capacity=50)
    assert bp.pack(nothing, PATH, 1).count() == 0
    one = check(spark, awkward.where("doc_id = 3"), tmp_path)
    assert [(r["length"], r["sequence"], r["offset"]) for r in one] == [(1, 0, 0)]


def test_one_hot_length(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('a b ', cast(id % 3 as int)) as text")
    check(spark, docs, tmp_path, capacity=16)


def test_sequences_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six")], "doc_id long, text string")
    packed = bp.pack(docs, PATH, 1, capacity=4)
    found = bp.sequences(packed).orderBy("sequence").collect()
    assert [r["tokens"] for r in found] == [4, 4]
    whole = Counter(np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist())
    assert whole == Counter([*ids_of("one two three four five"), 1, *ids_of("six"), 1])


def test_query_on_the_lake(spark, lake, documents):
    got = queries.op13_balanced_packing(spark, lake)
    assert got.columns[:7] == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]
    found = defaultdict(list)
    for r in got.collect():
        found[r["doc_id"]].append(r)
    for r in documents.select("doc_id", "text").collect():
        ids = np.array([*ids_of(r["text"]), 1], "<u4")
        at = 0
        for p in sorted(found.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    assert not found


def test_ids_as_the_library(awkward):
    own = LIBRARY
    texts = [r["text"] or "" for r in awkward.collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " " * 300_000 + "x", "\n" * 200_000, "x" * 3000]
    # Every kind of character next to letters, digits, spaces and itself.
    texts += [
        f"a{c}b 1{c}2 {c}{c} .{c}! {c}"
        for c in map(chr, [*range(0x3100), *range(0xD000, 0xD800), *range(0xF900, 0x10000), *range(0x1F000, 0x1F800)])
    ]
    ids = quick_ids.library_ids(PATH)(texts)
    assert ids == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert quick_ids._ranks(PATH, {"<|endoftext|>"}) is not None


def test_other_kinds_of_files_go_to_the_library():
    path = public.path("word_bpe_49k.json")
    assert quick_ids._ranks(path, set()) is None
    own = Tokenizer.from_file(path)
    texts = ["Some Words here", ""]
    assert quick_ids.library_ids(path)(texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_wrong_capacity(documents):
    with pytest.raises(ValueError):
        bp.pack(documents, PATH, 1, capacity=0)
