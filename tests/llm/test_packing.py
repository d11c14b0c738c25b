from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from goldpan.llm import packing, queries

SIZES = [{8: 8.0, 16: 15.0, 32: 31.0}, {10: 10.0, 25: 26.0, 40: 50.0}, {20: 20.0}]


def one_by_one(lengths, sizes):
    """(final size, lengths in order) of each bin, every piece placed on its own."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [(b[1], i) for i, b in enumerate(bins) if b[1] >= length]
        if fitting:
            at = min(fitting)[1]
        else:
            size = min((s for s in sizes if s >= length), key=lambda s: (sizes[s] / s, -s))
            bins.append([size, size, []])
            at = len(bins) - 1
        bins[at][1] -= length
        bins[at][2].append(length)
    shrink = lambda held: min((s for s in sizes if s >= held), key=lambda s: (sizes[s], s))
    return [(shrink(sum(b[2])), b[2]) for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(SIZES), st.lists(st.integers(1, 20), max_size=80), st.integers(0, 40))
def test_plan_is_best_fit_of_single_pieces(sizes, lengths, copies):
    lengths = [min(n, max(sizes)) for n in lengths] + [7] * copies
    got = [
        (group.size, [n for n, _, each, _ in group.contents for _ in range(each)])
        for group in packing.plan(Counter(lengths), sizes)
        for _ in range(group.count)
    ]
    assert got == one_by_one(lengths, sizes)


def check(packed, lengths, sizes):
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["key"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["bin"], r["bin_size"]].append((r["offset"], r["length"]))
        else:
            assert r["bin"] is None and r["bin_size"] is None and r["offset"] is None
    for (_, size), held in bins.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size and size == min(s for s in sizes if s >= at)
    for key, length in lengths.items():
        assert sum(n for _, n in pieces[key]) == max(0, length or 0)
    return bins


def test_pack_places_every_token_once(spark):
    sizes = {8: 9.0, 16: 17.0, 32: 33.0}
    lengths = {i: (i * 7) % 90 for i in range(300)} | {500: None, 501: -3, 502: 0, 503: 1000}
    df = spark.createDataFrame([(k, v, 1) for k, v in lengths.items()], "id long, n long, bin int")
    packed = packing.pack(df, "id", "n", sizes).collect()
    bins = check(packed, lengths, sizes)
    every = [r["length"] for r in packed if r["length"]]
    expected = one_by_one(every, sizes)
    assert Counter(size for _, size in bins) == Counter(size for size, _ in expected)
    again = packing.pack(df.repartition(5), "id", "n", sizes).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed))


def test_pack_of_one_hot_length_and_repeated_rows(spark):
    df = spark.range(2000).selectExpr("0L as id", "5 as n")
    packed = packing.pack(df, "id", "n", {10: 10.0}).collect()
    assert Counter(r["bin"] for r in packed) == {b: 2 for b in range(1000)}


def test_sequences(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 8)], "id long, n int")
    found = packing.sequences(packing.pack(df, "id", "n", {8: 8.0})).orderBy("bin").collect()
    assert [[p["key"] for p in r["pieces"]] for r in found] == [[3], [1, 2]]


def test_awkward_and_empty(awkward, nothing):
    counted = packing.counted(awkward)
    assert sorted(r["n_tokens"] for r in counted.collect())[:4] == [1, 1, 1, 2]
    assert packing.pack(counted, "doc_id", "n_tokens").count() == awkward.count() + 3
    assert packing.pack(packing.counted(nothing), "doc_id", "n_tokens").count() == 0


def ids_of(texts):
    """Token ids of each text and one at its end, by the tokenizers library."""
    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [len(own.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]


def test_lengths_are_token_ids(spark, awkward, nothing):
    run = "漢字仮名交じり文" * 1600  # 12,800 characters without a space
    docs = spark.createDataFrame([(100, run), (101, "aGVsbG8gd29ybGQ" * 900)], "doc_id long, text string")
    path = public.path("byte_bpe_50k.tiktoken")
    for df in (awkward, docs):
        texts = [r["text"] for r in df.select("text").collect()]
        counted = packing.counted_ids(df, path, public.PATTERN)
        assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(ids_of(texts))
    pieces = packing.pack(counted, "doc_id", "n_tokens").where("key = 100").collect()
    assert len(pieces) > 1 and sum(r["length"] for r in pieces) == ids_of([run])[0]
    assert packing.counted_ids(nothing, path, public.PATTERN).count() == 0


def test_query_packs_token_ids(spark, lake, documents):
    held = Counter()
    for r in queries.op1_best_fit_packing(spark, lake).collect():
        held[r["doc_id"]] += r["n_tokens"]
    rows = documents.select("doc_id", "text").collect()
    assert held == dict(zip([r["doc_id"] for r in rows], ids_of([r["text"] for r in rows])))
