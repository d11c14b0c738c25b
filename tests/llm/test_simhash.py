from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from goldpan.llm import simhash
from goldpan.llm.components import components


def classes(nodes, links):
    """Smallest node reachable from each, by a plain walk."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow(text):
    words = [w.lower() if w.isascii() else w for w in (text or "").encode().lower().decode().split()]
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [
        xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest()
        for i in range(len(words) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " ", "a", "A b", "a b c", "The cat É É é sat on the mat"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow(text)


def test_hash_is_the_engines_own(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert np.int64(row["h"]) == np.array([xxhash.xxh64_intdigest(b"a b c", 42)], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize("tile", [4, 50, 4096])
def test_groups_equal_all_pairs(spark, tile):
    draw = random.Random(tile)
    base = [draw.getrandbits(64) for _ in range(60)]
    values = []
    for b in base:
        for _ in range(draw.randint(1, 6)):
            flips = draw.sample(range(64), draw.choice([0, 1, 2, 3, 4]))
            values.append(b ^ sum(1 << f for f in flips))
    # A long chain: neighbours link, ends are far apart.
    chain = draw.getrandbits(64)
    for bit in range(0, 60, 3):
        chain ^= 0b111 << bit
        values.append(chain)
    values += values[:10]
    keys = list(range(100, 100 + len(values)))
    links = [
        (keys[i], keys[j])
        for i in range(len(values))
        for j in range(i)
        if (values[i] ^ values[j]).bit_count() <= 3
    ]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(keys, signed)), "key long, fp long")
    got = {r["key"]: r["component"] for r in simhash.groups(df, 3, tile).collect()}
    assert got == classes(keys, links)


def test_components_of_chains_stars_and_nothing(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)]
    links += [(draw.randint(2000, 2400), draw.randint(2000, 2400)) for _ in range(250)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = classes({n for link in links for n in link}, links)
    assert {r["node"]: r["root"] for r in found} == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_awkward_and_empty(awkward, nothing):
    found = simhash.groups(simhash.fingerprints(awkward)).collect()
    assert len(found) == awkward.count()
    of = {r["key"]: (r["fp"], r["component"]) for r in found}
    assert of[3] == of[4] == of[5] == (0, 3) and of[0] == of[1] == of[2]
    assert of[None][1] is None
    assert simhash.groups(simhash.fingerprints(nothing)).count() == 0


def survivors(texts):
    """{key} of the lowest key of each component, all pairs compared."""
    keys = sorted(texts)
    fps = {k: slow(texts[k]) for k in keys}
    links = [(a, b) for a in keys for b in keys if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    return set(classes(keys, links).values())


def copies(draw, groups, each):
    """Texts with near copies of one or a few changed words."""
    words = ["".join(draw.choices("abcdefghijkl", k=draw.randint(2, 8))) for _ in range(3000)]
    out = []
    for _ in range(groups):
        base = draw.choices(words, k=draw.randint(60, 300))
        for _ in range(draw.randint(1, each)):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                own[draw.randrange(len(own))] = draw.choice(words)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("groups, each, tile", [(60, 4, 1 << 15), (3, 60, 8)])
def test_unique_keeps_one_of_each_component(spark, groups, each, tile):
    texts = copies(random.Random(groups), groups, each)
    rows = [(i, t, "x", i * 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ string, `a.b` long").repartition(3)
    got = simhash.unique(docs, tile=tile).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(survivors(dict(enumerate(texts))))
    assert all(r["row_"] == "x" and r["a.b"] == 2 * r["doc_id"] and r["text"] == texts[r["doc_id"]] for r in got)


def test_unique_of_awkward_rows(spark, awkward, nothing):
    got = simhash.unique(awkward)
    assert got.schema == awkward.schema
    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
    want = [str(k) for k in survivors(texts)] + ["None"]  # the text without a key has no copy
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(want)
    assert simhash.unique(nothing).count() == 0


def test_unique_of_repeated_rows_and_keys(spark):
    """Rows alike stay once, keys repeated with other texts are rows of their own, NULL keys last."""
    prose = "the quick brown fox jumps over the lazy dog by the river "
    rows = [
        (1, prose * 3), (1, prose * 3), (1, "quite another text of several words here"),
        (None, prose * 3), (None, "a third text that nobody has copied at all"), (2, None), (3, " "), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "`the key` long, `te.xt` string").repartition(3)
    got = sorted(map(str, map(tuple, simhash.unique(docs, "the key", "te.xt").collect())))
    assert got == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))
