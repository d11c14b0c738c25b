from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from goldpan.llm import ns_clusters as ns
from goldpan.llm import queries


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def by_definition(rows, k, rounds, dims=64, scale=256, salt="2"):
    """[(key, cluster, distance)] and the final centroids, each vector against each centroid."""
    kept = []
    for key, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((key, [math.floor(scale * x) for x in v]))
    name = lambda r: f"{salt}:{'' if r[0] is None else r[0]}".encode()
    order = sorted(kept, key=lambda r: (hashlib.sha256(name(r)).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (square(v, centroids[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            held = [v for (_, v), c in zip(kept, own) if c == j]
            if held:
                centroids[j] = [sum(x) // len(held) for x in zip(*held)]
    found = []
    for key, v in kept:
        j = nearest(v)
        found.append((key, j, square(v, centroids[j])))
    return found, centroids


@settings(max_examples=150, deadline=None)
@given(
    st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 9), st.integers(1, 5),
    st.sampled_from([3, 200, 1 << 26]),
)
def test_bounds_give_the_nearest_of_all(seed, n, k, dims, spread):
    """Whatever the centroids do between rounds, and with many equal distances."""
    draw = np.random.default_rng(seed)
    x = draw.integers(-spread, spread + 1, (n, dims))
    history = [draw.integers(-spread, spread + 1, (k, dims))]
    for _ in range(4):
        step = draw.integers(-max(1, spread // 8), max(1, spread // 8) + 1, (k, dims))
        history.append(history[-1] + step * (draw.random((k, 1)) < 0.5))
    block = ns.first(x, history[0])
    for now in range(1, len(history) + 1):
        squares = [[square(v, c) for c in history[now - 1].tolist()] for v in x.tolist()]
        assert block.own.tolist() == [min(range(k), key=lambda j: (s[j], j)) for s in squares]
        for i, s in enumerate(squares):
            if block.upper_at[i] == now - 1:
                assert block.upper[i] ** 2 >= s[block.own[i]]
            for j in range(k):
                if block.lower_at[i, j] == now - 1:
                    assert max(0, block.lower[i, j]) ** 2 <= s[j]
        if now < len(history):
            ns.advance(block, np.stack(history[: now + 1]))


def test_displacement_is_not_summed_over_rounds():
    """Centroids that come back to where bounds were evaluated loosen nothing."""
    draw = np.random.default_rng(1)
    x = draw.integers(-1_000_000, 1_000_000, (500, 8))
    here = draw.integers(-1_000_000, 1_000_000, (6, 8))
    block = ns.first(x, here)
    ns.advance(block, np.stack([here, here + 10_000_000 * np.arange(6)[:, None], here]))
    assert block.evaluated == 0


def test_whole_numbers_in_few_bytes():
    for numbers in ([], [0], [-128, 127], [128], [-129], [2**31], [-(2**31)], [2**62]):
        a = np.array(numbers, np.int64)
        raw = ns.packed(a)
        assert np.array_equal(ns.unpacked(raw, len(a)), a)
    assert ns.packed(np.array([127]))[0] == 1 and ns.packed(np.array([128]))[0] == 2
    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**31 - 1) ** 2 - 1, (2**31 - 1) ** 2], np.int64)
    assert ns.root(squares).tolist() == [math.isqrt(s) for s in squares.tolist()]
    assert [r * r >= s > (r - 1) * (r - 1) or not s for r, s in zip(ns.root_up(squares).tolist(), squares.tolist())]


def check(vectors, k, rounds):
    found = ns.cluster(vectors, k, rounds, "vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()]
    want, centroids = by_definition(rows, k, rounds)
    got = [tuple(r) for r in found.assigned.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert found.centroids.tolist() == centroids
    sums = {}
    for _, j, d in want:
        n, total = sums.get(j, (0, 0))
        sums[j] = (n + 1, total + d)
    assert {r["cluster"]: (r["n"], r["inertia"]) for r in found.summary.collect()} == sums
    return found


@pytest.fixture(scope="module")
def embeddings(spark, lake):
    return spark.read.parquet(f"{lake}/embeddings.parquet")


def test_lake_by_definition(embeddings):
    found = check(embeddings.repartition(3), 40, 5)
    n = embeddings.count()
    assert found.evaluated[0] == 40 * n
    assert max(found.evaluated[1:]) < 40 * n


def test_query(spark, lake, embeddings):
    rows = [(r["vec_id"], r["embedding"]) for r in embeddings.collect()]
    want, centroids = by_definition(rows, 40, 5)
    whole = sum(d for _, _, d in want)
    own = {j: sum(d for _, c, d in want if c == j) for j in range(40)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    got = queries.op12_ns_clusters(spark, lake)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", *["bigint"] * 3, "string"]
    assert sorted(map(tuple, got.collect())) == sorted(
        (key, j, d, own[j], whole, digest[j]) for key, j, d in want
    )


def test_awkward_vectors(spark):
    good = [float(i % 7) / 8 for i in range(64)]
    rows = [
        (1, good), (1, good), (1, [x + 1 for x in good]), (None, good), (2, None), (3, []), (4, good[:63]),
        (5, [*good, 0.0]), (6, [None, *good[1:]]), (7, [float("nan"), *good[1:]]),
        (8, [float("inf"), *good[1:]]), (9, [-1000.5] * 64), (10, [-1e-9] * 64), (11, [0.0] * 64),
    ]
    names = "vec_id long, embedding array<double>, cluster int, key string, distance int, x int"
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], names)
    assert check(df.repartition(3), 3, 5).assigned.count() == 7
    check(df, 40, 2)  # fewer vectors than clusters
    check(df, 1, 0)
    empty = ns.cluster(df.limit(0), 3, 2)
    assert empty.assigned.count() == 0 == empty.summary.count()
    assert ns.cluster(df.where("vec_id = 3"), 3, 2).assigned.count() == 0
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="components beyond"):
        ns.cluster(large, 2, 1)


def test_query_of_an_empty_table(spark, embeddings, tmp_path):
    embeddings.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_ns_clusters(spark, str(tmp_path)).count() == 0
