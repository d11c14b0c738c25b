from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from goldpan.llm import periodic_runs, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(words, least=24, periods=3):
    """All runs by comparing each word with the one a lag later, short lags first."""
    found, seen = [], set()
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            # Stretches of two periods or more are known by their ends: a lag that finds one
            # again is a multiple of its period.
            if i + q - start >= 2 * q and (start, i + q) not in seen:
                seen.add((start, i + q))
                if i + q - start >= max(least, periods * q):
                    found.append((start, i + q - start, q))
            i += 1
    return sorted(found, key=lambda run: (run[0], run[2]))


@st.composite
def repetitive(draw):
    letters = draw(st.integers(1, 5))
    words = draw(st.lists(st.integers(0, letters), max_size=150))
    for _ in range(draw(st.integers(0, 3))):
        if len(words) > 9:
            a = draw(st.integers(0, len(words) - 1))
            p = draw(st.integers(1, max(1, (len(words) - a) // 3)))
            words[a:] = [words[a + i % p] for i in range(len(words) - a)]
    return [b"%d" % w for w in words]


@settings(max_examples=300, deadline=None)
@given(repetitive(), st.sampled_from([5, 24]), st.integers(3, 4))
def test_runs_of_words(words, least, periods):
    assert periodic_runs.of_words(words, least, periods) == every_run(words, least, periods)


def test_splitting_keeps_what_runs_hold():
    draw = random.Random(3)
    words = [draw.randrange(40) for _ in range(400)]
    words[100:160] = [words[100 + i % 7] for i in range(60)]
    codes = np.array(words)
    parts = periodic_runs.segments(codes)
    assert any(low <= 100 and high >= 160 for low, high in parts)
    for low, high in parts:
        assert high - low >= 24
        assert min(np.unique(codes[low:high], return_counts=True)[1]) >= 3
    assert periodic_runs.segments(np.arange(1000)) == []


def test_long_texts_in_nearly_linear_time():
    n = 400_000
    began = time.process_time()
    assert periodic_runs.of_words([b"a"] * n) == [(0, n, 1)]
    assert periodic_runs.of_words([b"%d" % (i % 7919) for i in range(n)]) == [(0, n, 7919)]
    a, b = b"a", b"ab"  # Fibonacci: the most repetitions that a text can have
    while len(b) < 40_000:
        a, b = b, b + a
    assert len(periodic_runs.of_words([b[i : i + 1] for i in range(len(b))])) > 1000
    assert time.process_time() - began < 60


def expected(doc_id, text):
    """The contract's row of a document, from the definitions."""
    words = SPACE.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = every_run(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join("%d,%d,%d\n" % run for run in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, digest(lines), digest(collapsed))


ORDER = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
    "collapsed_sha256",
)


def check(spark, docs, tmp_path, most=3000):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select(*ORDER).collect()
    want = [
        expected(r["doc_id"], r["text"])
        for r in docs.collect()
        if len(SPACE.findall(r["text"] or "")) <= most
    ]
    held = {str(tuple(r)) for r in got}
    assert len(got) == docs.count() and held >= {str(r) for r in want}
    return got


def test_query_on_the_lake(spark, documents, tmp_path):
    got = check(spark, documents.repartition(3), tmp_path, 1000)
    assert sum(r["n_runs"] for r in got) > 10


def test_query_on_awkward_texts(spark, awkward, nothing, tmp_path):
    # Of the ids below h % 10 is 0 for a tenth: texts of one word, of blanks, of many words.
    more = spark.range(400).selectExpr(
        "id + 1000 AS doc_id",
        """CASE id % 5 WHEN 0 THEN 'one' WHEN 1 THEN ' \t ' WHEN 2 THEN NULL WHEN 3 THEN
           repeat('a b c d e f g h ', 9) ELSE array_join(transform(sequence(1, 90), x ->
           concat('w', x)), '\n') END AS text""",
    )
    got = check(spark, awkward.select("doc_id", "text", "key", "length").unionByName(
        more.selectExpr("*", "'k' AS key", "1 AS length")), tmp_path / "a")
    assert any(r["n_runs"] and r["doc_id"] is not None and r["doc_id"] >= 1000 for r in got)
    long = [r for r in got if r["doc_id"] == 8]
    assert [(r["start"], r["length"], r["period"]) for r in long] == [(0, 30_000, 1)]
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_periodic_runs(spark, f"{tmp_path}/b").count() == 0


def test_real_outputs(spark):
    text = "lead " + "x y " * 12 + "x tail"
    docs = spark.createDataFrame([(1, text), (2, None)], "id long, body string")
    one, two = periodic_runs.find(docs, "id", "body").orderBy("key").collect()
    assert [tuple(r) for r in one["runs"]] == [(1, 25, 2)] and tuple(one["strongest"]) == (1, 25, 2)
    assert one["collapsed"] == "lead x y tail"
    assert (two["runs"], two["strongest"], two["collapsed"]) == ([], None, "")
