from __future__ import annotations

import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash

from goldpan.llm import weighted_sampling as ws


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_collisions_follow_generalised_jaccard():
    draw = np.random.default_rng(1)
    for spread in (3, 8, 20, 60):
        one = Counter({f"w{i}".encode(): int(draw.integers(1, 30)) for i in range(40)})
        other = Counter({k: max(0, v + int(draw.integers(-spread, spread + 1))) for k, v in one.items()})
        other = +other
        a, b = ws.sketch([one, other], samples=4000)
        assert abs(np.mean(a == b) - jaccard(one, other)) < 0.04


def test_sketch_does_not_depend_on_company(monkeypatch):
    texts = [ws.words(f"a b c {i} a {i % 7} b") for i in range(50)]
    whole = ws.sketch(texts)
    monkeypatch.setattr(ws, "TERMS", 5)
    assert np.array_equal(whole, ws.sketch(texts))
    assert np.array_equal(whole[3:4], ws.sketch(texts[3:4]))


def one_word_at_a_time(weights, samples):
    """Consistent weighted samples by their definition, a word and a position after the other."""
    whole = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & whole
        return x ^ x >> 31

    def uniforms(h, n):
        bits = mixed((h + n * 0x9E3779B97F4A7C15) & whole)
        return [np.float32(x + 0.5) * np.float32(2.0**-24) for x in (bits >> 40, bits >> 8 & 0xFFFFFF)]

    out = []
    for s in range(samples):
        best = None
        for word, weight in weights.items():
            h = xxhash.xxh64_intdigest(word, 1)
            (a, b), (c, d) = uniforms(h, s + 1), uniforms(h, samples + s + 1)
            beta = uniforms(h, 2 * samples + s + 1)[0]
            rate, log_c = -np.log(a * b), np.log(-np.log(c * d))
            t = np.floor(np.log(np.float32(weight)) / rate + beta) if weight > 1 else np.float32(0)
            value = log_c - rate * (t - beta + 1)
            if best is None or value < best[0]:
                best = value, h, int(t)
        out.append(mixed((best[1] + (best[2] + 1) * 0x9E3779B97F4A7C15) & whole) >> 48)
    return out


def test_samples_by_definition(monkeypatch):
    draw = np.random.default_rng(3)
    sets = [Counter({f"w{i}".encode(): int(draw.choice([1, 1, 2, 5, 900])) for i in range(n)}) for n in (1, 3, 30)]
    want = [one_word_at_a_time(s, 16) for s in sets]
    assert ws.sketch(sets, 16).tolist() == want
    monkeypatch.setattr(ws, "TERMS", 7)  # the last one in blocks
    assert ws.sketch(sets, 16).tolist() == want


def test_a_million_different_words_in_bounded_memory():
    weights = Counter({b"%d" % i: 1 + i % 3 for i in range(1_000_000)})
    tracemalloc.start()
    ws.sketch([weights])
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_empty_texts():
    none, some = ws.sketch([Counter(), ws.words("a b")])
    assert ws.likeness(none, none) == 1 and ws.likeness(none, some) == 0 == ws.likeness(some, none)


def expected(rows):
    ordered = [(k, t or "") for k, t in rows]
    out = {}
    for i, (key, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        a, b, c = ws.sketch([ws.words(x) for x in (text, edited, following)])
        out[key] = (
            len(text), sha256(edited.encode()).hexdigest(), ws.likeness(a, b), ws.likeness(a, c)
        )
    return out


def test_against_next_equals_a_walk_in_order(documents, spark):
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found = ws.against_next(documents.repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
        want = expected(rows)
        got = {
            r["key"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found
        }
        assert got == want and len(found) == len(rows)


def test_awkward_and_empty(awkward, nothing):
    found = ws.against_next(awkward).collect()
    assert len(found) == awkward.count()
    prints = {r["key"]: r["fingerprint"] for r in found}
    assert prints[0] == prints[1] == prints[2] and prints[3] == prints[4] == prints[5]
    one = ws.against_next(awkward.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert ws.against_next(nothing).count() == 0
    assert ws.fingerprints(nothing).count() == 0
    alone = {r["key"]: r["fingerprint"] for r in ws.fingerprints(awkward).collect()}
    assert alone == prints


def test_words_of_earlier_texts_are_not_drawn_again(monkeypatch):
    texts = [ws.words(f"a b c {i % 9} a {i % 7} b w{i}") for i in range(200)]
    whole = ws.sketch(texts)
    drawn, own = [], ws._drawn
    monkeypatch.setattr(ws, "_drawn", lambda terms, samples: drawn.extend(terms) or own(terms, samples))
    known = ws.Terms()
    parts = [ws.sketch(texts[i : i + 10], known=known) for i in range(0, 200, 10)]
    assert np.array_equal(whole, np.concatenate(parts))
    assert len(drawn) == len(set(drawn)) == len(set().union(*texts))


def test_what_was_drawn_is_kept_of_few_words(monkeypatch):
    texts = [ws.words(f"a b c {i % 9} a {i % 7} b w{i} w{i + 1}") for i in range(200)]
    whole = ws.sketch(texts)
    monkeypatch.setattr(ws, "KEPT", 20)
    monkeypatch.setattr(ws, "TERMS", 15)
    known = ws.Terms()
    parts = [ws.sketch(texts[i : i + 10], known=known) for i in range(0, 200, 10)]
    assert np.array_equal(whole, np.concatenate(parts))
    assert known.size == len(known.place) <= 20 and {b"a", b"b", b"c"} <= known.place.keys()
    assert all(known.table[0][row] == xxhash.xxh64_intdigest(term, 1) for term, row in known.place.items())
