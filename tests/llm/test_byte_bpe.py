from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from goldpan.llm import byte_bpe, pieces

PATH = public.path("byte_bpe_50k.tiktoken")


@lru_cache
def all_ranks():
    with open(PATH, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=all_ranks(), special_tokens={}
    )


HARD = [
    "", " ", "  a", "a  b", "\n\n a\n", "don't WE'LL 's", "<|endoftext|>", "a" * 3000, " " * 500,
    "====" * 99, "\x1c \x85  　x", "漢字かな😀é́", "1²½٣ 3.14", "the\tend \n",
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(library, text):
    (ids,) = byte_bpe.encoder(PATH, public.PATTERN).ids([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert byte_bpe.vocabulary(PATH, public.PATTERN).decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinorst hgl.'\n 1é漢=", max_size=60))
def test_any_text(text):
    ranks = all_ranks()
    own = byte_bpe.vocabulary(PATH, public.PATTERN)
    for piece in own.split_text(text):
        raw = piece.encode()
        assert own.piece(raw) == merged(raw, ranks)


def merged(raw, ranks):
    """Merges by rank, one at a time: what byte-level BPE is defined to do."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best = min(pairs, default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_small_memories_change_nothing(library, monkeypatch, documents):
    texts = [r["text"] for r in documents.limit(60).collect()]
    monkeypatch.setattr(pieces, "LONGEST", 3)
    own = pieces.Encoder(byte_bpe.vocabulary(PATH, public.PATTERN).encode)
    own.memory = pieces.Memory(10)
    for _ in range(2):
        assert [x.tolist() for x in own.ids(texts)] == [library.encode_ordinary(t) for t in texts]


@given(st.text(alphabet="ab \n\t ", max_size=40))
def test_stretches_rebuild_the_text(text):
    parts = pieces.stretches(text)
    assert " ".join(parts) == text
    assert all(part and not part[0].isspace() for part in parts[1:])


def test_round_trip_of_frames(library, awkward, nothing, documents):
    for docs in (awkward, documents):
        texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
        found = byte_bpe.decode(byte_bpe.encode(docs, PATH, public.PATTERN), PATH, public.PATTERN)
        rows = sorted((str(r["key"]), bytes(r["decoded"]).decode(), list(r["ids"])) for r in found.collect())
        assert [(k, t) for k, t, _ in rows] == texts
        assert all(ids == library.encode_ordinary(t) for _, t, ids in rows)
    empty = byte_bpe.encode(nothing, PATH, public.PATTERN)
    assert byte_bpe.decode(empty, PATH, public.PATTERN).count() == 0
