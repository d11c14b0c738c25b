"""Token ids by compiled public libraries, for operators whose method is not encoding."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

Ids = Callable[[list[str]], list[list[int]]]

# White space of this length goes another way: tiktoken's split fails on very long stretches.
blanks = re.compile(r"\s{2000}").search
# What byte-level tokenizer files split by, where they say so (``use_regex``). A fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _rank_file(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_ids(path: str, pattern: str, other: Ids) -> Ids:
    """Encodes by a rank file, strings of special tokens being ordinary text.

    ``other`` encodes texts of very long white space.
    """
    encode = _rank_file(path, pattern).encode_ordinary
    return lambda texts: [other([x])[0] if blanks(x) else encode(x) for x in texts]


@lru_cache(maxsize=4)
def library_ids(path: str) -> Ids:
    """Encodes as the tokenizers library does by its file, without special tokens around texts.

    A file of plain byte-level merges is also one of ranks: ids of tokens ascend as their merges
    do. Texts that hold an added token's string or very long white space go to the library
    itself, and so do all texts where the file is of another kind.
    """
    tokenizer = Tokenizer.from_file(path)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}

    def own(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    ranks = _ranks(path, added)
    if ranks is None:
        return lambda texts: [own(x) for x in texts]
    encode = tiktoken.Encoding(
        "file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary

    def ids(texts: list[str]) -> list[list[int]]:
        return [
            own(x) if blanks(x) or any(a in x for a in added) else encode(x) for x in texts
        ]

    return ids


def _ranks(path: str, added: set[str]) -> dict[bytes, int] | None:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != (
        "ByteLevel", False, True,
    ):
        return None
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if spec["normalizer"] or model["type"] != "BPE" or any(model.get(name) for name in odd):
        return None
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in added:
            ranks[bytes(byte[c] for c in token)] = i
    merged = []
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merged.append(model["vocab"][left + right])
    single = [ranks.get(bytes([b])) for b in range(256)]
    if None in single or sorted(ranks.values()) != sorted(single) + merged:
        return None
    return ranks
