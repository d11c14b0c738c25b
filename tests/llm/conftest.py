from __future__ import annotations

import pytest

# Texts of every awkward kind: NULL, empty, blank, short, long, with ties and copies.
PROSE = (
    "The quick brown fox jumps over the lazy dog near the quiet river bank today. "
    "Many other animals watch it from the shade and say nothing at all about that."
)
TEXTS = [
    PROSE,
    PROSE,  # a copy under another key
    PROSE.upper(),
    None,
    "",
    " \n\t ",
    "word",
    "Straße déjà vu 漢字 😀 \x85 　 end.",
    "long " * 30_000 + "tail.",
    "x" * 50_000,
    PROSE.replace("quick", "slow") + " One more sentence ends here.",
    "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" and more.\n" + PROSE,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts with a NULL key, a repeated row, and columns named like results."""
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key here."), (6, "word")]
    rows = [(k, t, "en", "src", 1, "a", "b", 7, "c", 5, "d") for k, t in data]
    names = (
        "doc_id long, text string, lang string, source string, n_chars long, key string, "
        "fp string, shard int, slot string, length int, _range string"
    )
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def lake():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, lake):
    return spark.read.parquet(f"{lake}/documents.parquet")
