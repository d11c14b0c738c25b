"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of the characters keys are made of, with a letter and a digit,
or a private key block. The forest sees the candidate's length and characters, how usual
its character transitions are, how much of it dictionary words cover, the path of the
document and the words around. It is trained here, by Spark, from labelled findings, and
its trees, a few thousand numbers, go with the tasks that scan.
"""

from __future__ import annotations

import base64
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldpan.llm.common import batched, by_place, rows

# A key may stand directly after "=", as in .env lines and query strings; "=" is its own only as
# padding at the end. A run directly before "=" and a value is the name of that value.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
KEY_MARK = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
# Lines as "Proc-Type: 4,ENCRYPTED" or "Version: GnuPG v2"; line ends may be written as \n.
KEY_HEADERS = r"(?:(?:\s|\\[nr])*[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*(?:[\r\n]|\\[nr]))*"
PRIVATE_KEY = re.compile(
    rf"-----BEGIN {KEY_MARK}(?:{KEY_HEADERS}[A-Za-z0-9+/=\s\\]*-----END {KEY_MARK})?"
)
# Public formats of providers' keys: a fixed value.
PREFIXES = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk_live_|rk_live_|glpat-|eyJ|npm_|SG\.")
NEAR = 48  # characters around a candidate in which words count
SECRET_WORDS = re.compile(
    r"token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|private|credential|auth|bearer|\bkey\b",
    re.IGNORECASE,
)
OTHER_WORDS = re.compile(
    r"commit|sha-?\d*|md5|hash|checksum|digest|etag|uuid|guid|revision|build|version|example|dummy"
    r"|sample|placeholder|changeme|\btest\b|fixture|integrity|\bid\b",
    re.IGNORECASE,
)
TEST_PATH = re.compile(r"test|example|sample|fixture|mock|doc|spec|vendor|node_modules|\.lock", re.IGNORECASE)
CONFIG_PATH = re.compile(r"\.(?:env|ya?ml|json|ini|cfg|conf|properties|toml|pem|key)\b|config|secret", re.IGNORECASE)
ASSIGNED = re.compile(r"(?:=|:|=>)\s*[\"'`]?\Z")
REPLACEMENT = "[SECRET]"
FEATURES = (
    "length", "digits", "upper", "hexadecimal", "entropy", "transitions", "dictionary",
    "separators", "longest_run", "prefix", "assigned", "quoted", "secret_words", "other_words",
    "test_path", "config_path",
)
SYMBOLS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
DIGIT, REST = 26, 27


class Dictionary:
    """Words of a public vocabulary, and how usual each character transition in them is."""

    def __init__(self, words: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        counts = np.ones((28, 28))
        for word in words:
            self.automaton.add_word(word, len(word))
            codes = [SYMBOLS[c] for c in word]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.automaton.make_automaton()
        self.logs = np.log2(counts / counts.sum(axis=1, keepdims=True)).tolist()

    def covered(self, text: str) -> float:
        """Share of the characters inside dictionary words of four letters or more."""
        low = text.lower()
        marks = bytearray(len(low))
        for end, size in self.automaton.iter(low):
            marks[end + 1 - size : end + 1] = b"\x01" * size
        return sum(marks) / len(low)

    def transitions(self, text: str) -> float:
        """Mean logarithm of the transitions' frequencies."""
        codes = [
            SYMBOLS.get(c, DIGIT if c.isdigit() else REST) for c in text.lower()
        ]
        logs = [self.logs[a][b] for a, b in zip(codes, codes[1:])]
        return sum(logs) / max(1, len(logs))


@lru_cache(maxsize=2)
def dictionary(path: str) -> Dictionary:
    """The lower-case ASCII words of four letters or more in a rank file."""
    with open(path, "rb") as file:
        tokens = (base64.b64decode(line.split()[0]).strip() for line in file)
        words = {t.decode() for t in tokens if len(t) >= 4 and t.isalpha() and t.islower()}
    return Dictionary(sorted(words))


def features(text: str, start: int, stop: int, path: str | None, words: Dictionary) -> list[float]:
    """The numbers by which the forest judges the candidate at [start, stop)."""
    own = text[start:stop]
    bare = own.rstrip("=")
    before, after = text[max(0, start - NEAR) : start], text[stop : stop + NEAR]
    n = len(bare)
    counts = Counter(bare)
    digits = sum(c.isdigit() for c in bare)
    letters = sum(c.isalpha() for c in bare)
    runs = re.findall(r"[A-Za-z]+|\d+", bare)
    around = f"{before} {after}"
    return [
        float(len(own)),
        digits / n,
        sum(c.isupper() for c in bare) / max(1, letters),
        float(not bare.strip("0123456789abcdefABCDEF-")),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        words.transitions(bare),
        words.covered(bare),
        sum(c in "-_/+" for c in bare) / n,
        max(map(len, runs), default=0) / n,
        float(bool(PREFIXES.match(own))),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in "\"'`" and bool(before) and after[:1] in "\"'`" and bool(after)),
        float(len(SECRET_WORDS.findall(before))),
        float(len(OTHER_WORDS.findall(around))),
        float(bool(path and TEST_PATH.search(path))),
        float(bool(path and CONFIG_PATH.search(path))),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, kind) of every candidate, in order, none inside another."""
    blocks = [(m.start(), m.end()) for m in PRIVATE_KEY.finditer(text)] if "-----BEGIN" in text else []
    ends = [end for _, end in blocks]
    found = [(a, b, "private key") for a, b in blocks]
    for m in CANDIDATE.finditer(text):
        own = m.group()
        if not (any(c.isdigit() for c in own) and any(c.isalpha() for c in own)):
            continue
        at = bisect_left(ends, m.end())
        if at < len(blocks) and blocks[at][0] <= m.start():
            continue
        found.append((m.start(), m.end(), "key"))
    return iter(sorted(found))


# Labelled findings -------------------------------------------------------------------


def _finding(draw: random.Random, words: list[str]) -> tuple[str, str, str, str, int]:
    """(before, candidate, after, path, label) of one labelled finding.

    True ones are random strings where code and notes assign them; false ones are what
    scanners trip over: digests, identifiers, names, paths, placeholders.
    """
    def chars(letters: str, n: int) -> str:
        return "".join(draw.choices(letters, k=n))

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    paths = ["src/app.py", "config/settings.yaml", ".env", "deploy/prod.json", "notes.md", "web", ""]
    tests = ["tests/test_api.py", "docs/example.md", "fixtures/mock.json", "yarn.lock"]
    if draw.random() < 0.5:
        own = draw.choice(
            [
                lambda: chars("0123456789abcdef", draw.choice([32, 40, 40, 48, 64])),
                lambda: chars("0123456789ABCDEF", draw.choice([32, 40, 64])),
                lambda: chars(mixed, draw.randint(20, 64)),
                lambda: chars(mixed + "+/", draw.randint(24, 86)) + draw.choice(["", "=", "=="]),
                lambda: "AKIA" + chars(lower.upper() + digits, 16),
                lambda: draw.choice(["ghp_", "sk_live_", "npm_"]) + chars(mixed, 36),
            ]
        )()
        word = draw.choice(
            ["token", "api_key", "secret", "password", "auth_token", "access_key", "key", "TOKEN", "bearer", "credential"]
        )
        before, after = draw.choice(
            [
                (f'{word} = "', '"'),
                (f"{word} = '", "'"),
                (f"{word}: ", ""),
                (f"{word}=", ""),
                (f'"{word}": "', '",'),
                (f"my {word} is ", ""),
                (f"{word} ", ""),
            ]
        )
        return before, own, after, draw.choice(paths), 1
    kind = draw.randrange(6)
    if kind == 0:
        own = chars("0123456789abcdef", draw.choice([32, 40, 64]))
        before = draw.choice(["commit ", "sha256:", "md5 ", "checksum = ", "etag: ", "revision ", "hash of "])
    elif kind == 1:
        own = "-".join(chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        before = draw.choice(["uuid ", "id: ", "request id = ", "guid=", ""])
    elif kind == 2:
        own = draw.choice("_-/").join(draw.choices(words, k=draw.randint(3, 5))) + chars(digits, draw.randint(1, 4))
        before = draw.choice(["see ", "file = ", "the ", "class ", "key: ", ""])
    elif kind == 3:
        own = "".join(w.title() for w in draw.choices(words, k=draw.randint(3, 5))) + chars(digits, 2)
        before = draw.choice(["call ", "the ", "name = ", "class "])
    elif kind == 4:
        own = draw.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxx1234", "0123456789abcdef0123", "changeme_changeme_1", "example-token-000000"])
        before = draw.choice(['token = "', "api_key: ", "password=", "example "])
    else:
        own = chars(digits, draw.randint(14, 20)) + draw.choice(["px", "ms", "GB", "x", "UTC"])
        before = draw.choice(["id ", "at ", "order ", "number = ", ""])
    return before, own, draw.choice(["", "", ".", '"']), draw.choice(paths + tests * 2), 0


def labelled_texts(
    docs: DataFrame, path: str, count: int = 3000, key: str = "doc_id", text: str = "text", seed: int = 5
) -> Iterator[tuple[str, int, int, str, int]]:
    """(text, start, stop, path, label): findings of known truth in the surroundings of real texts.

    Surroundings come from at most ``count`` rows, chosen by their hashes, a bounded
    training sample; an empty table gives findings without surroundings. Here only are
    texts cut: a finding is placed between the words of such a scene.
    """
    body = F.coalesce(docs[text], F.lit(""))
    # A share of rows a little above ``count``, then the first by hash: the same rows however the
    # table lies in files, and few are put in order.
    share = int(min(1.0, (1.2 * count + 100) / max(1, docs.count())) * (1 << 40))
    place = F.pmod(F.xxhash64(key, body), F.lit(1 << 40))
    scenery = docs.select(place.alias("h"), F.substring(body, 1, 400).alias("s"))
    chosen = scenery.where(F.col("h") < share).orderBy("h", "s").limit(count).collect()
    scenes = sorted({r["s"] for r in chosen})
    found, own = dictionary(path), random.Random(seed)
    words = sorted(w for w in found.automaton.keys() if len(w) < 10)
    for i in range(count):
        scene = scenes[i % len(scenes)].split(" ") if scenes else [""]
        at = own.randrange(len(scene) + 1)
        before, secret, after, place, label = _finding(own, words)
        head = " ".join(scene[:at]) + " " + before
        whole = head + secret + after + " " + " ".join(scene[at:])
        yield whole, len(head), len(head) + len(secret), place, label


def labelled_findings(
    docs: DataFrame, path: str, count: int = 3000, key: str = "doc_id", text: str = "text", seed: int = 5
) -> DataFrame:
    """(features, label) of ``labelled_texts``."""
    found = dictionary(path)
    out = [
        (features(whole, start, stop, place, found), float(label))
        for whole, start, stop, place, label in labelled_texts(docs, path, count, key, text, seed)
    ]
    return docs.sparkSession.createDataFrame(out, "features array<double>, label double").coalesce(1)


@dataclass
class Forest:
    """Trees as arrays: feature, threshold, left and right child, share of true findings."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Mean share over the trees, for a row of features each."""
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while (inner := self.feature[at] >= 0).any():
                who = np.flatnonzero(inner)
                here = at[who]
                low = rows[who, self.feature[here]] <= self.threshold[here]
                at[who] = np.where(low, self.left[here], self.right[here])
            total += self.share[at]
        return total / len(self.roots)


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 7) -> Forest:
    """A random forest from labelled findings (features, label), by Spark's own trainer."""
    vectors = findings.select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    nodes: list[list[float]] = []

    def walk(node: object) -> int:
        at = len(nodes)
        nodes.append([])
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            nodes[at] = [-1, 0.0, 0, 0, stats[1] / sum(stats)]
        else:
            split = node.split()
            left = walk(node.leftChild())
            right = walk(node.rightChild())
            nodes[at] = [split.featureIndex(), split.threshold(), left, right, 0.0]
        return at

    roots = [walk(tree._call_java("rootNode")) for tree in model.trees]
    columns = np.array(nodes).T
    return Forest(
        np.array(roots),
        columns[0].astype(int),
        columns[1],
        columns[2].astype(int),
        columns[3].astype(int),
        columns[4],
    )


def scan(text: str, path: str | None, forest: Forest, words: Dictionary) -> list[tuple]:
    """(start, stop, kind, probability) of the candidates of a text."""
    found = list(candidates(text))
    if not found:
        return []
    matrix = np.array([features(text, a, b, path, words) for a, b, _ in found])
    chances = forest.probability(matrix).tolist()
    return [(a, b, kind, 1.0 if kind == "private key" else p) for (a, b, kind), p in zip(found, chances)]


def findings(
    docs: DataFrame, forest: Forest, vocabulary: str, key: str = "doc_id", text: str = "text",
    path: str | None = "source", least: float = 0.5,
) -> DataFrame:
    """(key, start, stop, kind, secret, probability, confirmed) of every candidate in every text.

    Places count code points. ``secret`` is the found text itself: hash it before it goes
    anywhere. NULL and empty texts, and an empty table, have none; a NULL path is no path.
    """
    place = docs[path].cast("string") if path else F.lit(None).cast("string")
    chosen = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"), place.alias("path"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for batch in batches:
            schema = pa.schema(
                [("key", batch.column("key").type), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]
                + [("secret", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]
            )

            def records(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for own, body, place in rows(iter([batch]), "key", "text", "path"):
                    for start, stop, what, chance in scan(body, place, forest, words):
                        yield own, start, stop, what, body[start:stop], chance, chance >= least

            yield from batched(records(), schema)

    shape = f"key {kind}, start long, stop long, kind string, secret string, probability double, confirmed boolean"
    return chosen.mapInArrow(run, shape)


def redacted(
    docs: DataFrame, forest: Forest, vocabulary: str, text: str = "text", path: str | None = "source",
    n_chars: str = "n_chars", least: float = 0.5,
) -> DataFrame:
    """All rows and columns of ``docs``, confirmed secrets replaced by a mark.

    Texts without any are untouched, NULLs too. ``n_chars``, if there is such a column,
    follows the new text. Repeated rows are scanned one by one, an empty table gives no rows,
    columns of any name stay as they are.
    """
    names = docs.columns
    plain = by_place(docs)
    at_of = {name: f"c{names.index(name)}" for name in (text, path, n_chars) if name in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for batch in batches:
            texts: list[str | None] = []
            chosen = [at_of[name] for name in (text, path) if name in at_of]
            for body, *place in rows(iter([batch]), *chosen):
                pieces, at = [], 0
                for start, stop, _, chance in scan(body or "", place[0] if place else None, forest, words):
                    if chance >= least:
                        pieces += [body[at:start], REPLACEMENT]
                        at = stop
                texts.append("".join([*pieces, body[at:]]) if pieces else body)
            for name, values in ((text, texts), (n_chars, None)):
                if name in at_of:
                    at = batch.schema.get_field_index(at_of[name])
                    if values is None:
                        values = [
                            old if new is None else len(new)
                            for old, new in zip(batch.column(at).to_pylist(), texts)
                        ]
                    kind = batch.schema.field(at)
                    batch = batch.set_column(at, kind, pa.array(values, kind.type))
            yield batch

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def trained(spark: SparkSession, docs: DataFrame, vocabulary: str) -> Forest:
    """The forest for these documents' surroundings."""
    return train(labelled_findings(docs, vocabulary))
