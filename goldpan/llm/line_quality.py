"""Quality rules, lines first.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail go;
a document that loses too much of its text so is rejected, as are very short and very
repetitive ones. Of a line of several sentences those with a phrase of boilerplate go, not the
line. Headings and other lines without a last mark always go. Words are runs of
anything but ASCII white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import batched, by_place, rows

SYMBOLS = "#*$%&|<>"  # the counted symbols, a fixed value
BLANKS = " \t\n\v\f\r"
# Marks that end a sentence, closing quotes and brackets aside.
ENDS = tuple(".!?…:;。！？؟।")
CLOSERS = "\"'”’»›)]}）」』"
# A sentence that ends inside a line: full-width marks need no blank after them.
INSIDE = re.compile(rf"(?:[.!?…؟।][{re.escape(CLOSERS)}]*\s|[。！？])")
# The last marks of every script, closing quotes and brackets aside, and letters of scripts that
# write none.
LAST = regex.compile(rf"[\p{{Sentence_Terminal}}…:;]+[{re.escape(CLOSERS)}\s]*$")
UNMARKED = regex.compile(r"[\p{Thai}\p{Lao}]")
SEPARATORS = re.compile(r"(?<!\S)[|•·»›>/\\–—-]+(?!\S)")
MARKED = re.compile(r"(?:[#*$%&|<>]{2,}|!{2,}|\?{2,})(?!\S)")
# Phrases of pages rather than of texts, in lower case.
BOILERPLATE = (
    "cookie policy",
    "cookie settings",
    "cookie consent",
    "we use cookies",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "enable javascript",
    "requires javascript",
    "lorem ipsum",
    "sign up for our",
    "subscribe to our",
    "skip to content",
    "skip to main content",
    "powered by",
    "licensed under",
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; the defaults keep prose of any of the usual languages."""

    least_words: int = 10  # of a document
    most_repeated: int = 20  # per cent of words in repeated windows
    window: int = 5
    marked_share: float = 0.3  # of a line's words with trailing symbols: not prose
    separators: int = 3  # in a line: a menu or a table row
    separator_share: float = 0.2  # of a line's words
    long_words: int = 10  # a line of so many words, or
    long_chars: int = 60  # of so many characters, may lack its last mark if a sentence ends inside
    most_lost: float = 0.5  # share of a document's word characters in failing lines


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows that occur more than once, first occurrences included."""
    if len(words) < window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    first: dict[tuple, int] = {}
    if len(set(grams)) == len(grams):
        return 0
    covered = bytearray(len(words))
    full = b"\x01" * window
    for at, gram in enumerate(grams):
        seen = first.setdefault(gram, at)
        if seen != at:
            covered[at : at + window] = full
            covered[seen : seen + window] = full
    return sum(covered)


def line_fails(line: str, rules: Rules, marks: bool = True, phrases: bool = True) -> str | None:
    """The rule that a line with words fails, or None.

    ``marks`` and ``phrases`` may be False where the whole text has none.
    """
    if marks:
        words = len(line.split())
        bars = len(SEPARATORS.findall(line))
        if bars >= rules.separators and bars >= rules.separator_share * words:
            return "navigation"
        if len(MARKED.findall(line)) > rules.marked_share * words:
            return "punctuation"
    if phrases and any(map(line.lower().__contains__, BOILERPLATE)):
        return "boilerplate"
    if line.rstrip().rstrip(CLOSERS).endswith(ENDS):
        return None
    long = len(line.strip()) >= rules.long_chars or len(line.split()) >= rules.long_words
    if long and INSIDE.search(line):
        return None
    if line.isascii():
        return "punctuation"
    if LAST.search(line):
        return None
    unmarked = len(UNMARKED.findall(line))
    return None if long and 2 * unmarked > len(line.strip()) else "punctuation"


def without_phrases(line: str) -> str:
    """The line without its sentences that hold a phrase of boilerplate; as it is if all do."""
    if not any(map(line.lower().__contains__, BOILERPLATE)):
        return line
    ends = [found.end() for found in INSIDE.finditer(line)]
    parts = [line[a:b] for a, b in zip([0, *ends], [*ends, len(line)])]
    kept = [x for x in parts if not any(map(x.lower().__contains__, BOILERPLATE))]
    return "".join(kept) if any(x.strip(BLANKS) for x in kept) else line


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    lost_chars: int
    kept: bool
    cleaned: str


def judge(text: str, rules: Rules = Rules()) -> Verdict:
    """Counts, the text of the lines that pass, and whether the document is kept."""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    repeats = repeated_words(words, rules.window)
    failed = n_words < rules.least_words or 100 * repeats > rules.most_repeated * n_words
    marks = bool(SEPARATORS.search(text) or MARKED.search(text))
    phrases = any(map(text.lower().__contains__, BOILERPLATE))
    seen: set[str] = set()
    kept_lines: list[str] = []
    dup_lines = lost = 0
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        if not bare:
            kept_lines.append(line)
            continue
        again = line in seen
        dup_lines += again
        seen.add(line)
        # A line that the document has had before is boilerplate too.
        left = line if again or not phrases else without_phrases(line)
        if again or line_fails(left, rules, marks, phrases):
            left = None
        else:
            kept_lines.append(left)
        if left is not line:
            lost += _solid(line) - _solid(left or "")
    kept = not failed and lost <= rules.most_lost * word_chars
    symbols = sum(map(text.count, SYMBOLS))
    return Verdict(
        n_words, word_chars, symbols, dup_lines, repeats, failed, lost, kept, "\n".join(kept_lines)
    )


def _solid(text: str) -> int:
    """Characters in words."""
    return len(text) - sum(map(text.count, BLANKS))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")


def apply_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules(),
    with_text: bool = True,
) -> DataFrame:
    """(key, counts, base_failed, kept, cleaned) of every whole text, a row for each.

    ``cleaned`` is the text of the lines that passed, NULL if not asked for. NULL, empty and
    blank texts have no words and fail. Repeated rows stay; other columns are ignored.
    """
    chosen = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, cleaned string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = pa.schema(
                [("key", batch.column("key").type)]
                + [(c, pa.int64()) for c in COUNTS]
                + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())]
            )

            def records(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for own, body in rows(iter([batch]), "key", "text"):
                    v = judge(body, rules)
                    counts = (getattr(v, c) for c in COUNTS)
                    yield own, *counts, v.base_failed, v.kept, v.cleaned if with_text else None

            yield from batched(records(), arrow)

    return chosen.mapInArrow(run, schema)


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The columns of ``docs`` for the documents that are kept, with their cleaned texts.

    Rows need no key: text and verdict travel with the row. ``n_chars``, if there is such a
    column, follows the new text. NULL, empty and blank texts are rejected, repeated rows
    judged one by one, an empty table gives no rows. Other columns stay, whatever their names.
    """
    names = docs.columns
    plain = by_place(docs)
    body_at = f"c{names.index(text)}"
    size_at = f"c{names.index(n_chars)}" if n_chars in names else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for i, (body,) in enumerate(rows(iter([batch]), body_at)):
                verdict = judge(body or "", rules)
                if verdict.kept:
                    keep.append(i)
                    texts.append(verdict.cleaned)
            part = batch.take(pa.array(keep, pa.int64()))
            at = part.schema.get_field_index(body_at)
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            if size_at:
                at = part.schema.get_field_index(size_at)
                sizes = pa.array(map(len, texts), part.schema.field(at).type)
                part = part.set_column(at, part.schema.field(at), sizes)
            yield part

    return plain.mapInArrow(run, plain.schema).toDF(*names)
