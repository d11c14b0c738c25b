from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from goldpan.llm import line_quality as lq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {
        i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(marked), failed


def counts(v):
    return v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\v\x85 #|é.", max_size=120))
def test_counts_equal_brute_force(text):
    assert counts(lq.judge(text)) == brute(text)


def test_counts_of_the_lake(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in lq.apply_rules(documents).collect():
        assert tuple(r[c] for c in names) == brute(texts[r["key"]])


def test_line_rules():
    rules = lq.Rules()
    good = "A plain sentence of some words ends here."
    assert lq.line_fails(good, rules) is None
    assert lq.line_fails('He said: "yes."', rules) is None
    assert lq.line_fails("no end mark here", rules) == "punctuation"
    assert lq.line_fails("Home | News | Sport | About.", rules) == "navigation"
    assert lq.line_fails("READ!! THIS!! NOW!!", rules) == "punctuation"
    assert lq.line_fails("All rights reserved by us.", rules) == "boilerplate"


def test_long_lines_of_sentences_need_no_last_mark():
    prose = " ".join(f"Sentence {i} tells of things number{i} that happened there." for i in range(9))
    for end in ("", " Call 030 1234567", " and then the text was cut in the mid", ' He said "no." Then'):
        found = lq.judge(prose + end)
        assert found.kept and found.cleaned == prose + end and found.lost_chars == 0
    assert lq.line_fails("这是第一句话，说了很多事情。" * 6 + "最后一句没有写完", lq.Rules()) is None
    plain = "one long line of many plain words and not a single mark anywhere in it at all"
    assert lq.line_fails(plain, lq.Rules()) == "punctuation"
    assert lq.line_fails("One. two three", lq.Rules()) == "punctuation"
    assert lq.line_fails("see version 3.5 of 12.7 at a.b.example for all of the many words", lq.Rules()) == "punctuation"


def test_a_phrase_costs_its_sentence_not_the_document():
    prose = " ".join(f"Sentence {i} tells of things number{i} that happened there." for i in range(90))
    for phrase in ("The site is powered by wind.", "See the terms of use!", "It was licensed under a deed;", "Lorem ipsum?"):
        more = " ".join(f"Part {i} reports on matters topic{i} which arose elsewhere." for i in range(90))
        found = lq.judge(f"{prose} {phrase} {more}")
        assert found.kept and phrase not in found.cleaned and "matters" in found.cleaned
        assert found.lost_chars < 250
    short = lq.judge(f"{prose}\nAll rights reserved. Powered by us.")
    assert short.cleaned == prose and short.lost_chars == len("Allrightsreserved.Poweredbyus.")


def test_prose_of_scripts_with_other_marks_or_none():
    for line in (
        "یہ ایک مکمل جملہ ہے جو یہاں ختم ہوتا ہے۔", "ይህ ሙሉ ዓረፍተ ነገር ነው።", "Սա ամբողջական նախադասություն է։",
        "这是一个完整的句子。", "これは文です。」", "यह एक वाक्य है।", "នេះជាប្រយោគមួយ។",
        "ภาษาไทยเขียนโดยไม่มีเครื่องหมายจบประโยคและคนอ่านก็เข้าใจได้จากบริบทของข้อความทั้งหมด",
    ):
        assert lq.line_fails(line, lq.Rules()) is None, line
    assert lq.line_fails("เมนูหลัก", lq.Rules()) == "punctuation"  # a short line without marks


def test_odd_names_stay(spark):
    text = "\n".join(f"One{i} may{i} read this{i} sentence{i} as{i} prose{i}." for i in range(9))
    docs = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, `a.b` string, `it``s` string")
    assert [tuple(r) for r in lq.clean(docs).collect()] == [(1, text, "x", "y")]


def test_lines_go_first_then_documents():
    body = "\n".join(f"One{i} may{i} read this{i} sentence{i} as{i} prose{i}." for i in range(9))
    mixed = lq.judge(f"Menu | Home | Out\n{body}\nCopyright, all rights reserved.")
    assert mixed.kept and mixed.cleaned == body
    menus = "\n".join(f"Item {i} | Link {i} | More {i * 3} | Next {i * 7}" for i in range(40))
    assert not lq.judge(f"{body}\n{menus}").kept


def test_labels(spark):
    """Held-out truth: clean documents stay, junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = lq.apply_rules(docs).join(labels.withColumnRenamed("doc_id", "key"), "key").collect()
    long = [r for r in found if not r["base_failed"]]
    good, bad = [[r["kept"] for r in long if r["quality"] == q] for q in (1, 0)]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_awkward_and_empty(awkward, nothing):
    found = {r["key"]: r for r in lq.apply_rules(awkward).collect()}
    assert not any(found[k]["kept"] for k in (3, 4, 5, 6, 8, 9))
    assert found[0]["kept"] and found[1]["kept"]
    cleaned = lq.clean(awkward)
    assert cleaned.schema == awkward.schema
    assert {r["doc_id"] for r in cleaned.collect()} == {0, 1, 2, 10, 11}
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "a" for r in cleaned.collect())
    assert lq.apply_rules(nothing).count() == 0 == lq.clean(nothing).count()
