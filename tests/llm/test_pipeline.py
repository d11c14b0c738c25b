from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from goldpan.llm import line_quality, queries
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import survivors


def test_stages_and_run(spark, lake, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, lake)
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.schema.names == documents.schema.names
            docs = spark.createDataFrame(kept[name], before.schema)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    judged = {k: line_quality.judge(t) for k, t in texts.items()}
    first = {r["doc_id"]: r["text"] for r in kept["quality rules"]}
    assert first == {k: v.cleaned for k, v in judged.items() if v.kept}
    second = {r["doc_id"] for r in kept["SimHash near-dedup"]}
    assert second == survivors(first)
    third = {r["doc_id"]: r for r in kept["secret scans"]}
    assert third.keys() == second and all(r["n_chars"] == len(r["text"]) for r in third.values())
    assert not any('token = "0' in r["text"] for r in third.values())
    tokens = defaultdict(int)
    for r in kept["best-fit packing"]:
        tokens[r["doc_id"]] += r["n_tokens"]
    keys = sorted(third)
    assert tokens == dict(zip(keys, ids_of([third[k]["text"] for k in keys])))
    whole = corpus_pipeline.run(spark, lake).collect()
    assert sorted(map(str, whole)) == sorted(map(str, kept["best-fit packing"]))


def test_empty_documents(spark, lake, nothing, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, lake)
        assert docs.count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
