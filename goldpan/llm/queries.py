"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from goldpan.llm import (
    balanced_packing,
    byte_bpe,
    host_paths,
    jump_shards,
    line_quality,
    ns_clusters,
    packing,
    periodic_runs,
    secret_scans,
    simhash,
    token_files,
    url_history,
    url_lists,
    weighted_sampling,
)
from goldpan.llm.common import stored, table

SHARDS = 40
RADIUS = 3
END_ID = 2
CLUSTERS, ROUNDS = 40, 5
CAPACITY, PACK_END_ID = 2048, 1


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents by token ids, with their sequences."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Ids are counted once: the pack reads its items twice, to cut ranges and to deal them out.
    items = stored(
        packing.counted_ids(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    )
    return packing.pack(items, "doc_id", "n_tokens").select(
        F.col("key").alias("doc_id"),
        "piece",
        "start",
        F.col("length").alias("n_tokens"),
        "bin",
        "bin_size",
        "offset",
    )


def op2_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    found = weighted_sampling.against_next(table(spark, folder, "documents"))
    return found.withColumnRenamed("key", "doc_id")


def op3_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = jump_shards.slots(jump_shards.assign(table(spark, folder, "documents"), SHARDS))
    return placed.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


def op4_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page under the lists of its fetch date."""
    pages = table(spark, folder, "pages")
    return url_lists.filtered(url_history.captures(pages), url_history.history(pages))


def op5_host_paths(spark: SparkSession, folder: str) -> DataFrame:
    return host_paths.extract(table(spark, folder, "pages")).select(
        F.col("key").alias("page_id"),
        "url",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
    )


def op6_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = line_quality.apply_rules(table(spark, folder, "documents"), with_text=False)
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_chars",
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    hashed = stored(simhash.fingerprints(table(spark, folder, "documents")))
    return simhash.groups(hashed, RADIUS).select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, folder, "documents"), path, pattern)
    return byte_bpe.decode(encoded, path, pattern).select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID
    )
    return token_files.read(manifest).withColumnRenamed("key", "doc_id")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate in every document; secrets themselves are returned as digests."""
    docs = table(spark, folder, "documents")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    forest = secret_scans.trained(spark, docs, vocabulary)
    return secret_scans.findings(docs, forest, vocabulary).select(
        F.col("key").alias("doc_id"),
        "start",
        "stop",
        "kind",
        F.sha2("secret", 256).alias("secret_sha256"),
        F.round("probability", 6).alias("probability"),
        "confirmed",
    )


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by the crc of doc_id, a stretch repeats to the end.

    With h = crc32(decimal doc_id), g = floor(h / 10) and n words, a text of h % 10 = 0 has
    word a + (i - a) % p for each word i >= a, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A NULL doc_id has no h.
    """
    hashed = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id AS string))").alias("h"))
    cut = r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"
    place = "CASE WHEN i < x.a THEN i ELSE x.a + (i - x.a) % x.p END"
    # Structs bind what is computed once: words, then where the stretch begins and its length.
    repeated = f"""
        transform(transform(transform(
            array(struct({cut} AS w, h div 10 AS g)),
            x -> struct(x.w AS w, x.g AS g, x.g % size(x.w) AS a)),
            x -> struct(x.w AS w, x.a AS a, 1 + (size(x.w) - x.a) div (3 + x.g % 8) AS p)),
            x -> array_join(
                transform(sequence(0, size(x.w) - 1), i -> x.w[cast({place} AS int)]), ' '))[0]
    """
    picked = r"h % 10 = 0 AND text RLIKE '[^\\x20\\x09-\\x0D]'"
    return hashed.select(
        "doc_id", F.expr(f"CASE WHEN {picked} THEN {repeated} ELSE text END").alias("text")
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(looped(table(spark, folder, "documents")))
    line = "concat_ws(',', run.start, run.length, run.period)"
    best = "strongest"
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"{best}.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr(f"1000 * {best}.length div {best}.period").alias("exponent_milli"),
        F.expr(f"sha2(array_join(transform(runs, run -> concat({line}, '\n')), ''), 256)").alias(
            "runs_sha256"
        ),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ns_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = ns_clusters.cluster(table(spark, folder, "embeddings"), CLUSTERS, ROUNDS)
    held = found.summary.collect()  # a row per cluster
    whole = sum(r["inertia"] for r in held)
    digests = [
        hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
        for c in found.centroids.tolist()
    ]
    summary = spark.createDataFrame(
        [(r["cluster"], r["inertia"], whole, digests[r["cluster"]]) for r in held],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.assigned.join(F.broadcast(summary), "cluster").select(
        F.col("key").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        "centroid_sha256",
    )


def op13_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return balanced_packing.pack(docs, path, PACK_END_ID, CAPACITY).select(
        F.col("key").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_weighted_sampling": op2_weighted_sampling,
        "op3_jump_shards": op3_jump_shards,
        "op4_url_lists": op4_url_lists,
        "op5_host_paths": op5_host_paths,
        "op6_line_quality": op6_line_quality,
        "op7_simhash": op7_simhash,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_token_planes": op9_token_planes,
        "op10_secret_scans": op10_secret_scans,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_ns_clusters": op12_ns_clusters,
        "op13_balanced_packing": op13_balanced_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL has the method; the others are tested against brute force."""
    return {"op4_url_lists": url_history.SQL}
