"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. One
more shard takes its fair part of the rows from all others, and no other row moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import numbered, text_bytes

# The generator's multiplier, and what a row costs besides its text.
MULTIPLIER = np.uint64(2862933555777941757)
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys.

    Each key draws the shard counts at which it would jump to the newest shard; its
    shard is the last jump below the present count. All keys advance together.
    """
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    here = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while going.size:
        state[going] = state[going] * MULTIPLIER + np.uint64(1)
        draw = ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = ((here[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moves = target < shards
        going = going[moves]
        here[going] = target[moves]
    return here.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type. A NULL key is a key like any other."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(), shards))

    return place(F.xxhash64(key))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard) of every row.

    ``size`` is the text's UTF-8 bytes and a fixed cost per row. Equal keys share a
    shard whatever their texts. A NULL text has no bytes and the checksum 0 of an empty
    one; an empty table gives no rows; other columns of the input are ignored.
    """
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[key].alias("key"),
        (text_bytes(docs[text]) + ROW_BYTES).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(docs[key], shards).alias("shard"),
        shard_of(docs[key], shards + 1).alias("grown_shard"),
    )


def slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, in order of key, then checksum."""
    return numbered(assigned, ["shard"], ["key", "text_crc32", "size"], "slot")


def store(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Writes all columns of ``docs`` below one folder per shard.

    The rebalance hint lets adaptive execution split large shards over several files.
    """
    placed = docs.withColumn("shard", shard_of(docs[key], shards))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
