"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard, without a ring or a table; one more shard takes only the
share of rows that it is due, and only into itself. Slots within a shard are numbered without bringing a shard
to one task.

Cases: a null key hashes like the key 0 with its own salt, so all null keys share a shard; repeated keys share a
shard and get slots of their own; an empty table gives an empty result; existing columns named like the outputs
are replaced, all others pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, global_rank, table

SHARDS = 16
_NULL_KEY = 0x9E3779B97F4A7C15


def mixed(key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring keys start apart."""
    z = key.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: a key's walk visits shards in growing order, each new one with the chance that
    one more shard would have of taking it, and stops before the first that doesn't exist."""
    state, at, ahead = mixed(key), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a long key, as an int column. For other keys hash them with xxhash64 first."""
    if shards < 1:
        raise ValueError("shards must be positive")

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            nulls = np.asarray(batch.is_null())
            k = batch.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
            k[nulls] = _NULL_KEY
            yield pa.array(jump(k, shards).astype(np.int32), type=pa.int32())

    return F.arrow_udf(run, "int")(key)


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot, the row's number from 0 in its shard."""
    base = df.drop("shard", "grown_shard", "slot").withColumns({"shard": jump_shard(F.col(key), shards), "grown_shard": jump_shard(F.col(key), shards + 1)})
    return global_rank(base, ["shard"], [F.col(key).asc_nulls_last()], "slot")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    light = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    # ranges are sampled from the rows, which would compute them twice
    return assign_shards(cut(light), "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op5_jump_shards": op5_jump_shards}
SQL: dict[str, str] = {}
