"""Bitmaps of bounded size that tell which rows can have a partner, so that only these are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap for each value, and the most it may have: 32 MB.
BITS_A_VALUE, MAX_BITS = 16, 1 << 28
#: Words that tasks pack into one row, so that the driver gets bytes and no row for each word.
BLOCK = 1 << 13


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """The words of one block as bytes."""
    block = np.zeros(BLOCK, dtype=np.int64)
    block[frame["word"].to_numpy() % BLOCK] = frame["bits"].to_numpy()
    return pd.DataFrame({"block": [int(frame["word"].iloc[0]) // BLOCK], "words": [block.tobytes()]})


def bitmap(values: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the low bits of values (v), hashes: it holds every value, and others by chance.

    It has BITS_A_VALUE bits for each of n values, but never more than MAX_BITS: what it holds by chance costs time only.
    """
    bits = min(MAX_BITS, max(64, 1 << (BITS_A_VALUE * n - 1).bit_length()))
    word = F.shiftright("v", 6).bitwiseAND(F.lit(bits // 64 - 1))
    words = values.select(word.cast("int").alias("word"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(max(BLOCK, bits // 64), dtype=np.uint64)
    for row in words.groupBy(F.floor(F.col("word") / BLOCK)).applyInPandas(_packed, "block int, words binary").collect():
        out[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["words"], dtype=np.uint64)
    out = out[: bits // 64]
    return out


def holds(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of values (unsigned) whether the bitmap may hold it."""
    word = (values >> np.uint64(6)) & np.uint64(len(words) - 1)
    return (words[word.astype(np.int64)] >> (values & np.uint64(63)) & np.uint64(1)).astype(bool)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _k and _v, equal only for rows of one doc_id and text; the key survives a second scan."""
    return docs.withColumn("_v", F.xxhash64("text")).withColumn("_k", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.lit("no id"), "text")))


def split_by_key(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed (_k, _v) that may have their key among keys, and those that surely don't."""
    held = keyed.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("_k", "_v").alias("v")), keys.count()))

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(holds(held.value, hashes.to_numpy(dtype=np.int64).view(np.uint64)))

    marked = keyed.withColumn("_may", may(F.xxhash64("_k", "_v")))
    return marked.where("_may").drop("_may"), marked.where("not _may").drop("_may")
