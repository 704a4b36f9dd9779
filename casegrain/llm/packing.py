"""P8: filling containers of fixed capacity by sum-of-squares packing.

Each item goes where the sum of the squared numbers of open bins per residual gap becomes
smallest. The state is one count per gap, so a shard packs any number of items in memory
bounded by the capacity; shards are independent, and their number follows the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.lineage import cut
from casegrain.llm.tokens import VOCABULARY, count_tokens

CAPACITY = 2048


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number for each item, in order; sizes lie in 1..capacity.

    Placing an item of size s into a bin of gap g moves one bin from g to g - s: the sum of
    squares changes by 2 * (n[g - s] - n[g]) + 2, with gap 0 (a full bin) not counted; a new
    bin adds 2 * n[capacity - s] + 1. The smallest change wins, among equals the smallest gap."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.empty(len(sizes), dtype=np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        gaps = n[s:]
        best_gap, best = -1, 2 * n[capacity - s] + 1 if s < capacity else 0
        if s < capacity:
            there = np.nonzero(gaps)[0]
            if len(there):
                left = n[there]
                change = 2 * (left - gaps[there]) + 2
                if there[0] == 0:
                    change[0] = 1 - 2 * gaps[0]
                i = int(np.argmin(change))
                if change[i] <= best:
                    best_gap = int(there[i]) + s
        if best_gap < 0:
            b, bins, rest = bins, bins + 1, capacity - s
        else:
            b, rest = open_bins[best_gap].pop(), best_gap - s
            n[best_gap] -= 1
        if rest:
            n[rest] += 1
            open_bins[rest].append(b)
        out[k] = b
    return out


def pack(
    items: DataFrame, keys: list[str], size_col: str, capacity: int = CAPACITY, items_per_shard: int = 50_000
) -> DataFrame:
    """keys, piece, piece_size, container: every item assigned once.

    Items of null size or below 1 are left out. An item above the capacity, and only such a one,
    is cut into full pieces and a rest, which is packed with the others. Equal items and repeated
    rows are packed each for itself. An empty table gives no rows. Containers are numbered by
    shard, as "shard-number"; only keys and sizes move, never the texts."""
    clean = items.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(size_col).cast("long").alias("_size")).where("_size >= 1")
    full = F.floor((F.col("_size") - 1) / capacity).cast("int")
    parts = clean.select(
        *[f"_k{i}" for i in range(len(keys))],
        F.explode(F.sequence(F.lit(0), full)).alias("_piece"), "_size", full.alias("_last"),
    ).select(
        *[f"_k{i}" for i in range(len(keys))], "_piece",
        F.when(F.col("_piece") < F.col("_last"), F.lit(capacity)).otherwise(F.col("_size") - F.col("_last") * capacity).cast("int").alias("_n"),
    )
    parts = cut(parts)
    total = parts.count()
    shards = max(1, -(-total // items_per_shard))
    names = [f"_k{i}" for i in range(len(keys))]
    sharded = parts.withColumn("_shard", F.pmod(F.xxhash64(*names, "_piece"), F.lit(shards)).cast("long"))
    kinds = dict(parts.dtypes)

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([*names, "_piece"], kind="stable")
        # A fixed shuffle of the order: the rule is analysed for items in random order.
        shard = shard.iloc[np.random.default_rng(int(len(shard))).permutation(len(shard))]
        bins = sum_of_squares(shard["_n"].to_numpy(), capacity)
        out = shard[[*names, "_piece", "_n"]].copy()
        out["_container"] = [f"{s}-{b}" for s, b in zip(shard["_shard"], bins)]
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", _piece int, _n int, _container string"
    packed = sharded.groupBy("_shard").applyInPandas(run, schema)
    return packed.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_piece").alias("piece"),
        F.col("_n").alias("piece_size"), F.col("_container").alias("container"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers of whole texts measured in tokens of byte_bpe_50k; null and blank texts are left out."""
    blank = F.coalesce(F.regexp_replace(F.col(text_col), r"(?U)[\s\x1c-\x1f]+", ""), F.lit("")) == ""
    sized = docs.where(~blank).select(id_col, count_tokens(text_col, vocabulary).alias("_tokens"))
    return pack(sized, [id_col], "_tokens", capacity)
