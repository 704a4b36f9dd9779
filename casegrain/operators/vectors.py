"""Exact inner-product search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to the workers at once; with their dimension this bounds what is broadcast.
BLOCK = 1024
#: Rows of a batch that are multiplied at once, so that scores of BLOCK x ROWS are held, 16 MB.
ROWS = 2048


def best_of(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest scores of each row, ties by key: all that reach the k-th value are sorted, no others."""
    n = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
    r, c = np.nonzero(score >= least[:, None])
    order = np.lexsort((keys[c], -score[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < n], c[place < n]


def l2_normalise(c: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)).otherwise(F.transform(c, lambda x: x.cast("double")))


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score, rank): the k rows of greatest inner product for each query, ties by key.

    Queries come in blocks of BLOCK; each block passes once over the data as a matrix product, a worker keeps the
    k best for each query of every ROWS rows it reads, and a window takes the k best of these. Null vectors are left
    out; with fewer rows than k all are returned."""
    clean = data.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("_q"), F.col(vector).alias("_v"))
    kind, qkind = dict(clean.dtypes)["_key"], dict(asked.dtypes)["_q"]
    total = asked.count()
    blocks = max(1, -(-total // BLOCK))
    marked = asked.withColumn("_b", F.pmod(F.xxhash64("_q"), F.lit(blocks)))
    sc, best = data.sparkSession.sparkContext, None
    for b in range(blocks):
        rows = marked.where(F.col("_b") == b).select("_q", "_v").toPandas()
        if not len(rows):
            continue
        shared = sc.broadcast((rows["_q"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in rows["_v"]])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                for at in range(0, len(batch), ROWS):
                    rows = batch.iloc[at : at + ROWS]
                    keys = rows["_key"].to_numpy()
                    score = np.round(q @ np.stack([np.asarray(v, dtype=np.float64) for v in rows["_v"]]).T, 6)
                    i, j = best_of(score, keys, k)
                    yield pd.DataFrame({"_q": ids[i], "_key": keys[j], "score": score[i, j]})

        part = clean.mapInPandas(run, f"_q {qkind}, _key {kind}, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = data.sparkSession.createDataFrame([], f"_q {qkind}, _key {kind}, score double")
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "_key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("_q").alias(query_key), F.col("_key").alias(key), "score", "rank"
    )
