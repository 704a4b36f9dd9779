"""P7: encoding a whole corpus with a public byte-level BPE vocabulary.

The words are split in Spark by the vocabulary's own pattern, every distinct word is encoded
once, and the ids are joined back by position. Of the table of distinct words the head, words of at least HEAD_SHARE of
all and HEAD_LETTERS at most (100,000 words), is broadcast, so that frequent words are joined where they stand and no
word is a hot key; the rest is joined by shuffle. A document's ids are gathered before the shuffle, a row for each
document and task. Decoding is a join with the id-to-piece table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions.lineage import cut

VOCABULARY = os.environ.get("CASEGRAIN_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text before the merges, fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD_SHARE, HEAD_LETTERS = 1e-5, 64


def ranks(vocabulary: str = VOCABULARY, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(f"{vocabulary}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoder(vocabulary: str = VOCABULARY, name: str = "byte_bpe_50k", pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(vocabulary, name), special_tokens={})


_ENCODERS: dict[tuple, object] = {}


def _encoder(*key):
    """One encoder for a Python worker's life."""
    if key not in _ENCODERS:
        _ENCODERS[key] = encoder(*key)
    return _ENCODERS[key]


def words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, _pos, _word): the pattern's pieces, white space included. Java needs (?U) for Unicode \\s."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + PATTERN), F.lit(0))
    return df.select(*keys, F.posexplode(pieces).alias("_pos", "_word"))


def encode_words(distinct: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(_word, _n, _ids): each distinct word encoded once, without splitting it again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary, "byte_bpe_50k", r"[\s\S]+")
        for b in batches:
            yield pd.DataFrame({"_word": b["_word"], "_n": b["_n"], "_ids": [enc.encode_ordinary(w) for w in b["_word"]]})

    return distinct.mapInPandas(run, "_word string, _n long, _ids array<int>")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per id: the id and ``ids``, the tokens of its text without special tokens.

    An empty and a null text have an empty list; strings of special tokens are ordinary text.
    A repeated row counts once; an id with several texts has a row for each."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    spread = words(docs.withColumn("_h", F.xxhash64("_text")), ["_id", "_h"], "_text")
    # A row delivered k times has every position k times: only then is the list thinned.
    once = F.when(F.size("_all") == F.col("_last") + 1, F.col("_all")).otherwise(
        F.expr("filter(_all, (x, i) -> i = 0 OR get(_all, i - 1)._pos != x._pos)")
    )
    known = cut(encode_words(spread.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), vocabulary))
    total = known.agg(F.sum("_n")).first()[0] or 0
    frequent = (F.col("_n") >= HEAD_SHARE * total) & (F.length("_word") <= HEAD_LETTERS)
    head, rest = F.broadcast(known.where(frequent).select("_word", "_ids")), known.where(~frequent).select("_word", "_ids")
    placed = (
        spread.join(head, "_word").select("_id", "_h", "_pos", "_ids")
        .unionByName(spread.join(head.select("_word"), "_word", "left_anti").join(rest, "_word").select("_id", "_h", "_pos", "_ids"))
        .groupBy("_id", "_h")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_ids"))).alias("_all"), F.max("_pos").alias("_last"))
        .select("_id", once.alias("_all"))
        .select("_id", F.flatten(F.transform("_all", lambda x: x["_ids"])).alias("_ids"))
    )
    empty = F.array().cast("array<int>")
    bare = docs.where(F.coalesce(F.length("_text"), F.lit(0)) == 0).select("_id", empty.alias("_ids")).distinct()
    return placed.unionByName(bare).select(F.col("_id").alias(id_col), F.col("_ids").alias("ids"))


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(_token, _piece): the id-to-piece table; its size is that of the vocabulary, 50,256 rows."""
    rows = [(i, bytearray(b)) for b, i in ranks(vocabulary).items()]
    return spark.createDataFrame(rows, "_token int, _piece binary")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) by a join with the id-to-piece table, which is broadcast as its size is fixed.
    A null or empty list decodes to the empty text; bytes that are no UTF-8 become U+FFFD."""
    table = F.broadcast(pieces(df.sparkSession, vocabulary))
    spread = df.select(F.col(id_col).alias("_id"), F.posexplode(F.col(ids_col)).alias("_pos", "_token"))
    joined = (
        spread.join(table, "_token", "left")
        .groupBy("_id")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", F.hex("_piece").alias("_hex")))).alias("_all"))
        .select("_id", F.make_valid_utf8(F.unhex(F.array_join(F.transform("_all", lambda x: x["_hex"]), "")).cast("string")).alias("_text"))
    )
    bare = df.where(F.coalesce(F.size(ids_col), F.lit(0)) < 1).select(F.col(id_col).alias("_id"), F.lit("").alias("_text"))
    return joined.unionByName(bare).select(F.col("_id").alias(id_col), F.col("_text").alias("text"))


def count_tokens(text_col: str, vocabulary: str = VOCABULARY):
    """Column: number of tokens of a text, 0 for null and empty."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(vocabulary)
        for batch in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in batch], dtype="int32")

    return count(F.col(text_col))
