"""Byte-pair merges over a word-frequency table, and encoding with public vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOT = 50256


def pair_counts(words: DataFrame) -> DataFrame:
    """``(left, right, n)`` of adjacent symbols, for ``words`` (pieces array, n)."""
    p = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.struct(F.element_at("pieces", i).alias("left"), F.element_at("pieces", i + 1).alias("right")))
    return words.where(F.size("pieces") > 1).select(F.explode(p).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def merged(pieces: Column, left: str, right: str) -> Column:
    """The pieces with each (left, right), taken from the left, joined into one."""
    start = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        hit = (F.size(a) > 0) & (F.get(a, F.size(a) - 1) == left) & (x == right)
        return F.when(hit, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.lit(left + right)))).otherwise(F.concat(a, F.array(x)))

    # A joined piece never takes part again: left + right differs from left.
    return F.aggregate(pieces, start, step)


def learn_merges(words: DataFrame, rounds: int) -> list[tuple[str, str, int]]:
    """The first merges, the most frequent pair each round, ties by (left, right).

    The word table is an aggregate of the corpus and stays distributed; a round
    is one aggregate over it and brings a single row to the driver.
    """
    from textloom.scratch import drop_written, written

    now, out, kept = words, [], None
    for _ in range(rounds):
        best = pair_counts(now).orderBy(F.desc("n"), "left", "right").first()
        if best is None:
            break
        out.append((best["left"], best["right"], best["n"]))
        now = written(now.withColumn("pieces", merged(F.col("pieces"), best["left"], best["right"])), "bpe")
        if kept is not None:
            drop_written(kept)
        kept = now
    return out


def vocabulary(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """``(token, id)``: the characters of the words in order, from 256 on (bytes come before), then the merges."""
    spark = words.sparkSession
    chars = sorted(r["c"] for r in words.select(F.explode("pieces").alias("c")).distinct().collect())  # an alphabet
    return spark.createDataFrame([(t, 256 + k) for k, t in enumerate([*chars, *dict.fromkeys(a + b for a, b, _ in merges)])], "token string, id bigint")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tokens)``: a separator and the ids of each text; null counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [np.array([EOT, *enc.encode_ordinary(t or "")], np.int32) for t in b["text"]]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, tokens array<int>")


def shard_pieces(tokens: DataFrame, shard_size: int) -> DataFrame:
    """``(shard, low, tokens)``: documents in order of id as one stream, cut every ``shard_size`` tokens.

    A piece is what a document has in a shard, ``low`` its place in the stream;
    a shard's pieces lie together and in order in one partition.
    """
    from textloom.operators.prefix import running_sum

    at = running_sum(tokens.withColumn("n", F.size("tokens")), [], ["doc_id"], "n", "start", name="shard-offsets")
    k = F.explode(F.sequence(F.floor(F.col("start") / shard_size), F.floor((F.col("start") + F.col("n") - 1) / shard_size))).alias("shard")
    p = at.where("n > 0").select("start", "n", "tokens", k)
    low, high = F.greatest("start", F.col("shard") * shard_size), F.least(F.col("start") + F.col("n"), (F.col("shard") + 1) * shard_size)
    piece = F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return p.select("shard", low.alias("low"), piece.alias("tokens")).repartition("shard").sortWithinPartitions("shard", "low")


def to_shards(tokens: DataFrame, shard_size: int) -> DataFrame:
    """``(shard, tokens)``: the pieces of :func:`shard_pieces` joined, a row per shard."""
    pieces = shard_pieces(tokens, shard_size).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("low", "tokens"))).alias("p"))
    return pieces.select("shard", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"))
