"""Packing documents into fixed-capacity sequences: cost-balanced packing.

A piece of n tokens costs n + n^2 / capacity: a linear part and the quadratic
part of attention within the piece. Pieces are taken in descending size and
each goes to the cheapest of the sequences that it would fill up (but for a
share ``spare``), or, if there are none, to the cheapest sequence that has room;
as many sequences are open from the start as the tokens need at least, and
another is opened only where none has room. The sequences that this leaves
underfilled give their pieces back, which then go where the room is tightest,
if fewer sequences do that way. Documents above the capacity fill whole sequences and
leave one remainder, which is packed like any piece; nothing else is divided.

Documents are dealt by hash into blocks of about ``block`` documents, packed
independently: a block leaves at most a few sequences underfilled, so the loss
by blocks is in the order of sequences / block. A block is one task however
the documents are distributed, and its size doesn't grow with the input.

Defined results: null and empty texts have 0 tokens and get a container like
any other document; repeated rows are packed as often as they come; capacities
that are null or not positive are left out; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokens import encoder
from textloom.scratch import written


def default_vocabulary() -> str:
    """The public byte-level vocabulary that the queries size texts with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, *keep)``: sizes in tokens of the vocabulary file, which each worker loads once."""
    path = vocabulary or default_vocabulary()
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    rows = documents.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = encoder(path)
        for b in batches:
            sizes = size([t or "" for t in b["text"]])
            yield b.drop(columns="text").assign(n_tokens=np.asarray(sizes, np.int64))

    kinds = "".join(f", {c} {fields[c]}" for c in keep)
    return rows.mapInPandas(count, f"doc_id {fields[id_col]}{kinds}, n_tokens bigint")


def pack(sizes: list[int], capacity: int, spare: float = 0.0, underfilled: float = 0.9) -> list[int]:
    """The sequence of each piece (sizes descending, none above the capacity)."""
    count = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    room, cost = [capacity] * count, [0.0] * count
    # By cost, those with room for the piece at hand; and by room, for the pieces that fill one up. Entries whose room has changed are passed over.
    ready = [(0.0, i, capacity) for i in range(count)]
    by_room: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, i) for i in range(count)]}
    waiting: dict[int, list[tuple[float, int, int]]] = {}
    out, last, slack = [], capacity, int(spare * capacity)
    for s in sizes:
        # Sequences that had no room for the larger pieces may have room now.
        for r in range(last - 1, s - 1, -1):
            for item in waiting.pop(r, ()):
                heapq.heappush(ready, item)
        last, best = min(last, s), None
        for r in range(s, min(s + slack, capacity) + 1):
            same = by_room.get(r, ())
            while same and room[same[0][1]] != r:
                heapq.heappop(same)
            if same and (best is None or same[0] < best):
                best = same[0]
        while best is None and ready:
            c, i, r = heapq.heappop(ready)
            if room[i] == r:
                best = (c, i)
        if best is None:
            best = (0.0, len(room))
            room.append(capacity)
            cost.append(0.0)
        i = best[1]
        out.append(i)
        cost[i] += s + s * s / capacity
        room[i] -= s
        heapq.heappush(by_room.setdefault(room[i], []), (cost[i], i))
        item = (cost[i], i, room[i])
        if room[i] >= s:
            heapq.heappush(ready, item)
        else:
            waiting.setdefault(room[i], []).append(item)
    return _closed(sizes, out, room, capacity, underfilled)


def _closed(sizes: list[int], where: list[int], room: list[int], capacity: int, underfilled: float) -> list[int]:
    """The closing pass: pieces of sequences below the share ``underfilled``, in descending size, to the tightest room."""
    low = {i for i, r in enumerate(room) if capacity - r < underfilled * capacity}
    rooms = sorted((r, i) for i, r in enumerate(room) if i not in low and r)
    free, out, used = sorted(low, reverse=True), list(where), 0
    for k, (s, i) in enumerate(zip(sizes, where)):
        if i not in low:
            continue
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            r, j = rooms.pop(at)
        elif free:
            r, j, used = capacity, free.pop(), used + 1
        else:
            return where
        out[k] = j
        insort(rooms, (r - s, j))
    return out if used < len(set(where) & low) else where


PACKED = "container_name string, doc_id bigint, piece_no int, container_id string, n_tokens bigint"


def packed(documents: DataFrame, sizes: DataFrame, vocabulary: str | None = None, block: int = 10_000) -> DataFrame:
    """``(container_name, doc_id, piece_no, container_id, n_tokens)``: the container of every document.

    ``sizes``: container_name, capacity_tokens. ``container_id`` is unique
    within a container name.
    """
    counted = written(token_counts(documents, vocabulary), "pack-tokens")
    blocks = max(1, -(-counted.count() // block))
    kinds = sizes.where("container_name is not null and capacity_tokens > 0").distinct()
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).join(F.broadcast(kinds), F.lit(True))  # a fixed table of a few sizes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, cap, at = pdf["container_name"].iloc[0], int(pdf["capacity_tokens"].iloc[0]), int(pdf["block"].iloc[0])
        doc, n = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
        full = np.where(n > cap, n // cap, 0)
        rest = n - full * cap
        left = (rest > 0) | (n == 0)
        order = np.lexsort((doc[left], -rest[left]))
        ids, pieces, sizes_ = doc[left][order], full[left][order], rest[left][order]
        where = pack(sizes_.tolist(), cap)
        whole = np.repeat(np.arange(len(doc)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        return pd.DataFrame(
            {
                "container_name": name,
                "doc_id": np.r_[ids, doc[whole]],
                "piece_no": np.r_[pieces, piece].astype(np.int32),
                "container_id": [f"{at}-{i}" for i in where] + [f"{at}-full-{i}" for i in range(len(whole))],
                "n_tokens": np.r_[sizes_, np.full(len(whole), cap)].astype(np.int64),
            }
        )

    return dealt.groupBy("container_name", "block").applyInPandas(run, PACKED)


def packing_report(packed_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(container_name, capacity_tokens, containers, documents, divided, tokens, fill_share, underfilled)``."""
    per = packed_rows.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    used = per.join(F.broadcast(sizes), "container_name").groupBy("container_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum((F.col("t") < 0.9 * F.col("capacity_tokens")).cast("int")).alias("underfilled")
    )
    docs = packed_rows.groupBy("container_name", "doc_id").agg(F.max("piece_no").alias("p")).groupBy("container_name").agg(
        F.count("*").alias("documents"), F.sum((F.col("p") > 0).cast("int")).alias("divided")
    )
    return used.join(docs, "container_name").select(
        "container_name",
        "capacity_tokens",
        "containers",
        "documents",
        "divided",
        "tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill_share"),
        "underfilled",
    )
