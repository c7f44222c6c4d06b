"""Replays of caches whose state depends on the order of all earlier reads; the state is the cache."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from cairnstore.operators.folds import fold

FIFO_CHUNKS = 16


def fifo(reads: DataFrame, size: int = FIFO_CHUNKS) -> DataFrame:
    """(reader, seq, chunk, hit) of a first-in-first-out cache per reader: a hit doesn't move an entry."""

    def step(held: OrderedDict, chunk: int) -> tuple:
        hit = chunk in held
        if not hit:
            held[chunk] = None
            if len(held) > size:
                held.popitem(last=False)
        return (hit,)

    return fold(reads, "reader", ["seq", "chunk"], ["chunk"], OrderedDict, step, "hit boolean").select("reader", "seq", "chunk", "hit")


def lru(reads: DataFrame, budget: int) -> DataFrame:
    """(reader, seq, chunk, hit, evicted) of a least-recently-used cache by bytes; the newest entry always stays."""

    def step(cache: dict, chunk: int, size: int) -> tuple:
        held, out = cache["held"], 0
        hit = chunk in held
        if hit:
            held.move_to_end(chunk)
        else:
            held[chunk] = size
            cache["filled"] += size
            while cache["filled"] > budget and len(held) > 1:
                cache["filled"] -= held.popitem(last=False)[1]
                out += 1
        return hit, out

    start = lambda: {"held": OrderedDict(), "filled": 0}
    return fold(reads, "reader", ["seq", "chunk"], ["chunk", "size"], start, step, "hit boolean, evicted long").select("reader", "seq", "chunk", "hit", "evicted")
