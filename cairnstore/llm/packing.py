"""Conflict-constrained best-fit packing.

Documents are dealt into shards of about ``SHARD`` rows by row number, and packed shard by shard, longest
first.  A bin carries a bitmap of the sources and one of the duplicate clusters that it holds, and
takes neither a second document of a source nor a second of a cluster.  Bins stand in the order of
their residual space; the search starts at the smallest residual that is large enough and goes on to
its successors until it finds the tightest bin without a conflict, else it opens a bin.

Lengths are tokens with an end token.  A longer document than a bin fills bins of its own and its
rest is packed like a document.  A cluster is the set of texts with equal words, case aside.

Defined results: a null text is an empty text (one token); a null and an empty source are one source;
repeated rows are packed each, in different bins; an empty table gives none; extra columns are not
read; a text longer than a bin fills several.  Bitmaps have a bit for each source of the shard and for
each cluster of several documents, so different sources are never taken for one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.bpe import default_tokenizer, text_lengths
from cairnstore.llm.common import lean, numbered, staged, text_or_empty

CAPACITY, SHARD = 4096, 32_768


class Bins:
    """Bins by residual space.  A residual's bins are grouped by their source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r is set if a bin has residual r
        self.bins: list[tuple[int, int, int]] = []  # residual, sources, clusters

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a document with these bits; the tightest bin without a conflict."""
        rest = self.filled >> length
        residual = length - 1
        while rest:
            step = (rest & -rest).bit_length()
            residual, rest = residual + step, rest >> step
            for sources, members in self.by_residual[residual].items():
                if sources & source:
                    continue
                for n in members:
                    if not self.bins[n][2] & cluster:
                        return n, self._put(n, length, source, cluster)
        self.bins.append((self.capacity, 0, 0))
        return len(self.bins) - 1, self._put(len(self.bins) - 1, length, source, cluster)

    def _put(self, n: int, length: int, source: int, cluster: int) -> int:
        residual, sources, clusters = self.bins[n]
        group = self.by_residual[residual]
        if n in group.get(sources, ()):
            del group[sources][n]
            if not group[sources]:
                del group[sources]
            if not group:
                self.filled &= ~(1 << residual)
        self.bins[n] = (residual - length, sources | source, clusters | cluster)
        self.by_residual[residual - length].setdefault(sources | source, {})[n] = None
        self.filled |= 1 << residual - length
        return self.capacity - residual


def pack_rows(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, length) of every piece; sources are bits, clusters are any numbers."""
    seen: dict[int, int] = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bit: dict[int, int] = {}
    for c in clusters:  # a cluster with one document can't conflict and needs no bit
        if seen[c] > 1 and c not in bit:
            bit[c] = 1 << len(bit)
    bins, out = Bins(capacity), []
    for row in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        whole, rest = divmod(lengths[row], capacity)
        for piece in range(whole):
            n, at = bins.place(capacity, sources[row], bit.get(clusters[row], 0))
            out.append((row, piece, n, at, capacity))
        if rest:
            n, at = bins.place(rest, sources[row], bit.get(clusters[row], 0))
            out.append((row, whole, n, at, rest))
    return out


def source_bits(sources: Iterable[str]) -> list[int]:
    """A bit of its own for each source, however many there are."""
    bits: dict[str, int] = {}
    return [1 << bits.setdefault(s, len(bits)) for s in sources]


def measured(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, uid, source, cluster and length of each row's whole text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_cs_text")
            lengths = text_lengths(texts, path) + 1
            clusters = [xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) - (1 << 63) for t in texts.to_pylist()]
            columns = [batch.column("doc_id"), batch.column("uid"), batch.column("source"), pa.array(clusters, pa.int64()), pa.array(lengths)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "source", "cluster", "length"])

    picked = numbered(docs).select(F.col("doc_id").cast("long"), "uid", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_or_empty().alias("_cs_text"))
    return picked.mapInArrow(lean(run), "doc_id long, uid long, source string, cluster long, length long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, bin_id, bin_offset and piece_tokens of every piece of every row."""
    rows = staged(measured(docs, tokenizer), "lengths")
    shards = max(1, -(-rows.count() // shard))

    def run(frame: pd.DataFrame) -> pd.DataFrame:  # noqa: F821
        import pandas as pd

        frame = frame.sort_values(["doc_id", "uid"], ignore_index=True)
        found = pack_rows(frame["length"].tolist(), source_bits(frame["source"]), frame["cluster"].tolist(), capacity)
        row, piece, number, offset, length = np.array(found, np.int64).T
        return pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64").iloc[row].array, "piece": piece, "bin_id": (int(frame["shard"].iloc[0]) << 32) + number, "bin_offset": offset, "piece_tokens": length,
            "source": frame["source"].iloc[row].array, "cluster": frame["cluster"].iloc[row].array,
        })

    # xxhash64 spreads the row numbers, so shards have nearly the same size whatever the partitions.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, bin_id long, bin_offset long, piece_tokens long, source string, cluster long")
