"""Groups of documents whose shingles' Jaccard similarity reaches a bound, by fingerprints and exact comparison.

Two documents are linked if the sets of their shingles' hashes have a Jaccard similarity of ``similarity``
or more; a group is what links reach.  Fingerprints only propose pairs, and every pair is compared exactly.

At a similarity of 0.8 SimHash fingerprints differ in about 10 of 64 bits, often in 16, where tables that
reach so far no longer select.  So two kinds of fingerprints propose pairs: SimHash within its 4 bits, and
``BANDS`` MinHash fingerprints of ``ROWS`` minima, of which two documents share each with probability
similarity ** ROWS.  At 0.8 all 40 miss a pair with probability (1 - 0.8 ** 5) ** 40 = 1.2e-7.

Work is on distinct sets of shingles.  Of the documents that share a band, pairs are left out whose sketches
(a byte of each of the 200 minima) agree in fewer than ``AGREE`` places; at 0.8 they agree in 160 with a
deviation of 5.7.  A tree of the closest sketches is compared first in some of the bands, which joins a large group of copies by
as many pairs as it has documents in each.  Then, in all bands, documents that are still in different groups are
compared where they meet, by their shingles; only links come out of that, not pairs.

Defined results: texts without words are copies of each other; a text of any length is hashed whole; of equal
doc_ids the first row stays; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm import simhash
from cairnstore.llm.common import connected_components, discard, lean, numbered, own_names_apart, release, staged, text_or_empty, without_rows

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, AGREE = 40, 5, 125
#: Documents of a band that one tree joins.
TREE = 1024
#: Bands whose trees are compared first; what these leave apart meets in all bands.
TREES = 8
#: Pairs that are compared together.
PAIRS = 10_000
#: Contents of a band beyond which it is dealt out in blocks.
BLOCK = 4096
_DRAWN = np.random.default_rng(20240602).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _FACTOR = _DRAWN[0] * np.uint64(2), _DRAWN[1] * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the hash functions' values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(low, ((shingles[a : a + 1024] ^ _FLIP) * _FACTOR).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketch(low: np.ndarray) -> bytes:
    return (low >> np.uint64(20)).astype(np.uint8).tobytes()


def closest(sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """The edges of a spanning tree of the sketches that agree most, without those that agree too little."""
    left, best, parent = np.arange(1, len(sketches)), np.zeros(len(sketches), np.int64), np.zeros(len(sketches), np.int64)
    one = 0
    while len(left):
        agree = (sketches[left] == sketches[one]).sum(axis=1)
        better = agree > best[left]
        best[left[better]], parent[left[better]] = agree[better], one
        at = int(best[left].argmax())
        one = int(left[at])
        left = np.delete(left, at)
        if best[one] >= AGREE:
            yield int(parent[one]), one


def _trees(contents: np.ndarray, roots: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(contents), TREE):
        some = np.append(0, np.arange(max(a, 1), min(a + TREE, len(contents))))
        x, y = np.array(list(closest(sketches[some])), np.int64).reshape(-1, 2).T
        yield contents[some[x]], contents[some[y]]


def _across(similarity: float):
    def links(contents: np.ndarray, roots: np.ndarray, sketches: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between contents of different groups, each pair compared in the first band that it shares."""
        roots = roots.copy()
        parts = sketches.reshape(-1, BANDS, ROWS)
        for n in range(len(contents) - 1):
            other = n + 1 + np.flatnonzero(roots[n + 1 :] != roots[n])
            if len(other):
                other = other[(sketches[other] == sketches[n]).sum(axis=1) >= AGREE]
            if len(other):
                other = other[(parts[other] == parts[n]).all(axis=2).argmax(axis=1) == bands[n]]
            for x in other.tolist():
                if roots[x] != roots[n] and alike(sets[n], sets[x], similarity):
                    roots[roots == roots[x]] = roots[n]
                    yield contents[n : n + 1], contents[x : x + 1]

    return links


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """content and its distinct shingles' hashes, sorted, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(simhash.shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.binary())], names=["content", "shingles"])

    return texts.select("content", "text").mapInArrow(lean(run), "content long, shingles binary")


def _blocks(crossing: DataFrame) -> DataFrame:
    """A key with very many contents becomes one for every two blocks of them, so that no task holds an unbounded group."""
    sizes = crossing.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = crossing.join(sizes, "key")
    own = F.pmod(F.xxhash64("content"), F.col("_blocks"))
    parts = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.least(own, other) * F.col("_blocks") + F.greatest(own, other))
    return dealt.withColumn("_part", F.explode(parts)).withColumn("key", F.xxhash64("key", "_part")).drop("_blocks", "_part")


def _proposed(buckets: DataFrame, propose) -> DataFrame:
    """Pairs (a, b) of ``propose`` for the rows (content, root, sketch; band and shingles, if they are there) of each key."""
    compares = "shingles" in buckets.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            keys, contents, roots = (table.column(n).to_numpy() for n in ("key", "content", "root"))
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            columns = [contents, roots, sketches]
            if compares:
                columns += [table.column("band").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]]
            found = [p for a, b in zip([0, *ends], ends) if b > a + 1 for p in propose(*(c[a:b] for c in columns))]
            x, y = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in found)]) for k in (0, 1))
            a, b = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if held and held[-1].column("key")[0].as_py() != keys[-1]:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, b long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets (sorted, distinct) is ``similarity`` or more."""
    if min(len(a), len(b)) / max(len(a), len(b), 1) < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, _cs_row, content (hash of the set of shingles), fp, bands (none without words) and sketch of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, fps, every, sketches = [], [], [], []
            for text in batch.column("_cs_text"):
                hashes = simhash.shingle_hashes(text.as_py(), words)
                distinct = np.unique(hashes)
                contents.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                fps.append(simhash.majority(hashes))
                low = minima(distinct)
                every.append(bands(low) if len(distinct) else [])
                sketches.append(sketch(low))
            arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (contents, fps)]
            arrays = [batch.column("doc_id"), batch.column("_cs_row"), *arrays, pa.array(every, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_cs_row", "content", "fp", "bands", "sketch"])

    picked = rows.select(F.col("doc_id").cast("long"), "_cs_row", text_or_empty().alias("_cs_text"))
    return picked.mapInArrow(lean(run), "doc_id long, _cs_row long, content long, fp long, bands array<long>, sketch binary")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike; ``texts`` has content and text.

    Pairs are dealt into a square of blocks by both of their contents, as many as make about ``PAIRS`` pairs a
    block.  A block gets each text that it needs once, before its pairs, and holds the texts' shingles: where
    many pairs are among few texts, as in a large group, a text goes to a row and a column of blocks.
    """
    side = max(8, ceil(sqrt(pairs.count() / PAIRS)))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = pairs.select((slot("a") * side + slot("b")).alias("block"), "a", "b")
    needed = dealt.select("block", F.explode(F.array("a", "b")).alias("content")).distinct()
    first = needed.join(texts, "content").select("block", F.lit(0).alias("kind"), F.col("content").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = first.unionByName(dealt.select("block", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            found = []
            for block, kind, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "a", "b", "text"))):
                if block != last:
                    last, held = block, {}
                if not kind:
                    held[a] = np.unique(simhash.shingle_hashes(text, words))
                elif alike(held[a], held[b], similarity):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(lean(run), "a long, b long")


def _by_simhash(classes: DataFrame) -> DataFrame:
    """Pairs of contents that SimHash links."""
    lowest = classes.groupBy("fp").agg(F.min("content").alias("low"))
    equal = classes.join(lowest, "fp").select(F.col("low").alias("a"), F.col("content").alias("b"))
    edges = simhash.link(lowest.select("fp")).distinct()
    edges = edges.join(lowest.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(lowest.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    return equal.unionByName(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@own_names_apart
def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the first of their group: one of each group of near copies.

    First is the smallest doc_id and, among rows with one doc_id, the smallest row number.
    A row with a null doc_id is kept, since it can't be told apart from
    others.  Texts without words are copies of each other.  The bands are made for a ``similarity`` of 0.8 or more.
    """
    rows = numbered(docs, "_cs_row")
    marked = staged(_marked(rows, words), "marked")
    classes = marked.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.min("_cs_row").alias("_cs_row"))
    classes = staged(classes.join(marked.select("_cs_row", "fp", "bands", "sketch"), "_cs_row"), "classes")
    release(docs.sparkSession)

    entries = classes.select("content", F.posexplode("bands").alias("band", "key"))
    shared = entries.select("band", "key", "content", F.expr("count(1) OVER (PARTITION BY key)").alias("n")).where("n > 1").drop("n")
    buckets = stored = staged(shared, "buckets")
    release(docs.sparkSession)
    sketches = classes.select("content", "sketch")
    some = buckets.where(F.col("band") < TREES)
    trees = _proposed(some.drop("band").withColumn("root", F.lit(0).cast("long")).join(sketches, "content"), _trees)
    first = staged(_pairs(trees.unionByName(_by_simhash(classes.select("content", "fp")))), "pairs")

    place = classes.select("content", "_cs_row")

    def alike_of(pairs: DataFrame) -> DataFrame:
        wanted = place.join(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), "content")
        texts = staged(wanted.join(rows.select("_cs_row", text_or_empty().alias("text")), "_cs_row").select("content", "text"), "texts")
        release(docs.sparkSession)
        out = staged(_compared(pairs, texts, words, similarity), "alike")
        discard(texts)
        release(docs.sparkSession)
        return out

    edges = alike_of(first)
    roots = staged(connected_components(edges), "roots")
    apart = buckets.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    several = apart.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    crossing = staged(apart.join(several, "key", "left_semi"), "crossing")
    wanted = place.join(crossing.select("content").distinct(), "content")
    sets = staged(_sets(wanted.join(rows.select("_cs_row", text_or_empty().alias("text")), "_cs_row"), words), "sets")
    release(docs.sparkSession)
    compared = _blocks(crossing).join(sketches.join(sets, "content"), "content")
    more = staged(_proposed(compared, _across(similarity)).distinct(), "alike")

    final = connected_components(edges.unionByName(more)).withColumnRenamed("node", "content")
    rooted = classes.select("content", "first_id").join(final, "content", "left").withColumn("root", F.coalesce("root", "content"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("doc_id"))
    groups = rooted.join(smallest, "root").select("content", "doc_id")
    heads = marked.join(groups, ["content", "doc_id"]).groupBy("content", "doc_id").agg(F.min("_cs_row").alias("_cs_row"))
    heads = heads.join(rooted.select("content", "root"), "content").groupBy("root").agg(F.min("_cs_row").alias("_cs_row"))
    stay = heads.select("_cs_row").unionByName(marked.where("doc_id IS NULL").select("_cs_row"))
    gone = staged(marked.select("_cs_row").join(stay, "_cs_row", "left_anti"), "gone")
    discard(marked, classes, stored, first, edges, roots, crossing, sets, more)
    return without_rows(rows, gone, "_cs_row").select(*docs.columns)
