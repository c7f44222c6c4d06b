"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in three segments of 21, 21 and 22 bits.  Two fingerprints that differ in
four bits or fewer differ in at most one bit in one of the first two segments, or not at all in the
third: else the segments would hold 2 + 2 + 1 = 5 differing bits.  So each fingerprint is stored in
the segments' tables under its own values, and looks up, in the first two, the Hamming ball of
radius one around its value: its own and those in which one bit is set that it has clear (the other
half of the ball is looked up from the other side).  What meets in a table entry is compared over
all 64 bits.

Work is on distinct fingerprints; copies only add to a count.  An entry's fingerprints are linked by
a search that compares each only with those that aren't linked yet, and gives one edge per linked
fingerprint, never all pairs.  An entry with more than ``BLOCK`` stored fingerprints is dealt out in
blocks, and every two blocks meet in a task of their own.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like
any other; repeated rows give repeated rows; a bit that is set in exactly half of the hashes is 0; a text
of any length is hashed whole; a null doc_id never names a component; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cairnstore.llm.common import connected_components, discard, lean, numbered, own_names_apart, staged, text_or_empty

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: (first bit, number of bits, radius of the ball)
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Stored fingerprints of a table entry beyond which it is dealt out in blocks.
BLOCK = 2048
_PLACES = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """The hash of each run of ``words`` words, in order; of all words if there are no more; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not parts:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    return np.array([hashed(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _PLACES)[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, keys: list[str], words: int = SHINGLE) -> DataFrame:
    """``keys`` and fp (the fingerprint's bits as a long) of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column("_cs_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(values)], names=[*keys, "fp"])

    picked = docs.select(*keys, text_or_empty().alias("_cs_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return picked.mapInArrow(run, f"{schema}, fp long")


def _value(first: int, bits: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _entries(distinct: DataFrame) -> DataFrame:
    """fp, key, stored: a row for each table entry that a fingerprint is stored in or looks up."""
    keys = [_segment_entries(n, *segment) for n, segment in enumerate(SEGMENTS)]
    return distinct.select("fp", F.inline(F.flatten(F.array(*keys))))


def _segment_entries(n: int, first: int, bits: int, radius: int) -> Column:
    value, table = _value(first, bits), F.lit(n << 32).cast("long")
    own = F.array(F.struct((value + table).alias("key"), F.lit(True).alias("stored")))
    if not radius:
        return own
    clear = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]), lambda f: value.bitwiseAND(f) == 0)
    return F.concat(own, F.transform(clear, lambda f: F.struct((value + f + table).alias("key"), F.lit(False).alias("stored"))))


def _blocks(entries: DataFrame, block: int) -> DataFrame:
    """Adds ``part``: 0, or for an entry that is too large the two blocks that meet."""
    large = entries.where("stored").groupBy("key").count().where(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / block).cast("long").alias("_cs_blocks"))
    dealt = entries.join(large, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_cs_blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_cs_blocks") - 1),
        lambda other: F.least(own, other) * F.col("_cs_blocks") + F.greatest(own, other),
    )
    parts = F.when(F.col("_cs_blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)
    return dealt.select("fp", "key", "stored", F.explode(parts).alias("part"))


def linked(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among ``fps``: each linked fingerprint with the one it was reached from."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[one]) <= max_bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), fps[one]))
                b.append(fps[found])
                frontier += found.tolist()
                left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linker(max_bits: int):
    """For rows sorted by (key, part): the edges within each group."""

    def edges(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]))
        sizes = np.diff(np.append(begins, len(keys)))
        useful = (sizes > 1) & (np.add.reduceat(stored.astype(np.int64), begins) > 0)
        a, b = [], []
        small = useful & (sizes <= 8)
        group = np.repeat(np.arange(len(begins)), sizes)
        keep = small[group]
        f, g = fps[keep], group[keep]
        for step in range(1, 8):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            x, y = f[step:][same], f[:-step][same]
            near = np.bitwise_count(x ^ y) <= max_bits
            a.append(x[near])
            b.append(y[near])
        for at, n in zip(begins[useful & ~small].tolist(), sizes[useful & ~small].tolist()):
            x, y = linked(np.unique(fps[at : at + n]), max_bits)
            a.append(x)
            b.append(y)
        join = lambda x: np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (
                batch.column("key").to_numpy(), batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64),
                batch.column("stored").to_numpy(zero_copy_only=False),
            )
            held.append(now)
            if now[0][0] == now[0][-1] and now[1][0] == now[1][-1]:
                continue  # the last group may go on
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = np.flatnonzero((columns[0] != now[0][-1]) | (columns[1] != now[1][-1]))[-1] + 1
            yield edges(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    return run


def link(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the fingerprints ``fp`` of ``distinct`` which differ in few bits."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the tables find up to {MAX_BITS} differing bits")
    entries = _blocks(_entries(distinct), block)
    return entries.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(_linker(max_bits)), "a long, b long")


def components(marked: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``marked`` (doc_id, fp, ...) with component_id, the smallest doc_id that links reach."""
    classes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("_cs_first")), "classes")
    roots = connected_components(link(classes.select("fp"), max_bits, block))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("_cs_first").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    discard(classes)
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    marked = staged(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], words), "fingerprints")
    found = components(marked, max_bits, block)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@own_names_apart
def keep_first(docs: DataFrame, words: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: one of each group of near copies.

    First is the smallest doc_id and, among rows with one doc_id, the smallest row number.
    A row with a null doc_id is kept, since it can't be told apart from others.
    """
    rows = numbered(docs, "_cs_row")
    marked = staged(fingerprints(rows.select("doc_id", "_cs_row", "text"), ["doc_id", "_cs_row"], words), "fingerprints")
    found = components(marked, max_bits)
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("_cs_row").alias("_cs_row"))
    stay = first.select("_cs_row").unionByName(marked.where("doc_id IS NULL").select("_cs_row"))
    return rows.join(stay, "_cs_row", "left_semi").select(*docs.columns)
