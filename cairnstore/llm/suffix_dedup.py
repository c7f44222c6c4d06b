"""Repeated passages, byte for byte, over a whole corpus.

A byte is repeated if a string of ``length`` bytes that covers it also starts somewhere else, in
another document or in the same one.  In a suffix array, equal strings of that length are neighbours:
a position's longest previous factor, which follows from the next smaller position before it in
suffix order, is ``length`` or more exactly if its string starts earlier too.  ``keep="first"`` removes
what those later copies cover and keeps the first; ``keep="none"`` also looks at the next position in
suffix order and removes every copy.

A suffix array of the corpus doesn't fit anywhere, so it is built in parts, and only where it matters:

1. Each position's string is filed under the smallest hash of its ``gram``-byte substrings.  Equal
   strings have equal files, so a file with a single occurrence holds no repeats, and most files do.
   Positions next to each other mostly share a file; such a run is one row.
2. Runs whose whole context is equal (128 bits of hash) settle each other by counting; copies of documents
   and passages cost one row a run, not a row a byte, and one of them stands for all.
3. What is left (the representatives of files with several contexts) is dealt by file, in as many tasks as
   its size needs.  There the suffixes of the contexts are put in the order of their bytes, by prefix
   doubling up to ``length``, equal strings by position.  A string's previous smaller position then stands
   right before it if its longest previous factor reaches ``length``, and its next one right behind.
4. A file with very many contexts (a passage or a group of near copies in a large share of the corpus)
   would not fit in a task: its strings are dealt by a 64-bit fingerprint, several ways, and ordered by it.

Defined results: a null text is an empty text (and stays null in :func:`remove`); documents shorter
than ``length`` are left alone; repeated rows remove each other's bytes, or the later ones; "first" is
the smallest doc_id (null before all), then the row's place in the table, then the place in the text;
extra columns are not read, or kept as they are by :func:`remove`; an empty table gives none.

With ``unit="words"`` ``length`` and ``gram`` count words, and positions are words.  A word is what stands
between ASCII white space, without the ASCII punctuation around it (unless it has nothing else).  Strings are
still equal from the first byte of their first word to the last of their last: a text is the words and the gaps
between them in turn, so ``length`` words are 2 * length - 1 symbols.  A symbol is told by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import discard, lean, numbered, own_names_apart, release, staged

LENGTH, GRAM = 400, 96
#: In words.
PASSAGE, PASSAGE_GRAM = 51, 12
SEGMENT = 1 << 18
#: Contexts in a file beyond which it is dealt by string, one way for every ``DEAL`` times as many.
HOT, DEAL = 256, 16
#: Positions: in a file beyond which it is dealt by string, and (about) in a task.  Bytes that are put in order together.
LARGE, TASK, PART = 1 << 21, 1 << 22, 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return np.cumprod(np.full(n, _BASE, _U)), np.cumprod(np.full(n, inverse, _U))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_bounds(data: bytes) -> np.ndarray:
    """The first byte of each word and the one after its last, in two rows."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    core = np.flatnonzero(inside[1:-1] & ~_MARK[raw])  # bytes that aren't punctuation
    if not len(core) or not len(first):
        return np.array([first, end])
    after = np.searchsorted(core, first)  # each word's first such byte, if it has one
    before = np.searchsorted(core, end) - 1
    some = before >= after
    return np.array([np.where(some, core[np.minimum(after, len(core) - 1)], first), np.where(some, core[before] + 1, end)])


def symbols(data: bytes, unit: str) -> np.ndarray:
    """A number for each byte, or for each word and each gap between two words in turn."""
    raw = _TABLE[np.frombuffer(data, np.uint8)]
    if unit == "bytes":
        return raw
    cuts = word_bounds(data).T.ravel()
    if not len(cuts):
        return np.empty(0, _U)
    out = []
    for a in range(0, len(cuts) - 1, SEGMENT // 8):
        some = cuts[a : a + SEGMENT // 8 + 1]
        own = Segment(raw[some[0] : some[-1]], 1, 1, int(some[-1] - some[0]))
        out.append(own.spans(some[:-1] - some[0], some[1:] - some[0]) | _U(1))
    return np.concatenate(out)


class Segment:
    """Hashes of all substrings of up to a segment of symbols; ``step`` symbols make a position."""

    def __init__(self, data: np.ndarray, length: int, step: int, most: int = 0):
        self.step = step
        self.up, down = _powers(max(step * (SEGMENT + length), 1 << most.bit_length()))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(data * down[: len(data)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        size = self.step * (size - 1) + 1
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.up[:n])[:: self.step]

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.step * a, self.step * (b - 1) + 1
        return _mix((self.sums[b] - self.sums[a]) * self.up[np.minimum(a, len(self.up) - 1)] + (b - a).astype(_U) * _U(0x94D049BB133111EB))


def _segments(data: bytes, length: int, unit: str) -> Iterator[tuple[int, Segment]]:
    """(first position, hashes) of the overlapping segments of a text; none if it is shorter than ``length``."""
    raw, step = symbols(data, unit), 2 if unit == "words" else 1
    for at in range(0, (len(raw) + step - 1) // step - length + 1, SEGMENT):
        yield at, Segment(raw[step * at : step * (at + SEGMENT + length - 2) + 1], length, step)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM, unit: str = "bytes") -> Iterator[tuple[np.ndarray, ...]]:
    """(start, number of positions, file, context's hash, whether the file's substring recurs in it) of the runs."""
    width = length - gram + 1
    for at, segment in _segments(data, length, unit):
        grams = segment.windows(gram)
        files = sliding_minimum(grams, width)
        first = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]]))
        sizes = np.diff(np.append(first, len(files)))
        recurs = np.zeros(len(first), bool)
        ordered = np.sort(grams)
        if (ordered[1:] == ordered[:-1]).any():
            for n, (a, size) in enumerate(zip(first.tolist(), sizes.tolist())):
                recurs[n] = np.count_nonzero(grams[a : a + size + width - 1] == files[a]) > 1
        yield first + at, sizes, files[first], segment.spans(first, first + sizes + length - 1), recurs


def fingerprints(data: bytes, length: int = LENGTH, unit: str = "bytes") -> np.ndarray:
    """The fingerprint of the string at each position."""
    parts = [segment.windows(length) for _, segment in _segments(data, length, unit)]
    return np.concatenate(parts) if parts else np.empty(0, _U)


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs).select("uid", F.col("doc_id").cast("long").alias("doc_id"), "text")


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _runs_table(docs: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "start", "size", "file", "context", "recurs"]
        for batch in batches:
            uids, ids = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()
            for a in range(0, len(uids), 256):
                columns: list[list] = [[] for _ in range(5)]
                owners: list[int] = []
                for n in range(a, min(a + 256, len(uids))):
                    for found in runs(_bytes(batch.column("text")[n]), length, gram, unit):
                        owners += [n] * len(found[0])
                        for column, values in zip(columns, found):
                            column.append(values)
                if owners:
                    start, size, file, context, recurs = map(np.concatenate, columns)
                    arrays = [pa.array([uids[n] for n in owners], pa.int64()), pa.array([ids[n] for n in owners], pa.int64())]
                    arrays += [pa.array(start), pa.array(size.astype(np.int32)), pa.array(file.view(np.int64)), pa.array(context.view(np.int64)), pa.array(recurs)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(lean(run), "uid long, doc_id long, start long, size int, file long, context long, recurs boolean")


_DEALT = "file long, way int, context long, doc_id long, uid long, start long, size int, data binary, prints binary, places binary"
_DEALT_ARROW = pa.schema([
    ("file", pa.int64()), ("way", pa.int32()), ("context", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("size", pa.int32()),
    ("data", pa.binary()), ("prints", pa.binary()), ("places", pa.binary()),
])


def _dealer(length: int, unit: str):
    """The contexts that must be compared: their bytes, or those of a large file as strings' fingerprints, several ways."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for n in range(batch.num_rows):
                data, needs = _bytes(batch.column("text")[n]), batch.column("needs")[n].as_py()
                bounds = word_bounds(data) if unit == "words" else None
                prints = fingerprints(data, length, unit) if any(r["ways"] for r in needs) else None
                uid, doc_id = batch.column("uid")[n].as_py(), batch.column("doc_id")[n].as_py()
                for r in needs:
                    a, b = r["start"], r["start"] + r["size"]
                    named = (r["context"], doc_id, uid, a, r["size"])
                    if not r["ways"]:
                        piece = data[a : b + length - 1] if bounds is None else data[bounds[0, a] : bounds[1, b + length - 2]]
                        held.append((r["file"], 0, *named, piece, None, None))
                        size += len(piece)
                        continue
                    own = prints[a:b]
                    way = own % _U(r["ways"])
                    for w in np.unique(way).tolist():
                        places = np.flatnonzero(way == w)
                        held.append((r["file"], w, *named, None, own[places].tobytes(), places.astype("<u4").tobytes()))
                        size += 12 * len(places)
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _DEALT_ARROW.types)], schema=_DEALT_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _DEALT_ARROW.types)], schema=_DEALT_ARROW)

    return run


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Each place's rank in the order of the suffixes of ``text`` by their first ``length`` symbols.

    Symbols are numbers above 0 (below 2**31), in their order.  Prefixes are doubled: the order by 2k symbols
    follows from that by k, of the place and of the place k further on.
    """
    key, k = text.astype(np.int64), 1
    if length >= 7 and len(text) and text.max() < 512:  # seven symbols of nine bits make a number
        padded = np.concatenate([key, np.zeros(6, np.int64)])
        key, k = padded[: len(text)] << 54, 7
        for i in range(1, 7):
            key |= padded[i : i + len(text)] << 9 * (6 - i)
    while len(text):
        order = np.argsort(key)
        key = key[order]
        rank = np.zeros(len(order), np.int32)
        np.cumsum(key[1:] != key[:-1], out=rank[1:])
        ranks = np.empty_like(rank)
        ranks[order] = rank
        if k >= length:
            return ranks
        step = min(k, length - k)
        key = ranks.astype(np.int64) << 32
        key[: max(0, len(text) - step)] |= ranks[step:].astype(np.int64) + 1
        k += step
    return np.empty(0, np.int32)


def _text(pieces: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The pieces' symbols as one text, where each piece begins, and how many symbols make a position."""
    if unit == "bytes":
        sizes = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1, np.cumsum(sizes) - sizes, 1
    every = [symbols(p, unit) for p in pieces]
    sizes = np.array([len(x) for x in every], np.int64)
    return np.unique(np.concatenate(every), return_inverse=True)[1] + 1, np.cumsum(sizes) - sizes, 2


def _comparer(length: int, keep: str, unit: str):
    """The positions, as intervals within their contexts, whose string starts elsewhere (or earlier)."""

    def compare(rows: list[dict]) -> pa.RecordBatch:
        whole, dealt = [r for r in rows if r["data"] is not None], [r for r in rows if r["data"] is None]
        rows, ranks, places = whole + dealt, [], []
        if whole:
            text, begins, step = _text([r["data"] for r in whole], unit)
            order = suffix_ranks(text, step * (length - 1) + 1)
            for r, a in zip(whole, begins.tolist()):
                ranks.append(order[a : a + step * r["size"] : step])
                places.append(np.arange(r["size"]))
        if dealt:  # one file and way: equal strings have equal fingerprints
            least = 1 + max([int(x.max()) for x in ranks], default=0)
            prints = np.unique(np.concatenate([np.frombuffer(r["prints"], _U) for r in dealt]), return_inverse=True)[1] + least
            sizes = np.cumsum([len(r["prints"]) // 8 for r in dealt])
            ranks += np.split(prints, sizes[:-1])
            places += [np.frombuffer(r["places"], "<u4") for r in dealt]
        run = np.repeat(np.arange(len(rows)), [len(x) for x in ranks])
        rank, place = np.concatenate(ranks), np.concatenate(places).astype(np.int64)
        by = sorted(range(len(rows)), key=lambda n: (rows[n]["doc_id"] is not None, rows[n]["doc_id"] or 0, rows[n]["uid"], rows[n]["start"]))
        first = np.empty(len(rows), np.int64)
        first[by] = np.arange(len(rows))
        # The suffix order, equal strings by position: a string's previous smaller position, if its longest
        # previous factor has the length, stands right before it, its next one right behind.
        order = np.lexsort((place, first[run], rank))
        same = rank[order][1:] == rank[order][:-1]
        found = np.zeros(len(rank), bool)
        found[order[1:]] |= same
        if keep == "none":
            found[order[:-1]] |= same
        hit = np.flatnonzero(found)
        hit = hit[np.lexsort((place[hit], run[hit]))]
        r, p = run[hit], place[hit]
        a = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])) if len(hit) else np.empty(0, np.int64)
        z = np.append(a[1:], len(hit)) - 1 if len(hit) else a
        # One row a context, however many intervals.
        own = np.flatnonzero(np.concatenate([[True], r[a][1:] != r[a][:-1]])) if len(a) else a
        context = np.array([x["context"] for x in rows], np.int64)[r[a][own]]
        spans = pa.StructArray.from_arrays([pa.array(p[a].astype(np.int32)), pa.array((p[z] + 1).astype(np.int32))], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(context), pa.ListArray.from_arrays(pa.array(np.append(own, len(a)).astype(np.int32)), spans)], names=["context", "own"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                other = held and (held[-1]["file"], held[-1]["way"]) != (row["file"], row["way"])
                # Files are compared together up to a size, one that is dealt out on its own.
                if other and (size >= PART or row["data"] is None or held[-1]["data"] is None):
                    yield compare(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["data"] or row["prints"])
        if held:
            yield compare(held)

    return run


def repeated(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", hot: int = HOT, unit: str = "bytes") -> DataFrame:
    """uid and ``spans`` (array of [a, b) in units, sorted) of each row with bytes to remove."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = rows.sparkSession
    every = staged(_runs_table(rows, length, gram, unit), "runs")
    files = every.groupBy("file").agg(F.sum(F.when(F.col("recurs"), 2).otherwise(1)).alias("n")).where("n > 1").select("file")
    found = staged(every.join(files, "file"), "candidates")
    release(spark)
    contexts = found.groupBy("file", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "uid", "start")).alias("first"), F.max("size").alias("size"), F.max("recurs").alias("recurs")
    )
    contexts = staged(contexts, "contexts")
    several = contexts.groupBy("file").agg(F.count(F.lit(1)).alias("contexts"), F.sum("size").alias("positions"), F.max("recurs").alias("_r")).where("contexts > 1 OR _r")
    large = (F.col("contexts") > hot) | (F.col("positions") > LARGE)
    ways = F.when(large, F.ceil(F.greatest(F.col("contexts") / (DEAL * hot), F.col("positions") / LARGE))).otherwise(0).cast("long")
    several = staged(several.select("file", "positions", ways.alias("ways")), "files")
    # As many tasks as the strings to be compared need.
    positions = several.agg(F.sum("positions")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-positions // TASK))
    needs = contexts.join(several, "file")
    needs = needs.groupBy(F.col("first.uid").alias("uid")).agg(F.collect_list(F.struct("context", "file", "ways", F.col("first.start").alias("start"), "size")).alias("needs"))
    dealt = rows.join(needs, "uid").mapInArrow(lean(_dealer(length, unit)), _DEALT)
    compared = dealt.repartition(parts, "file", "way").sortWithinPartitions("file", "way").mapInArrow(lean(_comparer(length, keep, unit)), "context long, own array<struct<a:int,b:int>>")
    compared = staged(compared, "compared")
    release(spark)
    own = compared.groupBy("context").agg(F.flatten(F.collect_list("own")).alias("own"))
    settled = contexts.join(own, "context", "left").where("n > 1 OR own IS NOT NULL").select("file", "context", "n", "first", "own")
    placed = found.join(settled, ["file", "context"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    copy = F.col("n") > 1 if keep == "none" else (F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start"))
    spans = F.when(copy, whole).otherwise(F.coalesce("own", F.array().cast("array<struct<a:int,b:int>>")))
    spans = F.transform(spans, lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"] + (length - 1)).alias("b")))
    listed = placed.select("uid", spans.alias("spans")).where(F.size("spans") > 0).groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    listed = staged(listed, "spans")
    discard(every, found, contexts, several, compared)
    release(spark)
    return listed


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def in_bytes(data: bytes, spans: list[dict], unit: str) -> list[dict]:
    if unit == "bytes":
        return spans
    first, end = word_bounds(data)
    return [{"a": a, "b": b} for a, b in zip(first[[s["a"] for s in spans]].tolist(), end[[s["b"] - 1 for s in spans]].tolist())]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join(out) + data[at:]


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", hot: int = HOT, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, and what it holds of repeated passages.

    The passages (n_passages, n_passage_bytes) are those of ``passage`` words or more, which may be shorter
    than ``length`` bytes; they are counted by the same method and not removed.
    """
    rows = _numbered(docs)
    found = repeated(rows, length, gram, keep, hot)
    passages = repeated(rows, passage, passage_gram, keep, hot, "words").withColumnRenamed("spans", "passages")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
        for batch in batches:
            rows = []
            for text, spans, words in zip(batch.column("text"), batch.column("spans"), batch.column("passages")):
                data, gone = _bytes(text), merged(spans.as_py())
                held = merged(in_bytes(data, words.as_py(), "words")) if words.is_valid else []
                rows.append((len(data), _length(gone), len(gone), sha256(without(data, gone)).hexdigest(), len(held), _length(held)))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.string() if n == 3 else pa.int64()) for n, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    joined = rows.join(found.join(passages, "uid", "full"), "uid", "left").select("doc_id", "text", "spans", "passages")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def _length(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in spans)


def _to_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


@own_names_apart
def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first", unit: str = "bytes") -> DataFrame:
    """``docs`` without the repeated bytes, whole characters only; n_chars, if there, as it is then.

    """
    rows = numbered(docs, "_cs_uid")
    found = repeated(rows.select(F.col("_cs_uid").alias("uid"), F.col("doc_id").cast("long"), "text"), length, gram, keep, unit=unit).withColumnRenamed("uid", "_cs_uid").withColumnRenamed("spans", "_cs_spans")
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                if spans.as_py():
                    data = _bytes(text)
                    gone = merged(in_bytes(data, spans.as_py(), unit))
                    texts.append(without(data, [_to_characters(data, a, b) for a, b in gone]).decode("utf-8", "surrogatepass"))
                else:
                    texts.append(text.as_py())
            field = batch.schema.field(place)
            yield batch.set_column(place, field, pa.array(texts, field.type)).select(list(range(batch.num_columns - 1)))

    joined = rows.join(found, "_cs_uid", "left").select(*docs.columns, "_cs_spans")
    out = joined.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
