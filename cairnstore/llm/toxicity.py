"""Toxicity: a classifier chain.

The categories are predicted one after the other by linear models over words and their stems; each later model also
gets the probabilities of the earlier ones.  In training these are out-of-fold predictions, so that a
later model sees earlier probabilities of the quality that it will see on new texts.

The table of labels has one mark, ``toxic``.  The categories before it in the chain are read off the
labelled texts: a toxic text is ``abusive`` if it holds a word that marks toxic texts, ``repeated`` if
it holds two or more of these words or uses one twice.  The words are found among the training rows
by their log-odds, from counts of distinct texts; no word list is built in.

It is fitted on the driver on at most ``SAMPLE`` labelled rows, those with the smallest hashes of
doc_id.  Only words that occur in ``LEAST`` sampled texts and in as many as ``LEAST_SHARE`` of the toxic ones, near
copies counted once, are features, by name, not hashed, so an unseen word can't stand in for a seen one.  Scoring reads every whole text.

Defined results: a null text is scored as an empty one; repeated rows are scored each; a text of any length
is scored whole; without labels of both kinds every probability is the share of toxic rows; rows without a
doc_id are scored and not learned from; of steepest gradients that tie, the first word's step is taken; an
empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import discard, staged, text_or_empty

CATEGORIES = ("abusive", "repeated", "toxic")
SAMPLE, LEAST, FOLDS, STEPS, THRESHOLD = 6000, 8, 3, 150, 0.5
KEPT, LEAST_SLOPE, NAMES, LEAST_SHARE = 4000, 0.004, 8, 0.05
STEMS = (4, 5, 6)
_OTHER = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words(text: str) -> Counter:
    """Words and, marked by a trailing hyphen, the stems that inflected forms share: four, five and six bytes."""
    plain = Counter(text.encode("utf-8", "surrogatepass").translate(_OTHER).lower().split())
    out = Counter(plain)
    for w, n in plain.items():
        for size in STEMS:
            if len(w) > size:
                out[w[:size] + b"-"] += n
    return out


class Linear:
    """Logistic regression on rows of a sparse matrix and some dense columns."""

    def __init__(self, base: float, n: int, dense: int):
        self.w0, self.w, self.d = base, np.zeros(n), np.zeros(dense)

    def margins(self, ids, begin, dense):
        sparse = np.add.reduceat(np.append(self.w[ids], 0.0), np.minimum(begin, len(ids))) if len(ids) else np.zeros(len(begin))
        empty = np.diff(np.append(begin, len(ids))) == 0
        return self.w0 + np.where(empty, 0.0, sparse) + dense @ self.d

    def fit(self, ids, begin, dense, y, share):
        """Coordinate-wise Newton steps, each on the feature with the steepest gradient.

        So the weights stay few: a word that marks many texts comes before words that some near
        copies happen to share, and these have nothing left to explain.
        """
        sizes = np.diff(np.append(begin, len(ids)))
        row = np.repeat(np.arange(len(begin)), sizes)
        weight = share * np.where(y > 0, 0.5 / max(1, (share * y).sum()), 0.5 / max(1, (share * (1 - y)).sum()))
        steepest = np.abs(np.bincount(ids, ((0.5 - y) * weight)[row], len(self.w)))
        keep = np.zeros(len(self.w), bool)
        keep[np.argsort(-steepest, kind="stable")[:KEPT]] = True
        ids, row = ids[keep[ids]], row[keep[ids]]
        order = np.argsort(ids, kind="stable")
        rows_of, first = row[order], np.searchsorted(ids[order], np.arange(len(self.w) + 1))
        margin = np.zeros(len(y))
        for _ in range(STEPS):
            p = _sigmoid(margin)
            step = -((p - y) * weight).sum() / ((p * (1 - p) * weight).sum() + 0.02)
            self.w0, margin = self.w0 + step, margin + step
            for k in range(dense.shape[1]):
                p, x = _sigmoid(margin), dense[:, k]
                step = float(np.clip(-((p - y) * weight) @ x / ((p * (1 - p) * weight) @ (x * x) + 0.02), -1, 1))
                self.d[k] += step
                margin = margin + step * x
            p = _sigmoid(margin)
            slope = np.bincount(ids, ((p - y) * weight)[row], len(self.w))
            j = int(np.argmax(np.abs(slope)))
            if abs(slope[j]) < LEAST_SLOPE:
                break
            some = rows_of[first[j] : first[j + 1]]
            step = float(np.clip(-slope[j] / ((p * (1 - p) * weight)[some].sum() + 0.01), -2, 2))
            self.w[j] += step
            margin[some] += step
        return self


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain:
    def __init__(self, share: float):
        self.vocabulary: dict[bytes, int] = {}
        self.share, self.models = share, []

    def matrix(self, counts: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocabulary.get
        rows = [sorted(i for i in map(get, c) if i is not None) for c in counts]
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.array([i for r in rows for i in r], np.int64), np.cumsum(sizes) - sizes

    def fit(self, vocabulary: list[bytes], ids: np.ndarray, count: np.ndarray, sizes: np.ndarray, groups: np.ndarray, toxic: np.ndarray) -> None:
        """Fit on texts that are given as flat arrays: each text's words, as places in ``vocabulary``, and how often they occur.

        Texts of one group, near copies, weigh as one, and are in one fold: a text's out-of-fold prediction
        comes from a model that has seen none of its near copies.
        """
        groups = np.unique(groups, return_inverse=True)[1]
        weight = 1 / np.bincount(groups)[groups]
        fold = groups % FOLDS
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((ids, row))
        ids, row, count = ids[order], row[order], count[order]
        begin = np.cumsum(sizes) - sizes
        marks = marking_words(ids, row, len(vocabulary), toxic * weight, (1 - toxic) * weight)
        hits = np.bincount(row, marks[ids] * count, len(sizes))
        labels = np.stack([toxic * (hits > 0), toxic * (hits > 1), toxic], axis=1)
        earlier = np.zeros((len(sizes), 0))
        for k in range(len(CATEGORIES)):
            y, out = labels[:, k], np.empty(len(sizes))
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = Linear(0.0, len(self.vocabulary), k).fit(*_pick(ids, begin, sizes, train), earlier[train], y[train], weight[train])
                out[test] = _sigmoid(model.margins(*_pick(ids, begin, sizes, test), earlier[test]))
            self.models.append(Linear(0.0, len(self.vocabulary), k).fit(ids, begin, earlier, y, weight))
            earlier = np.column_stack([earlier, out])

    def probabilities(self, counts: list[Counter]) -> np.ndarray:
        if not self.models or not counts:
            return np.full((len(counts), len(CATEGORIES)), self.share)
        ids, begin = self.matrix(counts)
        out = np.zeros((len(counts), 0))
        for model in self.models:
            out = np.column_stack([out, _sigmoid(model.margins(ids, begin, out))])
        return out


def _pick(ids, begin, sizes, rows):
    n = sizes[rows]
    start = np.cumsum(n) - n
    return ids[np.repeat(begin[rows] - start, n) + np.arange(n.sum())], start


def copies(counts: Counter) -> list[int]:
    """Names that a text shares with its near copies: the smallest checksums of its longer words; without these, of all."""
    plain = [w for w in counts if w[-1:] != b"-"]
    names = heapq.nsmallest(NAMES, (zlib.crc32(w) for w in plain if len(w) > 5))
    return names if len(names) > 1 else [zlib.crc32(b" ".join(sorted(plain))), -1]


def near_groups(names: list[list[int]]) -> list[int]:
    """A number for each text: texts that share two names, directly or by way of others, have one."""
    root = list(range(len(names)))

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    first: dict[tuple[int, int], int] = {}
    for n, own in enumerate(names):
        for pair in combinations(sorted(own), 2):
            a, b = sorted((top(first.setdefault(pair, n)), top(n)))
            root[b] = a
    return [top(n) for n in range(len(names))]


def marking_words(ids: np.ndarray, row: np.ndarray, n_words: int, inside: np.ndarray, outside: np.ndarray, odds: float = 3.0) -> np.ndarray:
    """Whether each word's log-odds in toxic texts are high; near copies weigh as one text."""
    a, b = np.bincount(ids, inside[row], n_words), np.bincount(ids, outside[row], n_words)
    n, m = inside.sum() + 1, outside.sum() + 1
    return (a >= LEAST) & (np.log((a + 0.5) / n) - np.log((b + 0.5) / m) >= odds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit on the ``sample`` labelled rows with the smallest hashes of doc_id; of rows with one doc_id, on the smallest text.

    The words that enough of the sample's texts hold are found in the cluster; the driver gets these and, for
    each text, their numbers.
    """
    usable = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py()) for t in batch.column("_cs_text")]
            near = pa.array([copies(c) for c in found], pa.list_(pa.int64()))
            columns = [pa.array([list(c.keys()) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), near, *columns], names=["doc_id", "label", "near", "words", "counts"])

    # The sample's rows are bounded by ``sample``, so this side may be broadcast.
    picked = docs.select("doc_id", text_or_empty().alias("_cs_text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("_cs_text").alias("_cs_text"))
    read = staged(picked.mapInArrow(run, "doc_id long, label int, near array<long>, words array<binary>, counts array<int>"), "sample")
    known = read.select("doc_id", "label", "near").toArrow().sort_by("doc_id")
    group = near_groups(known["near"].to_pylist())
    grouped = docs.sparkSession.createDataFrame(list(zip(known["doc_id"].to_pylist(), group)), "doc_id long, near long")
    each = read.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(grouped), "doc_id")
    toxic = len({g for g, label in zip(group, known["label"].to_pylist()) if label})
    least = max(LEAST, int(LEAST_SHARE * toxic))
    common = each.select("near", "word").distinct().groupBy("word").count().where(F.col("count") >= least)
    vocabulary = sorted(bytes(r["word"]) for r in common.select("word").collect())
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for some, times in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                known = [(number[w], n) for w, n in zip(some, times) if w in number]
                ids.append([i for i, _ in known])
                counts.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label")), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "label", "ids", "counts"])

    rows = read.mapInArrow(numbers, "doc_id long, label int, ids array<int>, counts array<int>").toArrow().combine_chunks().sort_by("doc_id")
    discard(read)
    y = rows["label"].to_numpy().astype(np.float64)
    chain = Chain((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        flat = lambda c: pc.list_flatten(rows[c]).to_numpy().astype(np.int64)
        chain.fit(vocabulary, flat("ids"), flat("counts"), pc.list_value_length(rows["ids"]).to_numpy().astype(np.int64), np.array(group), y)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category and ``toxic``, whether the last is at the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_cs_text")
            for a in range(0, len(texts), 256):
                p = chain.probabilities([words(t.as_py()) for t in texts.slice(a, 256)])
                columns = [batch.column("doc_id").slice(a, 256), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array((p[:, -1] >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic int"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_cs_text")).mapInArrow(run, schema)
