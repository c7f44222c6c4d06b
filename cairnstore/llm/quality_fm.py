"""Quality classifier: a factorisation machine.

Features of a text are its distinct words, hashed, structure statistics, and metadata that follow from
the text alone (its length class).  Pairwise interactions have low rank, and a score takes time
linear in the features by the sum-of-squares identity: for each factor, half of (sum of v x)^2 minus
the sum of (v x)^2.

It is fitted on the driver on a sample of at most ``SAMPLE`` labelled rows outside the held-out fold,
those with the smallest hashes of doc_id; only feature numbers reach the driver.  Scoring reads every
whole text.  Labels, language, source and doc_id are never features.

Defined results: a null text is scored as an empty one; repeated rows are scored each; without labels
of both kinds every score is the share of label 1 (0.5 without any); a text of any length is scored whole;
rows without a doc_id are scored (as not held out) and not learned from; a score at the threshold predicts 1;
an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import text_or_empty

SAMPLE, BUCKETS, FACTORS, EPOCHS, SEED = 6000, 1 << 16, 8, 12, 11
THRESHOLD = 0.7
HELD_OUT = 2
_SYMBOLS = b"#*$%&|<>"
STATISTICS = 14


def features(text: str) -> tuple[np.ndarray, list[float]]:
    """(hashed distinct words and length class, structure statistics) of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    symbols = sum(map(raw.count, (bytes([c]) for c in _SYMBOLS)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    statistics = [
        np.log1p(n), len(seen) / max(1, n), (pairs + 1) / max(1, n), sum(map(len, words)) / max(1, n), symbols / max(1, n), raw.count(b"|") / max(1, n),
        raw.count(b"!") / max(1, n), upper / size, digits / size, (raw.count(b".") + raw.count(b",")) / max(1, n),
        max(seen.values(), default=0) / max(1, n), (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(size / max(1, len(lines))),
    ]
    ids = {zlib.crc32(w.lower()) & (BUCKETS - 1) for w in seen}
    ids.add(zlib.crc32(b"length class %d" % int(np.log2(size))) & (BUCKETS - 1))
    return np.fromiter(ids, np.int64, len(ids)), statistics


class Machine:
    """w0 + w x + pairwise interactions; ``scale`` standardises the statistics."""

    def __init__(self, base: float = 0.0):
        rng = np.random.default_rng(SEED)
        n = BUCKETS + STATISTICS
        self.w0, self.w = base, np.zeros(n, np.float32)
        self.v = (0.02 * rng.standard_normal((n, FACTORS))).astype(np.float32)
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.fitted = False

    def _flat(self, rows: list[tuple[np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fixed = np.arange(STATISTICS) + BUCKETS
        sizes = np.array([len(ids) + STATISTICS for ids, _ in rows])
        ids = np.concatenate([np.concatenate([i, fixed]) for i, _ in rows])
        dense = np.clip((np.array([s for _, s in rows]) - self.mean) / self.scale, -4, 4)
        x = np.concatenate([np.concatenate([np.full(len(i), 1 / np.sqrt(len(i))), d]) for (i, _), d in zip(rows, dense)])
        return ids, x.astype(np.float32), np.cumsum(sizes) - sizes

    def margins(self, ids: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, begin, axis=0)
        squares = np.add.reduceat(vx * vx, begin, axis=0)
        return self.w0 + np.add.reduceat(self.w[ids] * x, begin) + 0.5 * (total * total - squares).sum(axis=1), total

    def fit(self, rows: list[tuple[np.ndarray, list[float]]], labels: np.ndarray) -> None:
        dense = np.array([s for _, s in rows])
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        rng, g_w, g_v, g_0 = np.random.default_rng(SEED), np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), 64):
                some = order[a : a + 64]
                ids, x, begin = self._flat([rows[i] for i in some])
                margin, total = self.margins(ids, x, begin)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
                sizes = np.diff(np.append(begin, len(ids)))
                e = np.repeat(error, sizes).astype(np.float32) * x
                unique, place = np.unique(ids, return_inverse=True)
                d_w = np.bincount(place, e, len(unique)).astype(np.float32) + 1e-5 * self.w[unique]
                each = e[:, None] * (np.repeat(total, sizes, axis=0) - self.v[ids] * x[:, None])
                d_v = np.stack([np.bincount(place, each[:, f], len(unique)) for f in range(FACTORS)], axis=1).astype(np.float32) + 1e-4 * self.v[unique]
                g_w[unique] += d_w * d_w
                g_v[unique] += d_v * d_v
                g_0 += float(error.sum()) ** 2
                self.w[unique] -= 0.1 * d_w / np.sqrt(g_w[unique])
                self.v[unique] -= 0.03 * d_v / np.sqrt(g_v[unique])
                self.w0 -= 0.1 * float(error.sum()) / np.sqrt(g_0)
        self.fitted = True

    def scores(self, rows: list[tuple[np.ndarray, list[float]]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        margin = self.margins(*self._flat(rows))[0] if self.fitted else np.full(len(rows), self.w0)
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))


def fold(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the ``sample`` labelled rows outside the held-out fold with the smallest hashes of doc_id; of rows with one doc_id, on the smallest text."""
    usable = labels.where(F.col("quality").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("_cs_text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "ids", "statistics"])

    # The sample's rows are bounded by ``sample``, so this side may be broadcast.
    picked = docs.select("doc_id", text_or_empty().alias("_cs_text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("_cs_text").alias("_cs_text"))
    rows = picked.mapInArrow(run, "doc_id long, label int, ids array<long>, statistics array<double>").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    machine = Machine(float(np.log(share / (1 - share))))
    if 0 < y.sum() < len(y):
        machine.fit([(np.sort(np.array(r["ids"], np.int64)), r["statistics"]) for r in rows], y)
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_cs_text")
            for a in range(0, len(texts), 256):
                found = [features(t.as_py()) for t in texts.slice(a, 256)]
                scores = machine.scores([(np.sort(i), s) for i, s in found])
                columns = [batch.column("doc_id").slice(a, 256), batch.column("held_out").slice(a, 256), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long"), (fold() == HELD_OUT).alias("held_out"), text_or_empty().alias("_cs_text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
