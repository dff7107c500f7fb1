"""Toxicity: cumulative-link ordinal regression on sparse word and word-start features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import Words, between, distinct, slices

STARTS = (4, 5)


def sparse(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """64-bit feature keys and their documents: each word, and the first 4 and 5 bytes of longer ones."""
    words = Words(data, offs)
    doc = words.doc_of_word()
    keys, docs = [words.hash], [doc]
    for n in STARTS:
        longer = words.end - words.start > n
        at = words.start[longer]
        keys.append(between(words.prefix, at, at + n) ^ np.uint64(n))
        docs.append(doc[longer])
    return np.concatenate(keys), np.concatenate(docs), words


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(weight . x - threshold[k]); one weight vector for all thresholds."""

    keys: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of known features: document, feature, count."""
        keys, doc, words = sparse(data, offs)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        pair, n = np.unique(doc[known] * max(len(self.keys), 1) + at[known], return_counts=True)
        return pair // max(len(self.keys), 1), pair % max(len(self.keys), 1), n

    def above(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - total[:, None], -40, 40)))

    def severity(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade > 0)."""
        doc, feature, n = self.counts(data, offs)
        above = self.above(np.bincount(doc, self.weight[feature] * np.log1p(n) if len(doc) else None, len(offs) - 1))
        return above.sum(1), above[:, 0]


def fit(keys: list[np.ndarray], toxic: np.ndarray, grades: int = 4, rounds: int = 400) -> OrdinalModel:
    """Selects features, grades the toxic rows, and fits weights and ordered thresholds.

    Features: all keys present in four toxic rows at least and far likelier there than elsewhere.
    Grades: 0 for rows that aren't toxic; toxic rows are graded 1.. by quantiles of how many such
    features they hold.  Without rows of both kinds nothing is selected and every text has the
    severity that the thresholds alone give, 0 nearly.
    """
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.linspace(4.0, 6.0, grades - 1))
    if not toxic.any() or toxic.all():
        return none
    bad, n_bad = np.unique(np.concatenate([np.unique(k) for k, t in zip(keys, toxic, strict=True) if t]), return_counts=True)
    bad, n_bad = bad[n_bad >= 4], n_bad[n_bad >= 4]
    if not len(bad):
        return none
    n_good = np.zeros(len(bad))
    for k, t in zip(keys, toxic, strict=True):
        if not t:
            own = np.unique(k)
            at = np.minimum(np.searchsorted(bad, own), len(bad) - 1)
            n_good[at[bad[at] == own]] += 1
    odds = np.log((n_bad + 0.5) / toxic.sum()) - np.log((n_good + 0.5) / (~toxic).sum())
    chosen = np.flatnonzero(odds > 3.5)
    if not len(chosen):
        return none
    known = bad[chosen]
    rows, cols, vals = [], [], []
    for i, k in enumerate(keys):
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        f, n = np.unique(at[known[at] == k], return_counts=True)
        rows.append(np.full(len(f), i))
        cols.append(f)
        vals.append(np.log1p(n))
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    held = np.bincount(row, val, len(keys))
    marks = np.quantile(held[toxic], np.arange(1, grades - 1) / (grades - 1))
    y = np.where(toxic, 1 + np.searchsorted(marks, held, "left"), 0)
    w, cuts = np.full(len(known), 0.5), np.linspace(0.5, 3, grades - 1)
    m, v = np.zeros(len(w) + len(cuts)), np.zeros(len(w) + len(cuts))
    over = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    for t in range(1, rounds + 1):
        total = np.bincount(row, w[col] * val, len(keys))
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - total[:, None], -40, 40)))
        e = (p - over) * share[:, None]
        g = np.concatenate([np.bincount(col, e.sum(1)[row] * val, len(w)) + 1e-4 * w, -e.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w = np.maximum(w - step[: len(w)], 0)  # every chosen feature speaks for severity
        cuts = np.maximum.accumulate(cuts - step[len(w) :])
    cuts[0] = max(cuts[0], 0.3)  # a text without any known feature is never toxic
    return OrdinalModel(known, w, np.maximum.accumulate(cuts))


def train(docs: DataFrame, labels: DataFrame, limit: int = 6000, grades: int = 4) -> OrdinalModel:
    """Fits on at most ``limit`` labelled rows (half toxic where there are as many), picked by hash of doc_id.

    Null labels are not read.  The picked ids are bounded by ``limit``, hence broadcast.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit // 2) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")

    def measure(batches):
        for b in batches:
            for row, data, offs in slices(b.column(2)):
                n = len(offs) - 1
                keys, doc, _ = sparse(data, offs)
                order = np.argsort(doc, kind="stable")
                flat, cut = distinct(keys[order], doc[order], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n).cast(pa.int32()), pa.array([flat[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())], ["id", "y", "f"])

    got = rows.mapInArrow(measure, "id long, y int, f binary").collect()
    got.sort(key=lambda r: (r.id, bytes(r.f)))
    return fit([np.frombuffer(bytes(r.f), np.uint64) for r in got], np.array([r.y == 1 for r in got], bool), grades)


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, expected severity, the nearest grade, and whether grade 0 is unlikely.

    Null and empty texts hold no feature and are never toxic.  Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            parts = [np.stack(shared.value.severity(data, offs)) for _, data, offs in slices(b.column(1))]
            both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[0]), pa.array(both[1])], ["doc_id", "s", "p"])

    got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, s double, p double")
    return got.select("doc_id", F.col("s").alias("expected_severity"), F.round("s").cast("int").alias("grade"), (F.col("p") >= cut).alias("toxic"))
