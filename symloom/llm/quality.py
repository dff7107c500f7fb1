"""Quality classifier: Bradley-Terry ranking on feature differences of preference pairs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import discard, stage
from symloom.llm.text import Words, distinct, lean, slices

WORD_BUCKETS = 256
PLAIN = 10
WIDTH = 256 + WORD_BUCKETS + PLAIN
ROWS = 1024  # rows of features worked on at a time
GRID = 1 << 14  # places on which the distribution of scores is held


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One dense row per document: byte shares, hashed word shares and a few shape figures.

    Everything is a share or a mean, so the length of a text alone moves little.
    """
    words = Words(data, offs)
    docs, size = words.docs, np.diff(offs)
    at = np.repeat(np.arange(docs), size)
    out = np.zeros((docs, WIDTH), np.float32)
    room = np.maximum(size, 1)[:, None]
    hist = np.bincount(at * 256 + data, minlength=docs * 256).reshape(docs, 256)
    out[:, :256] = np.sqrt(hist / room)
    doc = words.doc_of_word()
    many = np.maximum(words.count, 1)
    bucket = (words.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    out[:, 256 : 256 + WORD_BUCKETS] = np.sqrt(np.bincount(doc * WORD_BUCKETS + bucket, minlength=docs * WORD_BUCKETS).reshape(docs, -1) / many[:, None])
    length = (words.end - words.start).astype(float)
    of = lambda x: np.bincount(doc, x, docs) / many
    final = data[words.end - 1] if len(words.end) else data[:0]
    alnum = ((final >= 48) & (final <= 57)) | ((final >= 65) & (final <= 90)) | ((final >= 97) & (final <= 122)) | (final >= 128)
    initial = data[words.start] if len(words.start) else data[:0]
    different, bounds = distinct(words.hash, doc, docs)
    letters = hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1)
    out[:, 256 + WORD_BUCKETS :] = np.stack(
        [
            np.log1p(words.count),
            np.log1p(of(length)),
            of((length > 20).astype(float)),
            of((~alnum).astype(float)),
            of(((initial >= 65) & (initial <= 90)).astype(float)),
            np.diff(bounds) / many,
            hist[:, 65:91].sum(1) / np.maximum(letters, 1),
            hist[:, 48:58].sum(1) / room[:, 0],
            hist[:, 128:].sum(1) / room[:, 0],
            hist[:, 10] / many,
        ],
        axis=1,
    )
    return out


@dataclass(frozen=True)
class PairwiseModel:
    """Linear score of standardised features; ``slope`` and ``shift`` bring it to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def read(batches):
    """Features and labels of rows (y, f), ``ROWS`` at a time."""
    for b in batches:
        y = b.column(0).to_numpy()
        for i in range(0, len(y), ROWS):
            yield np.frombuffer(b"".join(b.column(1)[i : i + ROWS].to_pylist()), "<f4").reshape(-1, WIDTH), y[i : i + ROWS] == 1


def added(rows: DataFrame, size: int, add) -> np.ndarray:
    """``size`` sums over all ``rows``: each task lets ``add`` add to its own, and the driver adds up the tasks'."""

    def apply(batches):
        total = np.zeros(size)
        for x, good in read(batches):
            add(total, x, good)
        at = np.flatnonzero(total).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], ["at", "total"])

    out = np.zeros(size)
    for r in rows.mapInArrow(lean(apply), "at binary, total binary").collect():
        out[np.frombuffer(r.at, "<i4")] += np.frombuffer(r.total)
    return out


def products(rows: DataFrame, standard, share: tuple[float, float]) -> np.ndarray:
    """Sum of the outer products of all rows, each weighed by its label's ``share`` (of 0, of 1).

    A task's matrix is as large for few rows as for many, so they are added on the executors, line
    by line.  Executors use ``einsum``, as BLAS would start threads of its own in every worker.
    """

    def apply(batches):
        total = np.zeros((WIDTH, WIDTH))
        for x, good in read(batches):
            z = standard(x)
            total += np.einsum("ri,rj->ij", z * np.where(good, share[1], share[0]).astype(np.float32)[:, None], z)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array([TaskContext.get().partitionId()] * WIDTH, pa.int32()), pa.array([line.tobytes() for line in total], pa.binary())], ["line", "part", "total"])

    def line(t):
        own = [x for _, x in sorted(zip(t.column("part").to_pylist(), t.column("total").to_pylist(), strict=True))]
        return pa.table({"line": t.column("line")[:1], "total": pa.array([sum(np.frombuffer(x) for x in own).tobytes()], pa.binary())})

    out = np.zeros((WIDTH, WIDTH))
    for r in rows.mapInArrow(lean(apply), "line int, part int, total binary").groupBy("line").applyInArrow(line, "line int, total binary").collect():
        out[r.line] = np.frombuffer(r.total)
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """Of a positive definite matrix, by sweeping; LAPACK's threads hung in a driver here."""
    a = a.copy()
    for i in range(len(a)):
        row, col = a[i] / a[i, i], a[:, i].copy()
        one = 1 / a[i, i]
        a -= np.multiply.outer(col, row)
        a[i], a[:, i] = row, -col * one
        a[i, i] = one
    return a


def convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over j of a[j] * b[i - j], where the middle of ``b`` is for 0."""
    n = 4 * GRID
    return np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[GRID - 1 : 2 * GRID - 1]


def on_grid(raw: np.ndarray, end: float) -> tuple[np.ndarray, np.ndarray]:
    """Place on the grid from ``-end`` to ``end`` below each raw score, and how far it is to the next place."""
    at = np.clip((raw.astype(float) + end) / (2 * end) * (GRID - 1), 0, GRID - 1.001)
    low = at.astype(np.int64)
    return low, at - low


def fit(rows: DataFrame, cut: float = 0.3, ridge: float = 1e-3, close: float = 0.03, rounds: int = 100) -> PairwiseModel:
    """Learns from every pair (preferred, other) of ``rows`` (y, f) by logistic loss on the difference of their features.

    No pair is a row.  A linear score's loss over all pairs, and each row's part of its gradient,
    follow from how the two labels' scores are distributed; each distribution is taken from all
    rows, on ``GRID`` places between which rows are shared out.  So a round reads the rows twice:
    for the distribution, and for the gradient.  Steps are limited-memory BFGS from the curvature
    at weights 0, that of all pairs as well.  Rounds end when the next is expected to take less
    than ``close`` of the loss off; ``rounds`` is far beyond what that takes.

    The raw score's decision point is the place on the grid that splits all rows with the best
    balanced accuracy; the logistic map gives it the score ``cut``.  Without rows of both labels
    the weights are 0 and every score is the share of label 1.
    """

    def shape(total, x, good):
        total[0] += len(x)
        total[1] += np.count_nonzero(good)
        total[2 : 2 + WIDTH] += x.sum(0, dtype=float)
        total[2 + WIDTH :] += np.square(x, dtype=float).sum(0)

    seen = added(rows, 2 + 2 * WIDTH, shape)
    many, goods = int(seen[0]), int(seen[1])
    if goods in (0, many):
        share = min(max(goods / many if many else 0.5, 1e-3), 1 - 1e-3)
        return PairwiseModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 1.0, float(np.log(share / (1 - share))))
    mean = seen[2 : 2 + WIDTH] / many
    scale = np.sqrt(np.maximum(seen[2 + WIDTH :] / many - mean**2, 0)) + 1e-3
    mean4, scale4, shares = mean.astype(np.float32), scale.astype(np.float32), (1 / (many - goods), 1 / goods)

    def standard(x):
        return np.clip((x - mean4) / scale4, -6, 6)

    def means(total, x, good):
        z = standard(x)
        total[:WIDTH] += z[~good].sum(0, dtype=float)
        total[WIDTH:] += z[good].sum(0, dtype=float)

    bad_mean, good_mean = added(rows, 2 * WIDTH, means).reshape(2, WIDTH) * np.array(shares)[:, None]
    cross = np.outer(bad_mean, good_mean)
    start = inverse((products(rows, standard, shares) - cross - cross.T) / 4 + ridge * np.eye(WIDTH))

    def spread(w):
        """Where the scores of each label are: shares on the grid, and its end."""
        w4, end = w.astype(np.float32), 6 * float(np.abs(w).sum()) + 1e-6

        def count(total, x, good):
            low, part = on_grid(np.einsum("ri,i->r", standard(x), w4), end)
            low = low + np.where(good, GRID, 0)
            total += np.bincount(low, 1 - part, 2 * GRID) + np.bincount(low + 1, part, 2 * GRID)

        bad, good = added(rows, 2 * GRID, count).reshape(2, GRID) * np.array(shares)[:, None]
        return bad, good, end

    def loss(w, bad, good, end):
        apart = np.arange(1 - GRID, GRID) * (2 * end / (GRID - 1))
        return float((good * convolved(bad, np.logaddexp(0, -apart))).sum() + ridge / 2 * (w @ w))

    def slopes(w, bad, good, end):
        apart = np.arange(1 - GRID, GRID) * (2 * end / (GRID - 1))
        doubt = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
        of_bad, of_good = convolved(good, doubt[::-1]) * shares[0], -convolved(bad, doubt) * shares[1]
        w4 = w.astype(np.float32)

        def add(total, x, good):
            z = standard(x)
            low, part = on_grid(np.einsum("ri,i->r", z, w4), end)
            own = np.where(good, of_good[low] * (1 - part) + of_good[low + 1] * part, of_bad[low] * (1 - part) + of_bad[low + 1] * part)
            total += np.einsum("r,ri->i", own, z)

        return added(rows, WIDTH, add) + ridge * w

    w, steps = np.zeros(WIDTH), []
    where = np.zeros((2, GRID))
    where[:, GRID // 2] = 1
    where = (*where, 1e-6)
    now, slope = loss(w, *where), (bad_mean - good_mean) / 2
    for _ in range(rounds):
        way, parts = slope.copy(), []
        for s, g in reversed(steps):
            parts.append(s @ way / (s @ g))
            way -= parts[-1] * g
        way = np.einsum("ij,j->i", start, way)
        if steps:  # as much flatter as the last step found it
            s, g = steps[-1]
            way *= s @ g / (g @ np.einsum("ij,j->i", start, g))
        for (s, g), part in zip(steps, reversed(parts), strict=True):
            way += s * (part - g @ way / (s @ g))
        gain, length = slope @ way, 1.0
        if gain < close * now:
            break
        while length > 1e-6 and not loss(w - length * way, *(found := spread(w - length * way))) <= now - 1e-4 * length * gain:
            length /= 2
        if length <= 1e-6:
            break
        w, where, before = w - length * way, found, slope
        now, slope = loss(w, *where), slopes(w, *where)
        if (s := -length * way) @ (slope - before) > 0:
            steps.append((s, slope - before))
    bad, good, end = where
    return cut_at(PairwiseModel(mean, scale, w, 1.0, 0.0), np.stack([bad * (many - goods), good * goods]), end, cut)


def cut_at(model: PairwiseModel, counts: np.ndarray, end: float, cut: float) -> PairwiseModel:
    """``model`` with the map that gives the best place of the grid the score ``cut``; ``counts`` of rows by label and place."""
    place = np.linspace(-end, end, GRID)
    bad, good = counts
    used = np.flatnonzero(bad + good)
    balance = (np.cumsum(bad) / bad.sum() + np.cumsum(good[::-1])[::-1] / good.sum() - bad / bad.sum()) / 2
    balance = balance[used[0] : used[-1] + 1]
    best = used[0] + np.flatnonzero(balance >= balance.max() - 1e-9)
    at = (place[best[0]] + place[best[-1]]) / 2 - end / (GRID - 1)
    share = (bad + good) / counts.sum()
    slope = 4 / max(float(np.sqrt((share * (place - (share * place).sum()) ** 2).sum())), 1e-6)
    return replace(model, slope=slope, shift=float(np.log(cut / (1 - cut))) - slope * at)


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3, few: int = 1_000_000) -> PairwiseModel:
    """Fits on every labelled row of ``docs``.

    Null labels, and rows whose crc32(doc_id) mod 5 is 0 (held out), are never read.  The ids of
    the rest are broadcast while they are ``few`` at most; beyond that, texts are shuffled to
    them.  Features of these rows are written once and read again in each round of ``fit``.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    learned = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 != 0
    own = own.where(learned("_id")).groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    own = F.broadcast(own) if own.count() <= few else own
    rows = docs.select("doc_id", "text").where(learned("doc_id")).join(own, F.col("doc_id") == F.col("_id")).select("_y", "text")

    def measure(batches):
        for b in batches:
            for row, data, offs in slices(b.column(1), ROWS):
                n = len(offs) - 1
                f = np.ascontiguousarray(features(data, offs), "<f4").view(np.uint8).reshape(n, -1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), pa.array([r.tobytes() for r in f], pa.binary())], ["y", "f"])

    measured = stage(rows.mapInArrow(lean(measure), "y int, f binary"))
    try:
        return fit(measured, cut)
    finally:
        discard(measured)


def score(docs: DataFrame, model: PairwiseModel, cut: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null text is empty; empty texts get the score of an all-zero feature row.  Repeated rows
    stay, each with the same score.  A null doc_id has held_out null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            parts = [shared.value.score(features(data, offs)) for _, data, offs in slices(b.column(1), ROWS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(apply), "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: PairwiseModel, cut: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is under ``cut``; all columns stay, no row is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def apply(batches):
        for b in batches:
            parts = [shared.value.score(features(data, offs)) for _, data, offs in slices(b.column(at), ROWS)]
            yield b.filter(pa.array(np.concatenate(parts) >= cut)) if parts else b

    return docs.mapInArrow(lean(apply), docs.schema)
