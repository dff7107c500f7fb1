"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import stage
from symloom.llm.text import Words, lean, slices

BLOCK = 4096  # documents of one flight
MOST = 3  # times a document or a source may be taken
WEIGHTS = (1, 2, 3)
SMALL = 1e-9
LANDING = 24  # units of a source kept for its landing


def shares(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that share sum(sizes) by weight, each ``most`` times its own size at most.

    What is above a cap goes to the others by weight, again and again, until none is above.
    """
    total, cap = float(sum(sizes)), [most * float(s) for s in sizes]
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        full = [i for i in sorted(free) if left * weights[i] / weight > cap[i]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = cap[i]
        left -= sum(cap[i] for i in full)
        free -= set(full)
    return target


def flight(size: list[float], p: list[float], rng: np.random.Generator, land: bool, reserve: bool = False) -> None:
    """Moves the inclusion probabilities ``p`` to 0 or 1, in place, keeping sum(p) and sum(p * size).

    Three fractional units at a time go along the one direction in the null space of both
    constraints; two units or fewer are left.  ``land``: units of ``LANDING`` evenly spaced
    ranks stay out of the flight, and with what it leaves they are chosen so that their sizes
    come as near as a greedy choice can to what they should add.  ``reserve`` only keeps them
    out, for a later landing.
    """
    wait: list[int] = []
    apart = set(range(0, len(p), max(1, len(p) // LANDING))) if land or reserve else set()
    draws = rng.random(3 * len(p) + 8).tolist()
    at = 0

    def move(units: list[int], u: list[float]) -> None:
        nonlocal at
        up = down = float("inf")
        for i, d in zip(units, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for i, d in zip(units, u, strict=True):
            p[i] += step * d
            if p[i] < SMALL:
                p[i] = 0.0
            elif p[i] > 1 - SMALL:
                p[i] = 1.0

    def settle() -> None:
        wait[:] = [i for i in wait if 0 < p[i] < 1]

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            p[i] = float(p[i] >= 0.5)
            continue
        if i in apart:
            continue
        wait.append(i)
        while len(wait) >= 2:
            a, b = wait[0], wait[1]
            if size[a] == size[b]:
                move([a, b], [1.0, -1.0])
            elif len(wait) == 3 and size[wait[2]] in (size[a], size[b]):
                c = wait[2]
                move([c, a if size[c] == size[a] else b], [1.0, -1.0])
            elif len(wait) == 3:
                x, y, z = (size[j] for j in wait)
                scale = max(abs(y - z), abs(z - x), abs(x - y))
                move(wait[:3], [(y - z) / scale, (z - x) / scale, (x - y) / scale])
            else:
                break
            settle()
    if land:
        rest = sorted((i for i in range(len(p)) if 0 < p[i] < 1), key=lambda i: (-size[i], i))
        lacking = sum(p[i] * size[i] for i in rest)
        for i in rest:
            p[i] = float(size[i] <= lacking)
            lacking -= p[i] * size[i]
        for i in rest:  # one more change, if it brings the sum nearer
            gain = size[i] if p[i] else -size[i]
            if abs(lacking + gain) < abs(lacking):
                p[i], lacking = 1 - p[i], lacking + gain


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the whole text (null: 0)."""

    def apply(batches):
        for b in batches:
            n = [Words(data, offs, hashed=False).count for _, data, offs in slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(lean(apply), "doc_id long, source string, size long")


def targets(sizes: DataFrame) -> tuple[list[tuple], str]:
    """Rows (source, source_size, target, whole, part, blocks); one row for each source is brought to the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    words = [int(r.words or 0) for r in rows]
    goal = shares(words, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    out = []
    for r, n, t in zip(rows, words, goal, strict=True):
        rate = min(t / n, MOST) if n else 0.0
        whole = int(rate + SMALL)
        part = rate - whole
        out.append((r.source, n, t, whole, part if part > SMALL else 0.0, max(1, -(-int(r.docs) // BLOCK))))
    return out, "g_source string, source_size long, target double, whole int, part double, blocks long"


def flyer(level: int, wanted: list[str]):
    """The flight of one block of a source; a source's only block lands."""

    def fly(key, t):
        source, block = key[0].as_py(), key[1].as_py()
        size, ids = t.column("size").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy()
        order = np.lexsort((t.column("part").to_numpy(), ids, size))
        p = t.column("part").to_numpy()[order].tolist()
        name = [] if source is None else list(source.encode())
        flight(size[order].tolist(), p, np.random.default_rng([level, block, *name]), t.column("blocks")[0].as_py() == 1, level == block == 0)
        part = np.empty(len(p))
        part[order] = p
        return t.select(wanted).set_column(wanted.index("part"), "part", pa.array(part))

    return fly


def mix(docs: DataFrame, few: int = 10_000) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, source.

    A source's rate (target over size) is taken as whole copies of each document and, for the
    fraction, by the cube method: blocks of documents, dealt by hash of doc_id, fly on their
    own; what is left of them, two of each, meets in fewer blocks, until one block of each
    source lands.  Draws depend on source, level and block alone.  Null text has size 0, null
    source is a source (the last), repeated rows are units of their own.  A table of sources is
    broadcast while it has ``few`` rows at most.
    """
    spark = docs.sparkSession
    sizes = stage(sized(docs))
    rows, schema = targets(sizes)
    table = spark.createDataFrame(rows, schema)
    joined = sizes.join(F.broadcast(table) if len(rows) <= few else table, F.col("source").eqNullSafe(F.col("g_source")), "inner").drop("g_source")
    kept = "doc_id long, source string, size long, source_size long, target double, whole int, part double, blocks long"
    wanted = [c.split()[0] for c in kept.split(", ")]
    done, waiting, level = [], joined.select(wanted), 0
    most = max([r[-1] for r in rows], default=1)
    while True:
        flown = waiting.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(level)), F.col("blocks")))

        flown = flown.groupBy("source", "block").applyInArrow(lean(flyer(level, wanted)), kept)
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        if most == 1:
            done.append(flown)
            break
        flown = stage(flown)
        done.append(flown.where(~open_))
        waiting = flown.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 3 / BLOCK))
        most, level = -(-most * 3 // BLOCK), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.round("part").cast("int")) * F.col("size")).alias("taken"), "source")
