"""Threshold-scaled document sketches: every shingle hash below a fixed fraction is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.text import SHINGLE, Words, distinct, slices

FRACTION = 8  # one in eight
BITS = 40  # of a shingle's hash; ten hexadecimal digits
SPAN = 512  # ids of one bucket, when neighbours in the order of doc_id are looked up


def sketches(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted kept hashes of each document; its smallest hash, if none is below the threshold."""
    w = Words(data, offs)
    gram, doc, _ = w.grams(k)
    gram = gram >> np.uint64(64 - BITS)
    values, bounds = distinct(gram, doc, w.docs)
    limit = np.uint64((1 << BITS) // FRACTION)
    out = []
    for d in range(w.docs):
        own = values[bounds[d] : bounds[d + 1]]
        n = int(np.searchsorted(own, limit))
        out.append(own[: max(n, 1)])
    return out


def to_string(sketch: np.ndarray) -> str:
    return "".join(f"{x:010x}" for x in sketch.tolist())


def from_string(text: str) -> np.ndarray:
    return np.array([int(text[i : i + 10], 16) for i in range(0, len(text), 10)], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of kept hashes in common; 1 for two empty sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's kept hashes that b has too; 1 if a is empty.  Sound for very unequal sizes, as both keep the same fraction."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents together."""
    return np.union1d(a, b)


def with_sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and ``sketch``, the kept hashes as little-endian 64-bit words."""

    def apply(batches):
        for b in batches:
            out = [s.astype("<u8").tobytes() for _, data, offs in slices(b.column(1)) for s in sketches(data, offs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "text", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(apply, "doc_id long, text string, sketch binary")


def lower_neighbour(keys: DataFrame, few: int = 50_000) -> DataFrame:
    """key, below: the next smaller key (null for the smallest).  ``keys`` holds distinct values of ``key``.

    More than ``few`` keys are ordered within buckets, and the buckets' largest keys by the same rule.
    """
    if keys.count() <= few:
        return keys.select("key", F.lag("key").over(Window.orderBy("key")).alias("below"))
    bucket = F.floor(F.col("key") / SPAN)
    tops = keys.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("top"))
    under = lower_neighbour(tops.select(F.col("bucket").alias("key")), few).select(F.col("key").alias("bucket"), F.col("below").alias("lower"))
    first = under.join(tops.select(F.col("bucket").alias("lower"), "top"), "lower", "left").select("bucket", "top")
    inside = keys.withColumn("bucket", bucket).withColumn("below", F.lag("key").over(Window.partitionBy("bucket").orderBy("key")))
    return inside.join(first, "bucket", "left").select("key", F.coalesce("below", "top").alias("below"))


def compare_edited(docs: DataFrame, head_limit: int = 1_000_000) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness of neighbours.

    The next document is that of the next smaller doc_id, and of the largest after the last;
    rows of equal doc_id follow each other by text, rows without doc_id come last.  One document
    alone is its own next.  Null and wordless texts have the empty fingerprint.

    Texts are shuffled once, by ranges of doc_id; the first text of each range, which the range
    above needs, is found by a broadcast of the ranges' largest ids while those are
    ``head_limit`` at most, by a join beyond.
    """
    none = -(1 << 53)
    bucket = F.coalesce(F.floor(F.col("doc_id") / SPAN), F.lit(none)).cast("long")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    tops = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top"))
    n = tops.count()
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ids_of_tops = F.broadcast(tops) if n <= head_limit else tops
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids_of_tops, F.col("doc_id").eqNullSafe(F.col("top")) & (bucket == F.col("bucket")))
    first = with_sketch(first.groupBy("bucket").agg(F.first("top").alias("doc_id"), F.min("text").alias("text")))
    first = first.select(bucket.alias("lower"), F.col("text").alias("first_text"), F.col("sketch").alias("first_sketch"))
    below = lower_neighbour(tops.select(F.col("bucket").alias("key")))
    largest = tops.agg(F.max("bucket").alias("most"))
    below = below.crossJoin(F.broadcast(largest)).select(F.col("key").alias("bucket"), F.coalesce("below", "most").alias("lower"))
    after = below.join(first, "lower").drop("lower")

    own = Window.partitionBy("bucket").orderBy(*order)
    rows = with_sketch(docs).withColumn("bucket", bucket)
    rows = rows.withColumn("next_text", F.lead("text").over(own)).withColumn("next_sketch", F.lead("sketch").over(own))
    rows = rows.join(after, "bucket", "left")
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    tail = F.substring(F.coalesce("next_text", "first_text"), F.lit(1), half)
    rows = rows.select(
        "doc_id",
        chars.cast("long").alias("n_chars"),
        F.when(half > 0, F.concat(F.substring("text", F.lit(1), chars - half), tail)).otherwise(F.col("text")).alias("edited"),
        "sketch",
        F.coalesce("next_sketch", "first_sketch").alias("next_sketch"),
    )

    def apply(batches):
        for b in batches:
            edited = [s for _, data, offs in slices(b.column(2)) for s in sketches(data, offs)]
            mine = [np.frombuffer(x, "<u8") for x in b.column(3).to_pylist()]
            later = [np.frombuffer(x, "<u8") for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    b.column(5),
                    pa.array([to_string(s) for s in mine], pa.string()),
                    pa.array([to_string(s) for s in edited], pa.string()),
                    pa.array(list(map(likeness, mine, edited)), pa.float64()),
                    pa.array(list(map(likeness, mine, later)), pa.float64()),
                    pa.array(list(map(containment, mine, later)), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_next"],
            )

    return rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).mapInArrow(
        apply, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double"
    )
