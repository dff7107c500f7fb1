"""Benchmark decontamination by greedy string tiling over running Karp-Rabin seeds."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import SHINGLE, Words, lean, slices

BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Seeds:
    """One block of benchmark items: word hashes, and every seed's items and places."""

    item: np.ndarray
    words: list[np.ndarray]
    gram: np.ndarray
    gram_item: np.ndarray
    gram_at: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str], k: int) -> Seeds:
        own, gram, doc, at = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, data, offs in slices(pa.array(texts, pa.string())):
            w = Words(data, offs)
            own += [w.hash[w.first[i] : w.first[i + 1]] for i in range(w.docs)]
            g, d, p = w.grams(k)
            gram.append(g)
            doc.append(d + row)
            at.append(p)
        g, d, p = map(np.concatenate, (gram, doc, at))
        order = np.argsort(g, kind="stable")
        return Seeds(np.array(ids, np.int64), own, g[order], d[order], p[order])


def tile(doc: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first, none overlapping in either.

    ``pairs`` are the seeds' places.  A match that lost words to a longer tile is cut and tried
    again with what is left, if that is ``k`` words at least.
    """
    diagonals: dict[int, list[int]] = {}
    for p, q in pairs:
        diagonals.setdefault(p - q, []).append(p)
    heap = []
    for d, at in diagonals.items():
        at.sort()
        start = last = at[0]
        for p in [*at[1:], None]:
            if p is None or p > last + 1:
                heap.append((-(last + k - start), start, start - d))
                start = p
            last = p
    heapq.heapify(heap)
    used_doc, used_item = set(), np.zeros(len(item), bool)
    tiles = []
    while heap:
        size, p, q = heapq.heappop(heap)
        free = [not used_item[q + i] and p + i not in used_doc for i in range(-size)]
        if all(free):
            if not np.array_equal(doc[p : p - size], item[q : q - size]):
                continue
            tiles.append((p, q, -size))
            used_item[q : q - size] = True
            used_doc.update(range(p, p - size))
            continue
        run = 0
        for i, ok in enumerate([*free, False]):
            if ok:
                run += 1
            else:
                if run >= k:
                    heapq.heappush(heap, (-run, p + i - run, q + i - run))
                run = 0
    return tiles


def covered(seeds: Seeds, data: np.ndarray, offs: np.ndarray, k: int) -> dict[int, list[tuple[int, float, int, int]]]:
    """For each document with seeds: (item, share of the item's words in tiles, longest tile, tiles).

    A text of fewer than ``k`` words is one seed, so it meets only texts of the very same words.
    """
    if not len(seeds.gram):
        return {}
    w = Words(data, offs)
    gram, doc, at = w.grams(k)
    low = np.searchsorted(seeds.gram, gram)
    hit = np.flatnonzero(seeds.gram[np.minimum(low, len(seeds.gram) - 1)] == gram)
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    high = np.searchsorted(seeds.gram, gram[hit], "right")
    for h, end in zip(hit.tolist(), high.tolist(), strict=True):
        for j in range(int(low[h]), end):
            pairs.setdefault((int(doc[h]), int(seeds.gram_item[j])), []).append((int(at[h]), int(seeds.gram_at[j])))
    out: dict[int, list[tuple[int, float, int, int]]] = {}
    for (d, i), own in pairs.items():
        tiles = tile(w.hash[w.first[d] : w.first[d + 1]], seeds.words[i], own, min(k, len(seeds.words[i])))
        if tiles:
            out.setdefault(d, []).append((i, sum(t[2] for t in tiles) / len(seeds.words[i]), max(t[2] for t in tiles), len(tiles)))
    return out


def blocks(benchmark: DataFrame, k: int, block_bytes: int = BLOCK_BYTES):
    """The benchmark as broadcast blocks of about ``block_bytes`` of text: a set of any size is worked off block by block."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        rows = sorted(own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Seeds.of([-1 if r.item_id is None else r.item_id for r in rows], [r.text for r in rows], k))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, k: int = SHINGLE) -> DataFrame:
    """One row for each contaminated document: doc_id, item_id (best covered), coverage, longest_tile, n_tiles, n_items, contaminated (true).

    A document is contaminated if tiles of ``k`` words or more cover ``threshold`` of an item's
    words; so moved passages count.  An item of fewer than ``k`` words is found where it is a
    document's whole text: within other text so few words say nothing.  Nulls and texts without
    words match nothing.  Of equally covered items the smallest id is named.  Repeated documents
    give repeated rows.
    """
    schema = "doc_id long, item_id long, coverage double, longest_tile int, n_tiles int, n_items int"
    found = None
    for block in blocks(benchmark, k):

        def search(batches, block=block):
            seeds = block.value
            for b in batches:
                rows = []
                for row, data, offs in slices(b.column(1)):
                    for d, items in covered(seeds, data, offs, k).items():
                        good = [(c, -int(seeds.item[i]), t, n) for i, c, t, n in items if c >= threshold]
                        if good:
                            c, i, t, n = max(good)
                            rows.append((b.column(0)[row + d].as_py(), -i, c, t, n, len(good)))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], schema.replace(",", "").split()[::2])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        found = (part, 1) if found is None else (found[0].unionByName(part), found[1] + 1)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema + ", contaminated boolean")
    out, n = found
    if n > 1:
        out = out.groupBy("doc_id").agg(F.max(F.struct("coverage", -F.col("item_id"), "longest_tile", "n_tiles")).alias("b"), F.sum("n_items").cast("int").alias("n_items"))
        out = out.select("doc_id", (-F.col("b.col2")).alias("item_id"), "b.coverage", "b.longest_tile", "b.n_tiles", "n_items")
    return out.withColumn("contaminated", F.lit(True))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, k: int = SHINGLE) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay.  No row is shuffled."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, k):

        def keep(batches, block=block):
            for b in batches:
                mask = np.ones(b.num_rows, bool)
                for row, data, offs in slices(b.column(at)):
                    for d, items in covered(block.value, data, offs, k).items():
                        mask[row + d] = all(c < threshold for _, c, _, _ in items)
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(lean(keep), docs.schema)
    return docs
