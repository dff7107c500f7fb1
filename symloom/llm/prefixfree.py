"""Removal of long repeated byte strings by prefix-free parsing.

Parse.  A rolling hash of 16 bytes runs over each text; in every window of 192 places the
(last) smallest hash is a trigger.  The trigger of the first 192 places of a ``length``-byte
string depends on the string's bytes alone, so equal strings are cut at equal places.  Places
whose strings share a trigger form one phrase: the trigger's place, and a run of starts before
it.  No phrase is a prefix of another's occurrence, and each place belongs to exactly one.

Dictionary.  Phrases are first counted by their core, the bytes from the trigger on that all of
their strings hold.  A phrase whose core is unique in the corpus has no repeated string and goes
no further.  The rest are counted by their whole context, from the first start to the end of the
last string: equal contexts are one dictionary entry, and repeat at every start.

Suffixes.  Only entries that share a core with a different entry are opened: the suffixes of such
entries, a start and its ``length`` bytes, are sorted (by 128-bit digest) among those of the same
core, and neighbours compared; a start repeats where equal suffixes have two occurrences
together.  Equal strings have equal triggers and cores, so no order across cores is needed, and
the corpus's suffix order is never laid out as a whole.  Cores of more than ``FULL`` entries
don't meet in one task: their suffixes are counted as rows, strip by strip, where the bytes that
a strip's strings have in common are not unique.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import discard, stage
from symloom.llm.text import mix, powers, slices

GRAM = 16
STRIP = 8  # distances from the trigger of one strip of a crowded core's entries
FULL = 2000  # entries of one core that may meet in a task
BUCKET = 4000  # entries of a bucket of cores, about
WINDOW = 192
U = np.uint64


def triggers(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases: place of the trigger, first and last start, in bytes of ``data``; never across documents."""
    n = len(data)
    size = np.diff(offs)
    if n < length or not (size >= length).any():
        return (np.zeros(0, np.int64),) * 3
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(n), out=sums[1:])
    rolled = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n - GRAM + 1, True))
    # smallest of WINDOW hashes by doubling; the low bits hold the place, so ties go to the last
    bits = max(int(n).bit_length(), 1)
    ranked = (rolled >> U(bits) << U(bits)) | (U((1 << bits) - 1) - np.arange(len(rolled), dtype=U))
    step = 1
    while step < WINDOW:
        go = min(step, WINDOW - step)
        ranked = np.minimum(ranked[:-go], ranked[go:])
        step += go
    at = (U((1 << bits) - 1) - (ranked & U((1 << bits) - 1))).astype(np.int64)
    starts = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), starts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + offs[:-1][doc]
    at = at[place]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], place[first], place[last]


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def phrase_rows(length: int):
    """Of each phrase: document, first start, starts, hash of its core and hash of its context."""
    core = length - WINDOW + 1

    def apply(batches):
        for b in batches:
            for row, data, offs in slices(b.column(2)):
                at, lo, hi = triggers(data, offs, length)
                doc = np.searchsorted(offs, lo, "right") - 1
                raw = data.tobytes()
                cores = np.array([xxhash.xxh3_64_intdigest(raw[a : a + core]) for a in at.tolist()], U)
                whole = np.array([xxhash.xxh3_64_intdigest(raw[i : j + length], a - i) for a, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)], U)
                who = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(who), b.column(1).take(who), pa.array((lo - offs[doc]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int16)), pa.array((at - lo).astype(np.int16)), pa.array(cores.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["doc_id", "tag", "start", "starts", "ahead", "core", "whole"],
                )

    return apply


def contexts(length: int):
    """The bytes of dictionary entries, cut out of the documents that hold them."""

    def apply(batches):
        for b in batches:
            rows = []
            for doc, tag, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.encode()
                rows += [(doc, tag, e["start"], e["starts"], e["ahead"], e["core"], e["weight"], e["hot"], raw[e["start"] : e["start"] + e["starts"] - 1 + length]) for e in own]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ENTRY.replace(",", "").split()[::2])

    return apply


ENTRY = "doc_id long, tag int, start int, starts short, ahead short, core long, weight long, hot boolean, bytes binary"
RUN = "doc_id long, tag int, start int, starts int"


def sorted_suffixes(length: int):
    """The repeated starts of entries that occur once, by sorting all suffixes of the entries of some cores."""

    def apply(t):
        own = list(zip(t.column("starts").to_pylist(), t.column("bytes").to_pylist(), strict=True))
        a, b = halves([xxhash.xxh3_128_digest(raw[i : i + length]) for n, raw in own for i in range(n)])
        size = np.array([n for n, _ in own], np.int64)
        entry = np.repeat(np.arange(len(own)), size)
        step = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        weight = t.column("weight").to_numpy()
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weight[entry[order]])
        again = np.zeros(len(a), bool)
        again[order] = total[group] >= 2
        again &= (weight == 1)[entry]
        at = np.flatnonzero(again)
        head = np.ones(len(at), bool)
        head[1:] = (entry[at][1:] != entry[at][:-1]) | (step[at][1:] != step[at][:-1] + 1)
        first = np.flatnonzero(head)
        who = entry[at[first]]
        return pa.table({"doc_id": t.column("doc_id").take(pa.array(who)), "tag": t.column("tag").take(pa.array(who)), "start": pa.array((t.column("start").to_numpy()[who] + step[at[first]]).astype(np.int32)), "starts": pa.array(np.diff(np.append(first, len(at))).astype(np.int32))})

    return apply


def strips(length: int):
    """Entries cut into strips of suffixes by distance from the trigger, ``STRIP`` distances each.

    ``inner`` is the digest of the bytes that all strings of a strip hold, of those strings too
    that this entry lacks: where it is unique, no suffix of the strip repeats.
    """

    def apply(batches):
        for b in batches:
            rows = []
            for doc, tag, start, n, ahead, core, weight, hot, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for q in range((ahead - n + 1) // STRIP, ahead // STRIP + 1):
                    far, near = min(ahead, q * STRIP + STRIP - 1), max(ahead - n + 1, q * STRIP)
                    inner = xxhash.xxh3_64_intdigest(raw[ahead - q * STRIP : ahead - q * STRIP - STRIP + 1 + length], q)
                    rows.append((doc, tag, start + ahead - far, far - near + 1, far, core, weight, hot, raw[ahead - far : ahead - near + length], inner - (1 << 63)))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], (ENTRY + ", inner long").replace(",", "").split()[::2])

    return apply


def suffix_rows(length: int):
    """One row for each suffix of an entry: where it is, the entry's occurrences, its digest."""

    def apply(batches):
        for b in batches:
            for i in range(b.num_rows):
                n, raw = b.column(3)[i].as_py(), b.column(8)[i].as_py()
                k1, k2 = halves([xxhash.xxh3_128_digest(raw[j : j + length]) for j in range(n)])
                who = pa.array([i] * n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(np.arange(n, dtype=np.int32) + b.column(2)[i].as_py()), b.column(6).take(who), pa.array(k1), pa.array(k2)], ["doc_id", "tag", "start", "weight", "k1", "k2"])

    return apply


def cut(length: int, text_too: bool):
    """Per document: bytes, bytes and spans removed, digest of the rest; ``runs`` are (start, starts) that repeat."""

    def apply(batches):
        for b in batches:
            out = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for start, starts in sorted((r["start"], r["starts"]) for r in runs or ()):
                    end = start + starts - 1 + length
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for i, j in spans:
                    kept.append(raw[at:i])
                    at = j
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), bool(spans), rest.decode(errors="ignore") if text_too else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "text"])

    return apply


def pick(rows: DataFrame, ids: DataFrame, how: str, few: int) -> DataFrame | None:
    """Rows of (or without) the given (doc_id, tag), by broadcast while these are ``few`` at most; else None."""
    if ids.count() > few:
        return None
    ids = F.broadcast(ids.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")))
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), how)


def repeated_runs(own: DataFrame, length: int, few: int) -> DataFrame:
    """doc_id, tag, runs: the starts of repeated strings, as an array of (start, starts)."""
    phrases = stage(own.select("doc_id", "tag", "text").mapInArrow(phrase_rows(length), "doc_id long, tag int, start int, starts short, ahead short, core long, whole long"))
    cores = phrases.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    cores = stage(cores.where("n > 1").select(F.col("core").alias("c"), (F.col("least") != F.col("most")).alias("mixed")))
    again = stage(phrases.join(cores, F.col("core") == F.col("c")).drop("c"))  # both written, so that Spark can split a hot core
    discard(phrases, cores)

    place = F.struct("doc_id", "tag", "start", "starts", "ahead")
    entries = stage(again.where("mixed").groupBy("core", "whole").agg(F.count(F.lit(1)).alias("weight"), F.min(place).alias("at")))
    crowd = stage(entries.groupBy("core").agg((F.count(F.lit(1)) > FULL).alias("hot")).select(F.col("core").alias("c"), "hot"))
    wanted = entries.join(crowd, F.col("core") == F.col("c")).select("at.doc_id", "at.tag", F.struct("at.start", "at.starts", "at.ahead", "core", "weight", "hot").alias("e")).groupBy("doc_id", "tag").agg(F.collect_list("e").alias("own"))
    wanted = stage(wanted)
    holders = pick(own, wanted, "left_semi", few)
    holders = own if holders is None else holders
    opened = holders.join(wanted.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "own"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")))
    opened = stage(opened.select("doc_id", "tag", "text", "own").mapInArrow(contexts(length), ENTRY).dropDuplicates(["doc_id", "tag", "start"]))

    buckets = max(1, -(-entries.count() // BUCKET))
    runs = opened.where("not hot").groupBy(F.pmod(F.col("core"), F.lit(buckets)).alias("bucket")).applyInArrow(sorted_suffixes(length), RUN)
    hot = opened.where("hot")
    if not hot.isEmpty():
        cut_up = hot.mapInArrow(strips(length), ENTRY + ", inner long")
        shared = cut_up.groupBy("core", "inner").agg(F.sum("weight").alias("total")).where("total > 1").select(F.col("core").alias("c"), F.col("inner").alias("i"))
        cut_up = stage(cut_up.join(shared, (F.col("core") == F.col("c")) & (F.col("inner") == F.col("i"))).drop("c", "i", "inner"))
        rows = cut_up.mapInArrow(suffix_rows(length), "doc_id long, tag int, start int, weight long, k1 long, k2 long")
        twice = rows.groupBy("k1", "k2").agg(F.sum("weight").alias("total")).where("total > 1").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"))
        runs = runs.unionByName(rows.where("weight = 1").join(twice, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).select("doc_id", "tag", "start", F.lit(1).alias("starts")))
    whole = entries.where("weight > 1").select(F.col("core").alias("c"), F.col("whole").alias("w"))
    same = again.where("mixed").join(whole, (F.col("core") == F.col("c")) & (F.col("whole") == F.col("w"))).unionByName(again.where("not mixed"), allowMissingColumns=True)
    same = stage(same.select("doc_id", "tag", "start", F.col("starts").cast("int").alias("starts")))  # a stage of its own, so that Spark can split a hot context
    runs = runs.unionByName(same)
    out = stage(runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "starts")).alias("runs")))
    discard(again, entries, crowd, wanted, opened, same)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, text_too: bool = False, few: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether any byte goes), and the remaining ``text`` if ``text_too``.

    Each byte of a ``length``-byte string that also starts anywhere else, same document included,
    is removed; strings are judged on the input.  Null texts are empty; texts under ``length``
    bytes keep all.  Repeated rows are different places, so long ones lose everything.
    ``length`` is twice ``WINDOW`` at least.  ``text`` drops what a cut leaves of a character.
    Ids of the documents to look into again are broadcast while they are ``few`` at most; beyond
    that, texts are shuffled to them.
    """
    if length < 2 * WINDOW:
        raise ValueError(f"length is {length}; it must be {2 * WINDOW} at least")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tag", F.hash("text"))
    runs = repeated_runs(own, length, few)
    named = runs.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t"))
    changed, rest = pick(own, runs, "left_semi", few), pick(own, runs, "left_anti", few)
    if changed is None or rest is None:
        joined = own.join(named, same, "left").select("doc_id", "text", "runs")
    else:
        joined = changed.join(named, same).select("doc_id", "text", "runs").unionByName(rest.select("doc_id", "text", F.lit(None).cast(named.schema["runs"].dataType).alias("runs")))
    out = joined.mapInArrow(cut(length, text_too), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, text string")
    return out if text_too else out.drop("text")
