"""Exact Jaccard self-join of shingle sets with set-relation skipping.

Index-level skipping.  Sets are joined through lists of their smallest shingle hashes.  A set of
n shingles posts its first ``n - ceil(3n/4) + ceil(n/16)`` hashes, and all hashes below a fixed
threshold.  Two sets that link share at least ``ceil(n/16)`` (of the smaller) posted hashes, so
each set may leave its most frequent ``ceil(3n/64) - 1`` posted hashes out of the lists: the
rarest shared one stays in both.  Hashes that no other set has are known to be unshared; with u
and v of them in two sets of n and m shingles, ``u + v <= (n + m) / 7`` must hold, so that lists
and pairs of sets with much text of their own are skipped.  They are counted among the hashes
below the threshold first, then among all hashes of the sets that are still listed.

Answer-level skipping.  A list's leader is compared with its members first.  Members that link
with it are one component, whose answers the leader's answer gives: they are never compared with
each other.  For the rest the leader's answers are kept shingle by shingle: what two members
share of the leader's text, and how much each has that neither the leader nor it alone has, bound
what they can share; only pairs that the bound lets through are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.components import components, with_more
from symloom.llm.staging import discard, stage
from symloom.llm.text import Words, as_long, distinct, lean, mix, pieces, slices

U = np.uint64
LOW = U(int(0.3125 * 2**64))  # hashes below it are all posted
SPARE = 16  # 1/16 of a set's shingles may be posted beyond the shortest prefix
BUCKET = 1 << 18  # posted hashes of one bucket, about
FLUSH = 1 << 19  # posted hashes that a task gathers before it sends them
GROUP = 4096  # sets whose counts are added in one task, at most
HELD = 1 << 20  # posted hashes of those sets, about
PAST = 1 << 16  # sets among which what is past ``OFTEN`` of a bucket is dealt out
CELL = 200  # sets on each side of a block of pairs whose bounds one task works out
OFTEN = 16  # how often a hash may be posted in one flush; frequencies count up to it


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes end to end, each document's bounds, and the document of each."""
    w = Words(data, offs)
    gram, doc, _ = w.grams()
    values, bounds = distinct(gram, doc, w.docs)
    return values, bounds, np.repeat(np.arange(w.docs), np.diff(bounds))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify a set."""
    out = []
    for salt in (0x51ED270B6F4A9D13, 0xA24BAED4963EE407):
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(mix(values ^ U(salt)), out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def below(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values < LOW, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), low (those below the fixed threshold), k1, k2."""

    def apply(batches):
        for b in batches:
            for row, data, offs in slices(b.column(1)):
                values, bounds, _ = shingles(data, offs)
                k1, k2 = set_keys(values, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(offs) - 1), *map(pa.array, (np.diff(bounds), below(values, bounds), as_long(k1), as_long(k2)))], ["doc_id", "n", "low", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(apply), "doc_id long, n long, low long, k1 long, k2 long")


def poster(bits: int, source, parts: int = 1):
    """Sends what ``source`` posts by bucket: entries of 39 bits of hash, 1 of ``below``, 24 of place in ``keys``.

    Hashes that one flush holds more than ``OFTEN`` times go to their bucket ``OFTEN`` times: they
    are known to be frequent, so no bucket meets more than ``OFTEN`` of a hash from one flush.  The
    rest go past it (bucket numbers from 2**bits), to one of ``parts`` by their set, as nothing
    needs to be counted there.
    """

    def send(token, low, key):
        order = np.lexsort((key, token))
        token, low, key = token[order], low[order], key[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, low, key = token[new], low[new], key[new]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(head)
        rank = np.arange(len(token)) - np.repeat(start, np.diff(np.append(start, len(token))))
        bucket = (token >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
        past = rank >= OFTEN
        bucket = np.where(past, bucket + ((1 + (mix(key) % U(parts)).astype(np.int64)) << bits), bucket)
        entry = (((token << U(bits)) >> U(25)) << U(1)) | low
        order = np.argsort(bucket, kind="stable")
        bucket, entry, key = bucket[order], entry[order], key[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(bucket)), strict=True):
            if j > i:
                own, place = np.unique(key[i:j], return_inverse=True)
                packed = (entry[i:j] << U(24)) | place.astype(U)
                yield int(bucket[i]), packed.tobytes(), own.tobytes()

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "entries", "keys"])

    def flushed(held):
        out = send(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()  # before the work, which holds a copy
        return batch(list(out))

    def apply(batches):
        held, size = [], 0
        for b in batches:
            for token, key in source(b):
                held.append((mix(token), (token < LOW).astype(U), key))
                size += len(token)
                if size >= FLUSH:
                    yield flushed(held)
                    size = 0
        if size:
            yield flushed(held)

    return lean(apply)


def prefixes(b: pa.RecordBatch):
    """Posted hashes of texts, with the first key of their set."""
    for _, data, offs in slices(b.column(0)):
        values, bounds, doc = shingles(data, offs)
        n = np.diff(bounds)
        prefix = n - -(-3 * n // 4) + -(-n // SPARE)
        take = np.maximum(np.minimum(prefix, n), below(values, bounds))
        posted = np.arange(len(values)) - bounds[:-1][doc] < take[doc]
        yield values[posted], set_keys(values, bounds)[0][doc[posted]]


def whole_sets(b: pa.RecordBatch):
    """All hashes of sets, with the document that names the set."""
    for part in pieces(b):
        for i, x in zip(part.column(0).to_numpy().view(U), part.column(1).to_pylist(), strict=True):
            own = np.frombuffer(x, U)
            yield own, np.full(len(own), i)


def repeated(bits: int, groups: int, counted: bool = False):
    """Of one bucket, the hashes that two different sets have: by set, with frequencies up to ``OFTEN``.

    One row for each of ``groups`` groups of sets.  ``counted``: only how many each set has.
    """

    def apply(key, t):
        bucket = key[0].as_py()
        entries = [np.frombuffer(x, U) for x in t.column("entries").to_pylist()]
        keys = [np.frombuffer(x, U)[(e & U((1 << 24) - 1)).astype(np.int64)] for x, e in zip(t.column("keys").to_pylist(), entries, strict=True)]
        token, own = np.concatenate(entries) >> U(24), np.concatenate(keys)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own = token[new], own[new]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(token)))
        count = np.repeat(np.minimum(size, OFTEN), size)
        if bucket >= 1 << bits:
            bucket, count = bucket & ((1 << bits) - 1), np.full(len(token), OFTEN)
        keep = count > 1
        token, own, count = token[keep] | U(bucket << 40), own[keep], count[keep].astype(np.uint8)
        group = (mix(own) % U(groups)).astype(np.int64)
        order = np.lexsort((own, group))
        group, token, own, count = group[order], token[order], own[order], count[order]
        if counted:
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
            group, count, own = group[first], np.diff(np.append(first, len(own))), own[first]
        parts = np.split(np.arange(len(own)), np.flatnonzero(np.diff(group)) + 1) if len(own) else []
        cols = {"group": pa.array([int(group[i[0]]) for i in parts], pa.int64()), "sets": pa.array([own[i].tobytes() for i in parts], pa.binary())}
        if counted:
            return pa.table(cols | {"shared": pa.array([count[i].astype(np.int64).tobytes() for i in parts], pa.binary())})
        return pa.table(cols | {"tokens": pa.array([token[i].tobytes() for i in parts], pa.binary()), "counts": pa.array([count[i].tobytes() for i in parts], pa.binary())})

    return lean(apply)


def summed(t: pa.Table) -> pa.Table:
    """s, shared: the counts of one group of sets, added over buckets."""
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("sets").to_pylist()])
    s, at = np.unique(sets, return_inverse=True)
    shared = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in t.column("shared").to_pylist()]), len(s))
    return pa.table({"s": pa.array(s), "shared": pa.array(shared.astype(np.int64))})


def gathered(t: pa.Table) -> pa.Table:
    """k1, tokens, counts: what the buckets found of each set of one group, put together."""
    own, token = (np.concatenate([np.frombuffer(x, U) for x in t.column(c).to_pylist()]) for c in ("sets", "tokens"))
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("counts").to_pylist()])
    order = np.argsort(own, kind="stable")
    own, token, count = own[order], token[order], count[order]
    parts = np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1)
    return pa.table({"k1": as_long(np.array([own[i[0]] for i in parts], U)), "tokens": pa.array([token[i].tobytes() for i in parts], pa.binary()), "counts": pa.array([count[i].tobytes() for i in parts], pa.binary())})


def choose(batches):
    """The hashes that a set is listed under (see the module); sets with too much text of their own go."""
    for b in batches:
        rows = []
        for tokens, counts, n, low, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            token, at = np.unique(np.frombuffer(tokens, U), return_index=True)  # copies may have come by both ways
            count = np.frombuffer(counts, np.uint8)[at]
            alone = low - int(np.count_nonzero(token & U(1)))
            if 4 * alone > n:
                continue
            order = np.lexsort((token, count))
            spare = -(-3 * n // (4 * SPARE)) - 1
            kept = token[order][: len(order) - spare] if spare else token
            if len(kept):
                rows.append((s, n, alone, kept.view(np.int64)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["s", "n", "alone", "tokens"])


def full_sets(docs: DataFrame, wanted: DataFrame, few: int = 1_000_000) -> DataFrame:
    """s, shingles (sorted, as bytes) of the wanted documents (s).

    The ids wanted are broadcast while they are ``few`` at most; else texts are shuffled to them.
    """

    def apply(batches):
        for b in batches:
            for row, data, offs in slices(b.column(1)):
                values, bounds, _ = shingles(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(offs) - 1), pa.array([values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["s", "shingles"])

    wanted = F.broadcast(wanted) if wanted.count() <= few else wanted
    own = docs.select(F.col("doc_id").cast("long").alias("s"), "text").join(wanted, "s", "left_semi")
    return own.mapInArrow(lean(apply), "s long, shingles binary")


def compare(pairs: DataFrame, sets: DataFrame, with_bits: bool = False) -> DataFrame:
    """a, b, common, either: sizes of intersection and union of each pair (a, b).

    ``with_bits``: also which of a's shingles, in order, b has.
    """

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole):
                left = [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
                right = [np.frombuffer(x, U) for x in batch.column(3).to_pylist()]
                has = [np.isin(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
                common = np.array([np.count_nonzero(x) for x in has], np.int64)
                either = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
                arrays = [batch.column(0), batch.column(1), pa.array(common), pa.array(either)]
                if with_bits:
                    arrays.append(pa.array([np.packbits(x).tobytes() for x in has], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "common", "either", "bits"][: len(arrays)])

    with_b = pairs.join(sets.select(F.col("s").alias("b"), F.col("shingles").alias("right")), "b")
    both = with_b.join(sets.select(F.col("s").alias("a"), F.col("shingles").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(lean(apply), "a long, b long, common long, either long" + ", bits binary" * with_bits)


def cell(t: pa.Table) -> pa.Table:
    """Pairs of one block of sets to place (x) and one of members (y) of a leader that may link.

    What both share with the leader is counted by its shingles; the rest is at most the smaller
    of what each has that is neither the leader's nor its alone.
    """
    is_x = t.column("x").to_numpy(zero_copy_only=False)
    get = lambda name, rows: t.column(name).to_numpy()[rows]
    x, y = np.flatnonzero(is_x), np.flatnonzero(~is_x)
    bits = t.column("bits").to_pylist()
    unpack = lambda rows: np.unpackbits(np.array([np.frombuffer(bits[i], np.uint8) for i in rows]), axis=1).astype(np.float32)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(x) and len(y):
        n_y, alone_y, own_y, s_y, label_y, table = get("n", y), get("alone", y), get("own", y), get("s", y), get("label", y), unpack(y)
        for part in np.array_split(x, -(-len(x) // 64)):
            n_x, alone_x, own_x = get("n", part)[:, None], get("alone", part)[:, None], get("own", part)[:, None]
            bound = (unpack(part) @ table.T).astype(np.int64) + np.minimum(own_x, own_y)
            ok = (175 * bound >= 75 * (n_x + n_y)) & (7 * (alone_x + alone_y) <= n_x + n_y) & (get("label", part)[:, None] != label_y)
            i, j = np.nonzero(ok)
            one, two = get("s", part)[i], s_y[j]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def unsettled(done: DataFrame, listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) under one leader that its answers leave open.

    Members of the leader's main component need no comparison with each other; the others are
    held against all members, in cells of ``CELL`` by ``CELL`` sets, so that a leader of many
    members is the work of many tasks, and no pair is a row before its bound lets it through.
    """
    sizes = listed.select("s", "n", "alone")
    known = done.select("a", F.col("b").alias("s"), "common", "bits").join(sizes, "s").join(labels.withColumnRenamed("node", "s"), "s", "left")
    known = stage(known.select("a", "s", "n", "alone", F.coalesce("label", "s").alias("label"), "common", (F.col("n") - F.col("common") - F.col("alone")).alias("own"), "bits"))
    main = known.groupBy("a", "label").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own"), F.min("n").alias("n"))
    main = main.groupBy("a").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("members"), F.max(F.struct("c", "label")).alias("main"), F.max("own").alias("most_own"), F.min("n").alias("least_n")).where("labels > 1")
    side = known.join(main, "a")
    reach = F.col("common") + F.least("own", "most_own")
    x = side.where("label <> main.label").where(175 * reach >= 75 * (F.col("n") + F.greatest("least_n", F.col("n") * 3 / 4)))
    waiting = x.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("x_blocks")).withColumnRenamed("a", "w_a")
    fields = ["a", "s", "n", "alone", "label", "own", "bits"]
    rows, blocks = F.pmod(F.xxhash64("s"), F.col("x_blocks")), F.ceil(F.col("members") / CELL)
    place = F.pmod(F.xxhash64("s", F.lit(1)), blocks)
    x = x.join(waiting, F.col("a") == F.col("w_a")).select(*fields, F.lit(True).alias("x"), rows.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    y = side.join(waiting, F.col("a") == F.col("w_a")).select(*fields, F.lit(False).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_blocks") - 1)).alias("i"), place.alias("j"))
    # dealt by all keys: Spark would take the joins' partitioning by leader for the groups too
    return x.unionByName(y).repartition("a", "i", "j").groupBy("a", "i", "j").applyInArrow(lean(cell), "a long, b long").distinct()


def bits_for(amount: int, share: float) -> int:
    """Bits of a bucket's number, so that buckets get ``BUCKET`` hashes or so."""
    posted = amount * share if share < 1 else amount / share
    return min(24, max(0, int(np.ceil(np.log2(max(posted / BUCKET, 1))))))


def with_heads(listed: DataFrame) -> DataFrame:
    """token, s, n, alone, and the list's leader (a): of its sets the one with the least text of its own.

    Lists of one set, and those whose leader has too much of its own to link, are left out.
    """
    rows = listed.select("s", "n", "alone", F.explode("tokens").alias("token"))
    heads = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), "s", "n", "alone")).alias("head"))
    heads = heads.where("size > 1 and head.alone * 7 <= head.n").select("token", F.col("head.s").alias("a"))
    return rows.join(stage(heads), "token")  # written first, so that Spark can split the rows of a hot token


def join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= 75 * union of their shingle sets; component_id is
    the smallest doc_id reachable.  Texts of under five words are one shingle; null and wordless
    texts have none and link with nothing.  Equal sets are one set, named by its smallest doc_id,
    before anything is compared.  Rows of one doc_id are one node; rows without doc_id take part
    only as copies and get the component of what equals them.
    """
    sizes = stage(measured(docs))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = bits_for(total, 0.34)
    uniq = stage(sizes.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("s"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("low").alias("low")).where("s is not null"))

    different = uniq.count()
    posted = docs.select("text").mapInArrow(poster(bits, prefixes, 1 + different // PAST), "bucket long, entries binary, keys binary")
    groups = max(1, different // GROUP, int(total * 0.34) // HELD)
    found = posted.groupBy("bucket").applyInArrow(repeated(bits, groups), "group long, sets binary, tokens binary, counts binary")
    found = found.groupBy("group").applyInArrow(lean(gathered), "k1 long, tokens binary, counts binary")
    listed = found.join(uniq, "k1").select("tokens", "counts", "n", "low", "s").mapInArrow(lean(choose), "s long, n long, alone long, tokens array<long>")
    listed = kept = stage(listed)

    sets = stage(full_sets(docs, with_heads(listed).select("s").distinct()))
    many, amount = sets.agg(F.count(F.lit(1)), F.sum(F.octet_length("shingles"))).first()
    bits, groups = bits_for(amount or 0, 8), max(1, many // GROUP)
    shared = sets.mapInArrow(poster(bits, whole_sets, 1 + many // PAST), "bucket long, entries binary, keys binary").groupBy("bucket").applyInArrow(repeated(bits, groups, True), "group long, sets binary, shared binary")
    shared = shared.groupBy("group").applyInArrow(lean(summed), "s long, shared long")
    listed = listed.join(shared, "s").withColumn("alone", F.col("n") - F.col("shared")).where("4 * alone <= n").drop("shared")
    lists = stage(with_heads(listed))
    first = lists.where("s <> a").select("a", F.col("s").alias("b")).distinct()
    linked = F.col("common") * 100 >= F.col("either") * 75
    done = stage(compare(first, sets, with_bits=True))
    labels = components(done.where(linked).select("a", "b"))
    tested = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stage(unsettled(done, listed, labels).join(tested, ["a", "b"], "left_anti"))
    more = stage(compare(rest, sets).where(linked).select("a", "b"))
    if not more.isEmpty():
        labels = with_more(labels, more)
    discard(kept, sets, lists, done, rest, more)

    named = uniq.join(labels.withColumnRenamed("node", "s"), "s", "left").where("copies > 1 or label is not null").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.coalesce("label", "s").alias("label"))
    out = sizes.join(named, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id.

    Repeated rows of a doc_id become one, rows without doc_id stay.  The ids that go are
    broadcast while they are ``few`` at most, else joined.
    """
    gone = stage(join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct())
    many = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("many_id")).count().where("count > 1").select("many_id")
    kept = docs.join(F.broadcast(gone) if gone.count() <= few else gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    many = stage(many)
    if many.isEmpty():
        return kept
    again = F.col("doc_id") == F.col("many_id")
    return kept.join(many, again, "left_anti").unionByName(kept.join(many, again, "left_semi").dropDuplicates(["doc_id"]))
