"""Secret scans with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import stage

# The patterns of the base kinds, keyword letters in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a failing match takes its whole run, so the minimum can stand in the pattern
HEX = r"[0-9a-f]{16,}"
# Tokens with an issuer's mark, which the method judges besides the base kinds.
ISSUED = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
ISSUED_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "xox", "eyJ")
PART = 256  # cuts of one stretch of a text
KINDS = ("assign", "access", "hex", "issued", "live")
WIDE = 3  # owners from which a value is a widely copied example
WIDE_REPOS = 4  # repositories from which it is one, be they of one owner


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; what a lambda reads from outside is worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """What ``combine`` makes of each integer and all before it, in rounds that double their reach.

    A fold that carries an array copies it at every element; rounds take n log n steps.
    """
    def wider(own, k):
        return F.transform(own, lambda x, i: F.when(i >= k, combine(x, F.get(own, i - k))).otherwise(x))

    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(reach, values, wider)


def size(x: Column) -> Column:
    return F.coalesce(F.char_length(x), F.lit(0))


SPAN = "struct<start:int,kind:int,end:int,from:int,value:string>"


def occurrences(text: Column, kind: int, pattern: str, group: int, least: int, marks: tuple[str, ...] = ()) -> Column:
    """Array of (start, kind, end, from, value): leftmost non-overlapping matches, places in code points.

    ``from`` is where the value starts; matches of values under ``least`` characters are left out.
    The text between matches and the matches themselves add up to the places.  ``marks``: each
    match holds one of them, so that a text without any needs no search.
    """
    def found(hits: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
        ends = let(F.transform(pieces, lambda p: size(p["gap"]) + size(p["hit"])), lambda own: running(own, lambda x, y: x + y))
        spans = F.transform(
            F.arrays_zip(hits.alias("hit"), ends.alias("end")),
            lambda z: let(
                F.regexp_extract(z["hit"], pattern, group),
                lambda v: F.struct((z["end"] - size(z["hit"])).alias("start"), F.lit(kind).alias("kind"), z["end"].alias("end"), (z["end"] - size(v)).alias("from"), v.alias("value")),
            ),
        )
        return F.filter(spans, lambda x: size(x["value"]) >= least)

    none = F.array().cast(f"array<{SPAN}>")
    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, found(hits)).otherwise(none))
    some = F.lit(False)
    for mark in marks:
        some = some | F.contains(text, F.lit(mark))
    return F.when(some, out).otherwise(none) if marks else out


def all_occurrences(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            occurrences(text, 0, ASSIGN, 2, 12, (":", "=")),
            occurrences(text, 1, ACCESS, 0, 18, ("AKIA",)),
            occurrences(text, 2, HEX, 0, 16),
            occurrences(text, 3, ISSUED, 0, 1, ISSUED_MARKS),
        )
    )


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def owners(found: DataFrame) -> DataFrame:
    """Of each candidate's hash: distinct owners, distinct repositories, occurrences.

    Counted by (value, owner, repository), then (value, owner), then value, so that no count of
    distinct things gathers a hot value's rows.
    """
    each = found.select(F.sha2("value", 256).alias("hash"), "owner", "repo").groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def wide(owners: Column, repos: Column) -> Column:
    return (owners >= WIDE) | (repos >= WIDE_REPOS)


def live(value: Column, owners: Column, repos: Column) -> Column:
    """In few owners and few repositories, and of many different characters, digits and letters among them."""
    return ~wide(owners, repos) & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~F.rlike(F.lower(value), F.lit("example|sample|dummy|changeme|placeholder|xxxx|test"))


def judged(rows: DataFrame) -> DataFrame:
    """row, judged: (span, owners, repos, live) of each span of ``rows`` (row, found, owner, repo), in order.

    Rows without candidates are left out.  The counts are written before they are joined, so that
    Spark can split the rows of a value that is everywhere.
    """
    one = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s", F.col("s.value").alias("value"))
    counts = stage(owners(one).select(F.col("hash").alias("h"), "owners", "repos"))
    one = one.select("row", "s", F.sha2("value", 256).alias("hash")).join(counts, F.col("hash") == F.col("h"))
    verdict = F.struct("s", "owners", "repos", live(F.col("s.value"), F.col("owners"), F.col("repos")).alias("live"))
    return one.groupBy("row").agg(F.array_sort(F.collect_list(verdict)).alias("judged"))


def some_match(text: Column) -> Column:
    """Whether ``text`` has a match of any kind, its value long enough or not."""
    some = lambda marks: F.greatest(*[F.contains(text, F.lit(m)) for m in marks]) if len(marks) > 1 else F.contains(text, F.lit(marks[0]))
    return F.rlike(text, F.lit(HEX)) | (some((":", "=")) & F.rlike(text, F.lit(ASSIGN))) | (some(("AKIA",)) & F.rlike(text, F.lit(ACCESS))) | (some(ISSUED_MARKS) & F.rlike(text, F.lit(ISSUED)))


def with_owner(docs: DataFrame, *more: Column) -> DataFrame:
    """found, owner, repo and ``more`` of each row, numbered and written."""
    owner = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    repo = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit("\0")))
    found = all_occurrences(F.coalesce(F.col("text"), F.lit("")))
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), found.alias("found"), owner.alias("owner"), repo.alias("repo"), *more))


def once(spans: Column) -> Column:
    """Sorted, each span once."""
    return let(F.array_sort(spans), lambda x: F.filter(x, lambda s, i: (i == 0) | (s != F.get(x, i - 1))))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text: the base spans and their digest, and the spans that the method adds.

    The method hashes each candidate value, counts the distinct owners (``source``) and
    repositories (``source`` and ``lang``) that hold it, and adds a span ``live`` for a value of
    few owners and repositories that looks real, and ``issued`` for a token with an issuer's mark of that sort.
    Null and empty texts have no spans; a null source is an owner of its own; repeated rows are
    reported each.
    """
    base = with_owner(docs, F.col("doc_id").cast("long").alias("doc_id"))
    verdicts = judged(base)
    some = base.where(F.size("found") > 0).join(verdicts, "row").select("doc_id", "found", "judged")
    bare = base.where(F.size("found") == 0).select("doc_id", "found", F.array().cast(verdicts.schema["judged"].dataType).alias("judged"))
    out = some.unionByName(bare).withColumn("base", F.filter("found", lambda s: s["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    plain = lambda s, kind, start, end: F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))
    added = F.transform(F.filter("judged", lambda j: j["live"]), lambda j: plain(j, F.when(j["s"]["kind"] == 3, F.lit(3)).otherwise(F.lit(4)), j["s"]["from"], j["s"]["end"]))
    own = F.transform("base", lambda s: plain(s, s["kind"], s["start"], s["end"]))
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(once(F.concat(own, added))).alias("spans"),
        F.size(F.filter("judged", lambda j: j["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda j: wide(j["owners"], j["repos"]))).cast("long").alias("n_copied"),
    )


def merged(cuts: Column) -> Column:
    """Cuts (from, end, wide; sorted) none of which overlap: one that starts in an earlier one lengthens it."""
    def of(own, ends):
        heads = F.filter(F.transform(own, lambda c, i: F.when((i == 0) | (c["from"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(own, i)["from"].alias("from"), F.get(ends, F.coalesce(F.get(at, j + 1), F.size(own)) - 1).alias("end"), F.get(own, i)["wide"].alias("wide"))))

    return let(cuts, lambda own: let(running(F.transform(own, lambda c: c["end"]), F.greatest), lambda ends: of(own, ends)))


def replaced(text: Column, cuts: Column) -> Column:
    """``text`` with marks in place of ``cuts`` (from, end, wide; sorted, one at least).

    Worked off by parts of cuts, each within its own stretch of the text, as finding a place in a
    text takes time in proportion to what stands before it.
    """
    def stretch(own, n):
        part = F.slice(own, n * PART + 1, PART)
        mark = lambda c: F.when(c["wide"], F.lit("[EXAMPLE]")).otherwise(F.lit("[SECRET]"))
        between = lambda at, here, text: F.transform(
            here, lambda c, j: let(F.when(j == 0, at).otherwise(F.get(here, j - 1)["end"]), lambda p: F.concat(F.substring(text, p - at + 1, c["from"] - p), mark(c))))
        at = F.when(n == 0, F.lit(0)).otherwise(F.get(own, n * PART - 1)["end"])
        return let(part, lambda here: let(at, lambda at: let(F.substring(text, at + 1, F.element_at(here, -1)["end"] - at), lambda inner: F.array_join(between(at, here, inner), ""))))

    def whole(own):
        parts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / PART).cast("int"))
        return F.concat(F.array_join(F.transform(parts, lambda n: stretch(own, n)), ""), F.substring(text, F.element_at(own, -1)["end"] + 1, F.char_length(text)))

    return let(merged(cuts), whole)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every base value and live issued token replaced; n_chars follows the text.

    Widely copied examples get their own mark.  Only rows with a match are written and
    shuffled; all columns and their order stay, null texts too.
    """
    any_ = some_match(F.coalesce(F.col("text"), F.lit("")))
    rows = with_owner(docs.where(any_), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("keep"))
    dirty = rows.join(judged(rows), "row", "left")
    cuts = F.array_sort(F.transform(F.filter(F.coalesce("judged", F.array()), lambda j: (j["s"]["kind"] < 3) | j["live"]), lambda j: F.struct(j["s"]["from"].alias("from"), j["s"]["end"].alias("end"), wide(j["owners"], j["repos"]).alias("wide"))))
    done = dirty.select("keep", let(cuts, lambda own: F.when(F.size(own) > 0, replaced(F.col("keep.text"), own)).otherwise(F.col("keep.text"))).alias("new"))
    cols = []
    for f in docs.schema:
        value = {"text": F.col("new"), "n_chars": F.when(F.col("keep.n_chars").isNotNull(), F.char_length("new")) if f.name == "n_chars" else None}.get(f.name)
        cols.append((value if value is not None else F.col(f"keep.`{f.name}`")).cast(f.dataType).alias(f.name))
    return docs.where(~any_).unionByName(done.select(*cols))
