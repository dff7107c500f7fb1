"""Triples as N-Triples and Turtle files, and as Parquet by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import vocab
from symloom.functions import literals as L
from symloom.functions.identity import base_of

COLUMNS = ("subject", "predicate", "object", "is_iri", "datatype")


def standard_prefixes(base_uri: str) -> list[tuple[str, str]]:
    return [*vocab.PREFIXES, (vocab.PREFIX, f"{base_of(base_uri)}/ontology/")]


def nt_header(prefixes: list[tuple[str, str]]) -> list[str]:
    """A comment line each; repeated prefixes stay."""
    return [f"# @prefix {p}: <{iri}> ." for p, iri in prefixes]


def ttl_header(prefixes: list[tuple[str, str]], any_triples: bool = True) -> list[str]:
    """Once each, the last IRI of a prefix wins, then a blank line; nothing without triples."""
    last = dict(prefixes)
    return [*(f"@prefix {p}: <{iri}> ." for p, iri in last.items()), ""] if last and any_triples else []


def lines(triples: DataFrame, fmt: str = "nt") -> DataFrame:
    """``line`` of each triple; the bag is kept as it is.

    A bag with a column ``verb`` (how a value was emitted: ``bool``, ``int``, ``long``, ``typed``
    ..) has only values of ``bool`` and ``int`` bare in Turtle; one without goes by datatype.
    """
    make = {"nt": L.nt_line, "ttl": L.ttl_line}[fmt]
    verb = {"verb": F.col("verb")} if fmt == "ttl" and "verb" in triples.columns else {}
    return triples.select(make(*map(F.col, COLUMNS), **verb).alias("line"))


def write_lines(triples: DataFrame, path: str, fmt: str = "nt", prefixes: list[tuple[str, str]] | None = None, one_file: bool = False, ordered: bool = False) -> None:
    """Text files under ``path`` (overwritten), UTF-8 with LF; the header is a file of its own, first by name.

    ``ordered`` sorts the whole bag, which shuffles it.

    ``one_file`` orders and streams all lines through one task; use it for small graphs only.
    """
    spark = triples.sparkSession
    body = lines(triples, fmt)
    header = nt_header(prefixes or []) if fmt == "nt" else ttl_header(prefixes or [], not triples.isEmpty())
    if one_file:
        top = spark.createDataFrame([(0, i, x) for i, x in enumerate(header)], "part int, pos long, line string")
        body = body.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), "line")
        whole = top.unionByName(body).coalesce(1)
        whole.sortWithinPartitions("part", "pos", "line").select("line").write.mode("overwrite").option("lineSep", "\n").text(path)
        return
    body = body.sort("line") if ordered else body
    if header:  # a union keeps the order of partitions, so the header's file is part 0
        body = spark.createDataFrame([(i, x) for i, x in enumerate(header)], "pos long, line string").coalesce(1).sortWithinPartitions("pos").select("line").unionByName(body)
    body.write.mode("overwrite").option("lineSep", "\n").text(path)


def parse_nt(line: Column) -> list[Column]:
    """The five columns of an N-Triples line.  Lenient: IRIs may hold blanks and backticks, as signatures do."""
    # one greedy run to the last quote: repeated groups would recurse once for each escape
    pattern = r"^<([^\"]*?)> <([^>\s\"]+)> (?:<(.*)>|\"(.*)\"(?:\^\^<([^\"]*)>)?) \.$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    is_iri = F.rlike(line, F.lit(r"^<[^\"]*?> <[^>\s\"]+> <.*> \.$"))
    typed = F.rlike(line, F.lit(r"\"\^\^<[^\"]*> \.$")) & ~is_iri
    return [part(1).alias("subject"), part(2).alias("predicate"), F.when(is_iri, part(3)).otherwise(L.unescape_literal(part(4))).alias("object"), is_iri.alias("is_iri"), F.when(typed, part(5)).alias("datatype")]


def read_nt(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; comments and blank lines are skipped."""
    rows = spark.read.option("lineSep", "\n").text(path).where("value <> '' and not startswith(value, '#')")
    return rows.select(*parse_nt(F.col("value")))


def by_predicate(triples: DataFrame) -> DataFrame:
    """``triples`` with ``folder``, the predicate once more to name folders by, dealt out by it; Spark splits the frequent ones."""
    return triples.withColumn("folder", F.col("predicate")).hint("rebalance", F.col("folder"))


def write_store(triples: DataFrame, path: str) -> None:
    """Parquet by predicate, so that a pattern with a constant predicate reads its folder alone."""
    by_predicate(triples).write.mode("overwrite").partitionBy("folder").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
