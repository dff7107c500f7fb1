"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import discard, stage

ROWS = 250_000  # labels of one file of a round


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of ``links`` (a, b).

    Each round takes the smallest label among neighbours and then the label's own label, so long
    chains halve; every round is a written table, in as many files as its links need, and goes
    when the next is written.  It ends when no label changes.  Links of a node with itself or
    with null are no links; without links there are no rows.
    """
    both = stage(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct())
    files = 1 + both.count() // ROWS
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")).coalesce(files))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        best = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stage(best.join(above, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")).coalesce(files))
        discard(labels)
        if new.where("label <> was").isEmpty():
            discard(both)
            return new.select("node", "label")
        labels = new.select("node", "label")
        labels._symloom_path = new._symloom_path


def with_more(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links ``more`` (a, b) are added; only components that these touch are worked out again."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left")
    ends = stage(ends.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")))
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("low"))
    single = ends.select(F.col("a").alias("node"), F.col("x").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("label"))).where("node = label").distinct()
    every = labels.unionByName(single.join(labels, "node", "left_anti"))
    out = stage(every.join(joined, "label", "left").select("node", F.coalesce("low", "label").alias("label")))
    discard(ends)
    return out
