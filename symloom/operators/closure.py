"""Closures over references: type stubs, namespaces, assemblies; and who was described first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.staging import stage


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``node`` reachable from ``start`` (node) along ``edges`` (src, dst), itself included.

    A frontier goes on until nothing new appears, so cycles end; each round joins the frontier
    alone and is a written table.
    """
    seen = stage(start.select("node").where("node is not null").distinct())
    front, edges = seen, stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    while True:
        front = stage(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def ancestors(namespaces: DataFrame) -> DataFrame:
    """ns_id, ancestor, depth for each namespace and itself, up to but without the global one."""
    own = namespaces.where("not is_global")
    step = own.select(F.col("ns_id"), F.col("ns_id").alias("ancestor"), F.lit(0).alias("depth"))
    up = own.select(F.col("ns_id").alias("child"), "parent_ns_id").join(own.select(F.col("ns_id").alias("parent_ns_id")), "parent_ns_id", "left_semi")
    out = step
    while True:
        step = stage(step.join(up, F.col("ancestor") == F.col("child")).select("ns_id", F.col("parent_ns_id").alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        if step.isEmpty():
            return out
        out = out.unionByName(step)


def walk(types: DataFrame) -> DataFrame:
    """type_id, depth, path: nesting from outermost types down, ``path`` of type_ids joined by ``/``."""
    step = types.where("containing_type_id is null").select("type_id", F.lit(0).alias("depth"), F.col("type_id").alias("path"))
    inner, out = types.where("containing_type_id is not null").select(F.col("type_id").alias("inner"), "containing_type_id"), step
    while True:
        step = stage(step.join(inner, F.col("type_id") == F.col("containing_type_id")).select(F.col("inner").alias("type_id"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "inner").alias("path")))
        if step.isEmpty():
            return out
        out = out.unionByName(step)


def resolve_paths(names: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, path: the first hit of each name over search folders by ``dir_rank``; none, no row."""
    hits = names.select(F.lower("file_name").alias("key")).distinct().join(files.withColumn("key", F.lower("file_name")), "key")
    first = Window.partitionBy("key").orderBy("dir_rank", "path")
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").select("file_name", "path")


def assembly_closure(root: DataFrame, refs: DataFrame, files: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """name, path of ``root`` (name) and all it refers to (refs: name, ref), by names without case.

    A name without file is skipped, and what it refers to is not looked at.  ``extra`` (name,
    path) joins after the closure where its name is new: neither found nor looked for in vain.
    """
    known = files.select(F.lower("file_name").alias("node")).distinct()
    edges = refs.select(F.lower("name").alias("src"), F.lower("ref").alias("dst")).join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    nodes = reach(root.select(F.lower("name").alias("node")), edges)
    found = resolve_paths(nodes.select(F.col("node").alias("file_name")), files).select(F.lower("file_name").alias("name"), "path")
    if extra is not None:
        more = extra.select(F.lower("name").alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))
        asked = refs.select(F.lower("name").alias("src"), F.lower("ref").alias("name")).join(found.select(F.col("name").alias("src")), "src", "left_semi").select("name")
        found = found.unionByName(more.join(found.select("name").unionByName(asked), "name", "left_anti"))
    return found


def first_touch(included: DataFrame, refs: DataFrame, stub_edges: DataFrame) -> DataFrame:
    """Nodes that a sequential walk describes in full.

    ``included`` (node, walk_rank), ``refs`` (src, dst): what a full description of src
    mentions, ``stub_edges`` (src, dst): what a stub mentions.  A node is full unless an earlier
    full node reaches it; started from all full, the rule is applied until nothing changes.
    References to nodes from which no included one can be reached have no say and are left out first.
    """
    included = stage(included)
    back = reach(included.select("node"), stub_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    stub_edges = stage(stub_edges.join(back.select(F.col("node").alias("src")), "src", "left_semi").join(back.select(F.col("node").alias("dst")), "dst", "left_semi"))
    direct = refs.where("src <> dst").select("src", "dst").join(back.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    pairs = step = stage(direct)
    while True:
        step = stage(step.join(stub_edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct().join(pairs, ["src", "dst"], "left_anti"))
        if step.isEmpty():
            break
        pairs = pairs.unionByName(step)
    ranked = pairs.join(included.select(F.col("node").alias("src"), F.col("walk_rank").alias("src_rank")), "src").join(included.select(F.col("node").alias("dst"), F.col("walk_rank").alias("dst_rank")), "dst")
    earlier = stage(ranked.where("src_rank < dst_rank").select("src", "dst").distinct())
    full = included.select("node")
    while True:
        touched = earlier.join(full.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = stage(included.select("node").join(touched, "node", "left_anti"))
        same = new.exceptAll(full).isEmpty() and full.exceptAll(new).isEmpty()
        if same:
            return new
        full = new
