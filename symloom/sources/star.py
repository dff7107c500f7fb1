"""A star schema of orders read as symbol tables, so that every operator has data to run on.

regions are assemblies; regions and nations namespaces; customers the target types; parts the
types they refer to (definitions ``p``, constructed ``q``, arrays ``a``, pointers ``r``); orders
members; line items parameters and attributes, whose classes are suppliers; events documentation.

``load(.., wide=True)`` has what the plain mapping lacks besides: the global namespace, a base that
is the root of all objects, type parameters of types and methods with constraints, explicit
implementations, indexers, methods of kinds that are no members, ``in`` parameters, return attributes,
null and array constants, and references to members in documentation.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symloom.schema import TABLES

ACCESS = ("Public", "Private", "Internal", "Protected", "ProtectedAndInternal", "ProtectedOrInternal")
KINDS = {"BUILDING": "Class", "AUTOMOBILE": "Struct", "FURNITURE": "Interface", "HOUSEHOLD": "Enum", "MACHINERY": "Delegate"}


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


@cache
def _schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def _table(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the schema of a symbol table; missing columns are null."""
    schema = _schema(name)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _id(prefix: str, key):
    return F.concat(F.lit(prefix), key.cast("string"))


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, wide: bool = False) -> dict[str, DataFrame]:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in SOURCES}
    parts = t["part"].count()
    orders = t["orders"].count()
    places = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # one row for each nation
    asm = t["region"].select(
        _id("", F.col("r_regionkey")).alias("asm_id"), F.col("r_name").alias("name"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".0.0.0")).alias("version"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit("neutral")).alias("culture"), F.encode("r_name", "UTF-8").alias("public_key_token"), F.lit(False).alias("is_interactive"), F.lit(True).alias("is_target"),
    )
    roots = t["region"].select(_id("r", F.col("r_regionkey")).alias("ns_id"), F.lit(None).cast("string").alias("parent_ns_id"), F.col("r_name").alias("name"), F.col("r_name").alias("full_name"))
    inner = places.select(_id("n", F.col("n_nationkey")).alias("ns_id"), _id("r", F.col("r_regionkey")).alias("parent_ns_id"), F.col("n_name").alias("name"), F.concat_ws(".", "r_name", "n_name").alias("full_name"))
    of_parts = t["part"].select(_id("P", F.col("p_partkey")).alias("ns_id"), F.lit("Parts").alias("parent_ns_id"), _id("P", F.col("p_partkey")).alias("name"), F.concat(F.lit("Parts.P"), F.col("p_partkey").cast("string")).alias("full_name"))
    top = spark.createDataFrame([("Parts", None, "Parts", "Parts"), ("Marks", None, "Marks", "Marks")], "ns_id string, parent_ns_id string, name string, full_name string")
    spaces = roots.unionByName(inner).unionByName(of_parts).unionByName(top).withColumn("is_global", F.lit(False))
    if wide:
        spaces = spaces.unionByName(spark.createDataFrame([("G", None, "", "", True)], spaces.schema))

    k = F.col("c_custkey")
    nested = (k % 3 == 0) & (k > 0)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    own = t["customer"].join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        _id("c", k).alias("type_id"), F.lit("named").alias("shape"), _id("", F.col("r_regionkey")).alias("asm_id"), _id("n", F.col("n_nationkey")).alias("ns_id"),
        F.when(nested, _id("c", F.floor(k / 10))).alias("containing_type_id"), F.col("c_name").alias("name"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("display_name"),
        kinds[F.col("c_mktsegment")].alias("type_kind"), _pick(ACCESS, k).alias("accessibility"), (k % 2 == 0).alias("is_abstract"), (k % 5 == 0).alias("is_sealed"), (k % 7 == 0).alias("is_static"),
        (kinds[F.col("c_mktsegment")].isin("Struct", "Enum")).alias("is_value_type"), (k % 11 == 0).alias("is_record"), (k % 13 == 0).alias("is_implicit"), F.lit("None").alias("special_type"),
        F.when(kinds[F.col("c_mktsegment")] == "Enum", _id("p", k % parts)).alias("enum_underlying_type_id"), F.when(k % 4 == 1, _id("c", F.floor(k / 7))).alias("base_type_id"), F.lit(0).alias("arity"), k.alias("walk_rank"),
    )
    p, arity = F.col("p_partkey"), (F.col("p_size") % 3).cast("int")
    full = F.concat_ws(".", F.concat(F.lit("Parts.P"), p.cast("string")), F.col("p_name"))
    common = [F.col("p_name").alias("name"), F.lit("Class").alias("type_kind"), F.lit("Public").alias("accessibility"), F.lit("None").alias("special_type")]
    defs = t["part"].select(_id("p", p).alias("type_id"), F.lit("named").alias("shape"), _id("P", p).alias("ns_id"), full.alias("display_name"), arity.alias("arity"), *common)
    made = t["part"].where(arity > 0).select(_id("q", p).alias("type_id"), F.lit("named").alias("shape"), _id("P", p).alias("ns_id"), full.alias("display_name"), arity.alias("arity"), _id("p", p).alias("original_def_id"), *common)
    arrays = t["part"].where(p % 5 == 0).select(_id("a", p).alias("type_id"), F.lit("array").alias("shape"), F.concat(full, F.lit("[]")).alias("display_name"), F.lit(1).alias("rank"), _id("p", p).alias("element_type_id"))
    pointers = t["part"].where(p % 7 == 0).select(_id("r", p).alias("type_id"), F.lit("pointer").alias("shape"), F.concat(full, F.lit("*")).alias("display_name"), _id("p", p).alias("element_type_id"))
    marks = t["supplier"].select(_id("s", F.col("s_suppkey")).alias("type_id"), F.lit("named").alias("shape"), F.lit("Marks").alias("ns_id"), F.concat(F.lit("Marks."), F.col("s_name")).alias("display_name"), F.lit(0).alias("arity"), F.col("s_name").alias("name"), F.lit("Class").alias("type_kind"), F.lit("Public").alias("accessibility"))
    types = _table(own, "types")
    if wide:
        types = types.withColumn("ns_id", F.when(F.col("walk_rank") % 10 == 7, "G").otherwise(F.col("ns_id"))).withColumn("special_type", F.when(F.col("walk_rank") == 4, "System_Object").otherwise(F.col("special_type")))
    for more in (defs, made, arrays, pointers, marks):
        types = types.unionByName(_table(more, "types"))
    args = t["part"].where(arity > 0).select(_id("q", p).alias("type_id"), F.posexplode(F.slice(F.array(_id("p", (p + 1) % parts), _id("p", (p + 2) % parts)), F.lit(1), arity)).alias("pos", "arg_type_id"))
    ifaces = t["customer"].where(k % 6 == 5).select(_id("c", k).alias("type_id"), F.lit(0).alias("pos"), _id("q", k % parts).alias("iface_type_id"), (k % parts).alias("_p"))
    ifaces = ifaces.join(t["part"].where(arity > 0).select(p.alias("_p")), "_p", "left_semi")
    tps = t["part"].where(arity > 0).select(F.lit("type").alias("owner_kind"), _id("p", p).alias("owner_id"), F.explode(F.sequence(F.lit(0), arity - 1)).alias("ordinal")).select(F.concat_ws("/", "owner_id", F.col("ordinal").cast("string")).alias("tp_id"), "owner_kind", "owner_id", "ordinal", F.concat(F.lit("T"), F.col("ordinal").cast("string")).alias("name"), F.lit("None").alias("variance"), (F.col("ordinal") == 0).alias("ref_constraint"))

    o, level = F.col("o_orderkey"), F.substring("o_orderpriority", F.lit(1), F.lit(1))
    kind = F.when(level.isin("1", "5"), "method").when(level == "2", "property").when(level == "3", "field").otherwise("event")
    members = t["orders"].select(
        _id("o", o).alias("member_id"), _id("c", F.col("o_custkey")).alias("type_id"), o.alias("pos"), kind.alias("member_kind"), F.when(level == "5", F.lit(".ctor")).otherwise(F.concat(F.lit("M"), o.cast("string"))).alias("name"),
        _pick(ACCESS, o).alias("accessibility"), (o % 17 == 0).alias("is_implicit"), F.when(level == "1", "Ordinary").when(level == "5", "Constructor").alias("method_kind"), (o % 2 == 0).alias("is_static"), (o % 3 == 0).alias("is_virtual"),
        (o % 5 == 0).alias("is_read_only"), F.when(level == "5", F.lit(True)).otherwise(o % 4 == 0).alias("returns_void"), _id("p", o % parts).alias("value_type_id"), (o % 6 == 0).alias("has_const"), F.when(o % 12 == 0, F.col("o_orderstatus")).alias("const_value"),
        (o % 2 == 1).alias("has_getter"), (o % 3 == 1).alias("has_setter"), F.lit("Public").alias("getter_acc"), F.lit("Private").alias("setter_acc"), (o % 7 == 1).alias("is_init_only"), F.lit(False).alias("is_indexer"), F.when((o % 9 == 0) & (o > 0), _id("o", F.floor(o / 9))).alias("overridden_member_id"),
    )
    indexer = (level == "2") & (o % 4 == 2) if wide else F.lit(False)
    if wide:
        members = members.withColumn("is_indexer", (F.col("member_kind") == "property") & (F.col("pos") % 4 == 2)).withColumn("name", F.when(F.col("is_indexer"), "this[]").otherwise(F.col("name")))
        members = members.withColumn("method_kind", F.when((F.col("method_kind") == "Ordinary") & (F.col("pos") % 19 == 0), "PropertyGet").otherwise(F.col("method_kind")))
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    items = t["lineitem"].withColumn("ordinal", F.row_number().over(at) - 1)
    methods = t["orders"].where(level.isin("1", "5") | indexer).select(o)
    generic = t["part"].select(p.alias("l_partkey"), arity.alias("arity"))
    params = items.join(methods, F.col("l_orderkey") == o, "left_semi").join(generic, "l_partkey").select(
        _id("o", F.col("l_orderkey")).alias("owner_member_id"), "ordinal", F.concat(F.lit("x"), F.col("ordinal").cast("string")).alias("name"), F.concat(F.when(F.col("arity") > 0, "q").otherwise("p"), F.col("l_partkey").cast("string")).alias("type_id"),
        F.when(F.col("l_returnflag") == "A", "Ref").when(F.col("l_returnflag") == "R", "Out").when(F.lit(wide) & (F.col("l_linenumber") == 2), "In").otherwise("None").alias("ref_kind"), (F.col("l_linenumber") == 1).alias("is_optional"), (F.col("l_linenumber") % 3 == 0).alias("has_default"), F.when(F.col("l_linenumber") == 3, F.col("l_linestatus")).alias("default_value"),
    )
    kinds_of = t["orders"].select(o.alias("l_orderkey"), kind.alias("target_kind"))
    const = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.array().cast("array<string>").alias("items"))
    attributes = items.join(kinds_of, "l_orderkey").select(
        "l_linenumber", "l_returnflag", "l_linestatus", "target_kind", _id("o", F.col("l_orderkey")).alias("target_id"), F.col("ordinal").alias("pos"), F.lit(False).alias("is_return"), F.when(F.col("l_suppkey") % 5 != 4, _id("s", F.col("l_suppkey"))).alias("class_type_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(const("string", F.col("l_returnflag")), const("other", F.col("l_linenumber").cast("string")))).alias("ctor_args"),
        F.when(F.col("l_linenumber") == 5, F.array(F.struct(F.lit("Key").alias("key"), const("type", F.col("l_linestatus")).alias("value")))).alias("named_args"),
    )
    if wide:
        both = F.struct(F.lit("array").alias("kind"), F.lit(None).cast("string").alias("text"), F.array("l_returnflag", "l_linestatus").alias("items"))
        given = F.when(F.col("l_linenumber") == 3, F.array(both, const("null", F.lit(None).cast("string"))))
        attributes = attributes.withColumn("ctor_args", F.coalesce("ctor_args", given)).withColumn("is_return", F.coalesce(F.col("l_linenumber") == 6, F.lit(False)) & (F.col("target_kind") == "method"))
    e = F.col("event_id")
    target = F.concat(F.lit("T:Parts.P"), p.cast("string"), F.lit("."), F.col("p_name"), F.when(arity > 0, F.concat(F.lit("`"), arity.cast("string"))).otherwise(F.lit("")))
    docs = t["events"].where(F.col("event_type").isin("error", "view")).withColumn("p_partkey", F.col("user_id") % parts).join(t["part"], "p_partkey").select(
        F.lit("member").alias("owner_kind"), _id("o", e % orders).alias("owner_id"),
        F.concat(F.lit("<doc><"), F.when(F.col("event_type") == "error", "exception").otherwise("seealso"), F.lit(' cref="'), target, F.when(e % 10 == 3, F.lit('">')).otherwise(F.lit('"/></doc>'))).alias("xml"),
    )
    limits, impls = spark.createDataFrame([], TABLES["tp_constr"]), spark.createDataFrame([], TABLES["member_impls"])
    if wide:
        takes = t["orders"].where(level.isin("1", "5") & (o % 4 == 1))
        on_methods = takes.select(F.concat(_id("o", o), F.lit("/0")).alias("tp_id"), F.lit("method").alias("owner_kind"), _id("o", o).alias("owner_id"), F.lit("None").alias("variance"))
        on_types = t["customer"].where(k % 8 == 1).select(F.concat(_id("c", k), F.lit("/0")).alias("tp_id"), F.lit("type").alias("owner_kind"), _id("c", k).alias("owner_id"), F.lit("Out").alias("variance"))
        more = on_methods.unionByName(on_types).select("*", F.lit(0).alias("ordinal"), F.lit("T0").alias("name"), F.lit(True).alias("ref_constraint"))
        tps = _table(tps, "type_params").unionByName(_table(more, "type_params"))
        limits = takes.select(F.concat(_id("o", o), F.lit("/0")).alias("tp_id"), F.posexplode(F.array_compact(F.array(_id("p", (o + 1) % parts), F.when(o % 8 == 1, _id("p", (o + 2) % parts))))).alias("pos", "type_id"))
        limits = limits.unionByName(t["customer"].where(k % 8 == 1).select(F.concat(_id("c", k), F.lit("/0")).alias("tp_id"), F.lit(0).alias("pos"), _id("c", F.floor(k / 2)).alias("type_id")))
        impls = t["orders"].where(o % 10 == 3).select(_id("o", o).alias("member_id"), F.lit(0).alias("pos"), _id("o", F.floor(o / 2)).alias("impl_member_id"))
        named = t["customer"].where(~nested & (k % 10 != 7)).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("o_custkey"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("of"))
        named = t["orders"].where(level == "1").join(named, "o_custkey").select(o, F.concat(F.lit("M:"), "of", F.lit(".M"), o.cast("string")).alias("cref"))
        links = t["events"].where("event_type = 'click'").withColumn("o_orderkey", e % orders).join(named, "o_orderkey")
        links = links.select(F.lit("member").alias("owner_kind"), _id("o", (e + 1) % orders).alias("owner_id"), F.concat(F.lit('<doc><seealso cref="'), "cref", F.lit('"/></doc>')).alias("xml"))
        docs = docs.unionByName(links)
    return {
        "assemblies": _table(asm, "assemblies"), "namespaces": _table(spaces, "namespaces"), "types": types, "type_ifaces": _table(ifaces, "type_ifaces"), "type_args": _table(args, "type_args"), "type_params": _table(tps, "type_params"), "tp_constr": _table(limits, "tp_constr"),
        "members": _table(members, "members"), "member_impls": _table(impls, "member_impls"), "params": _table(params, "params"), "attributes": _table(attributes, "attributes"), "docs": _table(docs, "docs"),
    }
