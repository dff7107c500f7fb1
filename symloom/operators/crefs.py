"""Documentation references resolved to types and members, by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import docs as D
from symloom.staging import near, stage


def references(docs: DataFrame, element: str) -> DataFrame:
    """owner_kind, owner_id, pos, cref of an element, in document order; malformed documents give none."""
    return docs.select("owner_kind", "owner_id", F.posexplode(D.crefs(F.col("xml"), element)).alias("pos", "cref"))


def resolve(crefs: DataFrame, types: DataFrame, members: DataFrame | Callable[[bool], DataFrame] | None) -> DataFrame:
    """cref, target_kind ('type' or a member kind), target_id of distinct crefs; unresolved ones have no row.

    ``types``: type_id, lookup_name (nested by ``+``).  ``members``: member_id, type_id, name,
    member_kind, pos, param_names (array of qualified names; null for non-methods).

    T is a type, M, P, F and E a member, no prefix a type or else a member.  A name that several
    types have resolves to none.  A method's parameter list picks the overload of equal count
    and names, each qualified or short; without list, or where none fits, the first by
    declaration order is taken.  ``members`` may be a function that makes them, called if any member
    of a known type is asked for, and told whether any parameter list is; without it types alone
    are looked up.
    """
    one = crefs.select("cref").distinct().withColumn("prefix", D.cref_prefix(F.col("cref"))).withColumn("name", D.cref_name(F.col("cref")))
    unique = types.groupBy("lookup_name").agg(F.count(F.lit(1)).alias("n"), F.first("type_id").alias("type_id")).where("n = 1").select("lookup_name", "type_id")
    as_type = one.where("prefix = 'T' or prefix is null").join(unique, F.col("name") == F.col("lookup_name")).select("cref", F.lit("type").alias("target_kind"), F.col("type_id").alias("target_id"))
    if members is None:
        return as_type

    owner, member, inside = D.cref_owner_member(F.col("name"))
    plain_dot = F.length("name") - F.instr(F.reverse(F.col("name")), ".") + 1
    has_dot = F.instr("name", ".") > 0
    is_method = F.coalesce(F.col("prefix"), F.lit("M")) == "M"
    wanted = one.where("prefix in ('M', 'P', 'F', 'E') or prefix is null").select(
        "cref",
        F.when(is_method, owner).otherwise(F.when(has_dot, F.substring("name", F.lit(1), plain_dot - 1))).alias("owner"),
        F.when(is_method, member).otherwise(F.when(has_dot, F.replace(F.substring("name", plain_dot + 1, F.length("name")), F.lit("#"), F.lit(".")))).alias("member"),
        F.when(is_method, inside).alias("inside"),
    )
    wanted = stage(wanted.join(unique, F.col("owner") == F.col("lookup_name")).select("cref", "type_id", "member", "inside").where("member is not null"))
    if wanted.isEmpty():
        return as_type
    wanted = wanted.withColumn("asked", F.when(F.col("inside").isNotNull(), D.split_params(F.col("inside"))))
    theirs = (members(not wanted.where("inside is not null").isEmpty()) if callable(members) else members).select("type_id", "member_id", F.col("name").alias("member"), "member_kind", "pos", "param_names")
    found = wanted.join(near(theirs, wanted.select("type_id", "member")), ["type_id", "member"])
    names = F.coalesce("param_names", F.array().cast("array<string>"))
    either = F.arrays_zip(F.col("asked").alias("asked"), names.alias("name"))
    fits = F.when(F.col("asked").isNotNull(), (F.size("asked") == F.size(names)) & F.forall(either, lambda p: (p["asked"] == p["name"]) | (p["asked"] == D.short_name(p["name"])))).otherwise(F.lit(False))
    best = Window.partitionBy("cref").orderBy(F.when(fits, 0).otherwise(1), "pos", "member_id")
    as_member = found.withColumn("r", F.row_number().over(best)).where("r = 1").select("cref", F.col("member_kind").alias("target_kind"), F.col("member_id").alias("target_id"))
    return as_type.unionByName(as_member.join(as_type.select("cref"), "cref", "left_anti"))


def exception_types(docs: DataFrame, types: DataFrame) -> DataFrame:
    """owner_kind, owner_id, pos, target_id: types only; duplicates and document order stay."""
    refs = references(docs, "exception")
    return refs.join(resolve(refs, types, None), "cref").select("owner_kind", "owner_id", "pos", "target_id")


def see_also(docs: DataFrame, types: DataFrame, members: Callable[[bool], DataFrame]) -> DataFrame:
    """owner_kind, owner_id, pos, target_kind, target_id."""
    refs = references(docs, "seealso")
    return refs.join(resolve(refs, types, members), "cref").select("owner_kind", "owner_id", "pos", "target_kind", "target_id")
