"""Identity of graph nodes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_of(uri: str) -> str:
    return uri.rstrip("/")


def escape(text: Column) -> Column:
    """Keeps letters, decimal digits and ``-_.~``; the rest is percent-encoded UTF-8 in upper hex.

    A character outside the basic plane counts as two unpaired halves, each of which is encoded
    as the replacement character.  Plain and ASCII texts, the usual case, skip the loop over characters.
    """
    one = lambda c: (
        F.when(F.octet_length(c) == 4, F.lit("%EF%BF%BD%EF%BF%BD")).when(F.rlike(c, F.lit(r"^[\p{L}\p{Nd}._~-]$")), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    )
    slow = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
    ascii_ = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.rlike(text, F.lit(r"^[a-zA-Z0-9._~-]*$")), text).when(F.rlike(text, F.lit(r"^\p{ASCII}*$")), ascii_).otherwise(slow)


def term(base: str, name: str) -> Column:
    return F.lit(f"{base_of(base)}/ontology/{name}")


def assembly_iri(base: str, name: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{base_of(base)}/assembly"), escape(name), escape(version))


def namespace_iri(base: str, full_name: Column, is_global: Column) -> Column:
    return F.concat(F.lit(f"{base_of(base)}/namespace/"), F.when(is_global, F.lit("_global_")).otherwise(escape(full_name)))


def type_iri(base: str, asm_name: Column, asm_version: Column, meta_name: Column) -> Column:
    """Types without an assembly stand under ``_builtin_``."""
    return type_iri_under(base, type_head(asm_name, asm_version), meta_name)


def type_head(asm_name: Column, asm_version: Column) -> Column:
    return F.when(asm_name.isNull(), F.lit("_builtin_")).otherwise(F.concat_ws("/", escape(asm_name), escape(asm_version)))


def type_iri_under(base: str, head: Column, meta_name: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{base_of(base)}/type"), head, escape(meta_name))


def arity_suffix(arity: Column, args: Column) -> Column:
    """`` `n`` of generic types, and ``[a,b]`` unless all arguments are type parameters.

    ``args``: array of (pos, meta_name, is_param) in order, null or empty for definitions.
    """
    given = F.exists(args, lambda a: ~a["is_param"])
    names = F.array_join(F.transform(args, lambda a: a["meta_name"]), ",")
    return F.when(F.coalesce(arity, F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit("`"), arity.cast("string"), F.when(given, F.concat(F.lit("["), names, F.lit("]"))).otherwise(F.lit(""))))


def signature(member_kind: Column, is_indexer: Column, params: Column) -> Column:
    """``(A,ref B,out C,in D)`` of methods, ``[A,B]`` of indexers; else empty.

    ``params``: array of (ordinal, ref_kind, meta_name) in order.
    """
    mark = lambda p: F.when(p["ref_kind"] == "Ref", F.lit("ref ")).when(p["ref_kind"] == "Out", F.lit("out ")).when(p["ref_kind"] == "In", F.lit("in ")).otherwise(F.lit(""))
    own = F.coalesce(params, F.array().cast("array<struct<ordinal:int,ref_kind:string,meta_name:string>>"))
    method = F.concat(F.lit("("), F.array_join(F.transform(own, lambda p: F.concat(mark(p), p["meta_name"])), ","), F.lit(")"))
    indexer = F.concat(F.lit("["), F.array_join(F.transform(own, lambda p: p["meta_name"]), ","), F.lit("]"))
    return F.when(member_kind == "method", method).when((member_kind == "property") & F.coalesce(is_indexer, F.lit(False)), indexer).otherwise(F.lit(""))


def member_iri(owner_iri: Column, name: Column, sig: Column) -> Column:
    """The signature is not escaped."""
    return F.concat(owner_iri, F.lit("/member/"), escape(name), sig)


def parameter_iri(owner_iri: Column, ordinal: Column) -> Column:
    return F.concat(owner_iri, F.lit("/param/"), ordinal.cast("string"))


def type_parameter_iri(owner_kind: Column, owner_iri: Column, ordinal: Column) -> Column:
    """Owners are types and methods; any other kind is an error."""
    bad = F.raise_error(F.concat(F.lit("type parameter owner must be a type or a method: "), owner_kind))
    return F.when(owner_kind.isin("type", "method"), F.concat(owner_iri, F.lit("/typeparam/"), ordinal.cast("string"))).otherwise(bad)


ATTRIBUTE_TARGETS = ("assembly", "type", "method", "property", "field", "event", "parameter")


def attribute_iri(target_kind: Column, target_iri: Column, index: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("attributes of this kind of target have no IRI: "), target_kind))
    return F.when(target_kind.isin(*ATTRIBUTE_TARGETS), F.concat(target_iri, F.lit("/attr/"), index.cast("string"))).otherwise(bad)


def type_class(type_kind: Column, is_record: Column) -> Column:
    """Records first, then the kind; ``Type`` for kinds without a class."""
    return F.when(F.coalesce(is_record, F.lit(False)), F.lit("Record")).when(type_kind.isin("Class", "Struct", "Interface", "Enum", "Delegate"), type_kind).otherwise(F.lit("Type"))


def constant_text(value: Column) -> Column:
    """Text of a struct (kind, text, items): null, array, type, string, or as it is."""
    return (
        F.when(value.isNull() | (value["kind"] == "null"), F.lit("null"))
        .when(value["kind"] == "array", F.concat(F.lit("["), F.array_join(value["items"], ", "), F.lit("]")))
        .when(value["kind"] == "type", F.concat(F.lit("typeof("), value["text"], F.lit(")")))
        .when(value["kind"] == "string", F.concat(F.lit('"'), value["text"], F.lit('"')))
        .otherwise(value["text"])
    )


def key_token_hex(token: Column) -> Column:
    return F.lower(F.hex(token))
