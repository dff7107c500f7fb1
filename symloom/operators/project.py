"""Entities to triples: one scan of an entity's rows yields all of its triples.

Every function takes rows whose references are IRIs already and returns
(subject, predicate, object, is_iri, datatype).  Optional parts are null objects, dropped last.
Rows may be a function without arguments that makes them; it is called if any triple is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom import vocab
from symloom.functions import identity as I
from symloom.options import ExtractionOptions


Rows = DataFrame | Callable[[], DataFrame]


class Terms:
    """Builds triples of one base URI.

    ``only`` (IRI of a predicate to a class asked for, or None for any object) keeps what a reader
    doesn't ask for from being made: such triples are None.  ``columns`` are those it reads.
    """

    def __init__(self, options: ExtractionOptions, only: dict[str, str | None] | None = None, columns: tuple[str, ...] = ("subject", "predicate", "object", "is_iri", "datatype")):
        self.base, self.only, self.columns = options.base_uri, only, columns

    def term(self, name: str) -> str:
        return f"{I.base_of(self.base)}/ontology/{name}"

    def wants(self, *names: str) -> bool:
        return self.only is None or any(self.term(n) in self.only for n in names)

    def _t(self, s: Column, p: str, o: Column, is_iri: bool, datatype: str | None) -> Column | None:
        if self.only is not None and p not in self.only:
            return None
        parts = {"subject": s, "predicate": F.lit(p), "object": o.cast("string"), "is_iri": F.lit(is_iri), "datatype": F.lit(datatype).cast("string")}
        return F.struct(*[c.alias(name) for name, c in parts.items() if name in self.columns])

    def a(self, s: Column, name: str | Column) -> Column | None:
        asked = (self.only or {}).get(vocab.RDF_TYPE)
        if asked is not None and isinstance(name, str) and asked != self.term(name):
            return None
        cls = I.term(self.base, name) if isinstance(name, str) else F.concat(I.term(self.base, ""), name)
        return self._t(s, vocab.RDF_TYPE, cls, True, None)

    def iri(self, s: Column, name: str, o: Column) -> Column | None:
        return self._t(s, self.term(name), o, True, None)

    def lit(self, s: Column, name: str, o: Column) -> Column | None:
        return self._t(s, self.term(name), o, False, None)

    def bool(self, s: Column, name: str, o: Column) -> Column | None:
        return self._t(s, self.term(name), F.coalesce(o, F.lit(False)).cast("string"), False, vocab.XSD_BOOLEAN)

    def int(self, s: Column, name: str, o: Column) -> Column | None:
        return self._t(s, self.term(name), o.cast("string"), False, vocab.XSD_INTEGER)

    def flags(self, s: Column, pairs: Iterable[tuple[str, str]]) -> list[Column | None]:
        return [self.bool(s, name, F.col(column)) for name, column in pairs]


def emit(rows: Rows, triples: list[Column | None], where: str | None = None) -> DataFrame | None:
    """Triples of ``rows``; None where none is wanted."""
    wanted = [x for x in triples if x is not None]
    if not wanted:
        return None
    rows = rows() if callable(rows) else rows
    return (rows.where(where) if where else rows).select(F.inline(F.array(*wanted))).where("object is not null")


def union(*bags: DataFrame | None) -> DataFrame | None:
    out = None
    for b in bags:
        out = b if out is None else out if b is None else out.unionByName(b)
    return out


def assemblies(rows: Rows, t: Terms) -> DataFrame | None:
    """Target assemblies: iri, name, version, culture, public_key_token, is_interactive."""
    s = F.col("iri")
    return emit(
        rows,
        [
            t.a(s, "Assembly"),
            t.lit(s, "name", F.col("name")),
            t.lit(s, "version", F.col("version")),
            t.lit(s, "culture", F.when(F.col("culture") != "", F.col("culture"))),
            t.lit(s, "publicKeyToken", F.when(F.octet_length("public_key_token") > 0, I.key_token_hex(F.col("public_key_token")))),
            t.bool(s, "isInteractive", F.col("is_interactive")),
        ],
        "is_target",
    )


def namespaces(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, name, full_name, parent_iri (null under the global namespace)."""
    s = F.col("iri")
    return emit(rows, [t.a(s, "Namespace"), t.lit(s, "name", F.col("name")), t.lit(s, "fullName", F.col("full_name")), t.iri(s, "parentNamespace", F.col("parent_iri"))])


def types(rows: Rows, t: Terms) -> DataFrame | None:
    """Full types: iri, own columns, and asm_iri, ns_iri, base_iri, base_special, outer_iri, enum_iri (null where absent)."""
    s = F.col("iri")
    return emit(
        rows,
        [
            t.a(s, "Type"),
            t.a(s, I.type_class(F.col("type_kind"), F.col("is_record"))),
            t.lit(s, "name", F.col("name")),
            t.lit(s, "fullName", F.col("display_name")),
            t.lit(s, "typeKind", F.col("type_kind")),
            t.lit(s, "accessibility", F.col("accessibility")),
            *t.flags(s, vocab.TYPE_FLAGS),
            t.lit(s, "specialType", F.when(F.col("special_type") != "None", F.col("special_type"))),
            t.iri(s, "enumUnderlyingType", F.when(F.col("type_kind") == "Enum", F.col("enum_iri"))),
            t.iri(s, "definedInAssembly", F.col("asm_iri")),
            t.iri(s, "inNamespace", F.col("ns_iri")),
            t.iri(s, "inherits", F.when(F.coalesce("base_special", F.lit("")) != "System_Object", F.col("base_iri"))),
            t.iri(s, "nestedIn", F.col("outer_iri")),
        ],
    )


def implements(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, iface_iri."""
    return emit(rows, [t.iri(F.col("iri"), "implements", F.col("iface_iri"))])


def stub_types(rows: Rows, t: Terms) -> DataFrame | None:
    """Named types that are only mentioned: iri, name, display_name, type_kind, asm_iri, ns_iri."""
    s = F.col("iri")
    return emit(
        rows,
        [
            t.a(s, "Type"),
            t.lit(s, "name", F.col("name")),
            t.lit(s, "fullName", F.col("display_name")),
            t.lit(s, "typeKind", F.col("type_kind")),
            t.iri(s, "definedInAssembly", F.col("asm_iri")),
            t.iri(s, "inNamespace", F.col("ns_iri")),
        ],
    )


def stub_arrays(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, display_name, rank, element_iri."""
    s = F.col("iri")
    return emit(rows, [t.a(s, "Type"), t.lit(s, "name", F.col("display_name")), t.lit(s, "typeKind", F.lit("Array")), t.int(s, "arrayRank", F.col("rank")), t.iri(s, "arrayElementType", F.col("element_iri"))])


def stub_pointers(rows: Rows, t: Terms) -> DataFrame | None:
    s = F.col("iri")
    return emit(rows, [t.a(s, "Type"), t.lit(s, "name", F.col("display_name")), t.lit(s, "typeKind", F.lit("Pointer")), t.iri(s, "pointerElementType", F.col("element_iri"))])


def generic_definitions(rows: Rows, t: Terms) -> DataFrame | None:
    """Constructed types: iri, def_iri."""
    return emit(rows, [t.iri(F.col("iri"), "genericDefinition", F.col("def_iri"))])


def generic_arguments(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, pos, arg_iri: each argument is a node with its place."""
    s, node = F.col("iri"), F.concat(F.col("iri"), F.lit("/typearg/"), F.col("pos").cast("string"))
    return emit(rows, [t.iri(s, "typeArgument", node), t.int(node, "index", F.col("pos")), t.iri(node, "type", F.col("arg_iri"))])


def type_parameters(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, owner_iri and own columns."""
    s = F.col("iri")
    return emit(
        rows,
        [
            t.a(s, "TypeParameter"),
            t.lit(s, "name", F.col("name")),
            t.int(s, "ordinal", F.col("ordinal")),
            t.lit(s, "variance", F.col("variance")),
            *t.flags(s, vocab.TYPE_PARAM_FLAGS),
            t.iri(F.col("owner_iri"), "hasTypeParameter", s),
            t.iri(s, "typeParameterOf", F.col("owner_iri")),
        ],
    )


def constraints(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, constraint_iri."""
    return emit(rows, [t.iri(F.col("iri"), "constrainedToType", F.col("constraint_iri"))])


def _membership(t: Terms) -> list[Column]:
    return [t.iri(F.col("type_iri"), "hasMember", F.col("iri")), t.iri(F.col("iri"), "memberOf", F.col("type_iri"))]


def _heading(t: Terms, cls: str | Column) -> list[Column]:
    s = F.col("iri")
    return [t.a(s, "Member"), t.a(s, cls), t.lit(s, "name", F.col("name")), t.lit(s, "accessibility", F.col("accessibility"))]


def methods(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, type_iri, value_iri and own columns."""
    s = F.col("iri")
    cls = F.when(F.col("method_kind").isin("Constructor", "StaticConstructor"), F.lit("Constructor")).otherwise(F.lit("Method"))
    return emit(
        rows,
        [*_heading(t, cls), t.lit(s, "methodKind", F.col("method_kind")), *t.flags(s, vocab.METHOD_FLAGS), *_membership(t), t.iri(s, "returnType", F.when(~F.coalesce("returns_void", F.lit(False)), F.col("value_iri")))],
        "member_kind = 'method'",
    )


def properties(rows: Rows, t: Terms) -> DataFrame | None:
    s = F.col("iri")
    setter = F.coalesce("has_setter", F.lit(False))
    init = t._t(s, t.term("isInitOnly"), F.when(setter, F.coalesce("is_init_only", F.lit(False)).cast("string")), False, vocab.XSD_BOOLEAN)
    return emit(
        rows,
        [
            *_heading(t, "Property"),
            *t.flags(s, vocab.PROPERTY_FLAGS),
            t.lit(s, "getterAccessibility", F.when(F.coalesce("has_getter", F.lit(False)), F.col("getter_acc"))),
            t.lit(s, "setterAccessibility", F.when(setter, F.col("setter_acc"))),
            init,
            *_membership(t),
            t.iri(s, "propertyType", F.col("value_iri")),
        ],
        "member_kind = 'property'",
    )


def fields(rows: Rows, t: Terms) -> DataFrame | None:
    s = F.col("iri")
    const = F.when(F.coalesce("has_const", F.lit(False)), F.coalesce("const_value", F.lit("null")))
    return emit(rows, [*_heading(t, "Field"), *t.flags(s, vocab.FIELD_FLAGS), t.lit(s, "constValue", const), *_membership(t), t.iri(s, "fieldType", F.col("value_iri"))], "member_kind = 'field'")


def events(rows: Rows, t: Terms) -> DataFrame | None:
    s = F.col("iri")
    return emit(rows, [*_heading(t, "Event"), *t.flags(s, vocab.EVENT_FLAGS), *_membership(t), t.iri(s, "eventType", F.col("value_iri"))], "member_kind = 'event'")


def overrides(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, overridden_iri of methods, properties and events."""
    return emit(rows, [t.iri(F.col("iri"), "overridesMethod", F.col("overridden_iri"))])


def explicit_implementations(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, impl_iri; fields have none."""
    return emit(rows, [t.iri(F.col("iri"), "explicitInterfaceImplementation", F.col("impl_iri"))], "member_kind <> 'field'")


def parameters(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, owner_iri, value_iri and own columns."""
    s = F.col("iri")
    default = F.when(F.coalesce("has_default", F.lit(False)), F.coalesce("default_value", F.lit("null")))
    return emit(
        rows,
        [
            t.a(s, "Parameter"),
            t.lit(s, "name", F.col("name")),
            t.int(s, "ordinal", F.col("ordinal")),
            *t.flags(s, vocab.PARAM_FLAGS),
            t.lit(s, "refKind", F.col("ref_kind")),
            t.bool(s, "hasExplicitDefaultValue", F.col("has_default")),
            t.lit(s, "defaultValue", default),
            t.iri(F.col("owner_iri"), "hasParameter", s),
            t.iri(s, "parameterOf", F.col("owner_iri")),
            t.iri(s, "parameterType", F.col("value_iri")),
        ],
    )


def attributes(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, target_iri, class_iri (null: skipped, but its index is used up), ctor_args, named_args."""
    s = F.col("iri")
    ctor = F.when(F.size("ctor_args") > 0, F.array_join(F.transform("ctor_args", I.constant_text), ", "))
    named = F.when(F.size("named_args") > 0, F.array_join(F.transform("named_args", lambda a: F.concat(a["key"], F.lit("="), I.constant_text(a["value"]))), ", "))
    return emit(
        rows,
        [t.a(s, "Attribute"), t.iri(F.col("target_iri"), "hasAttribute", s), t.iri(s, "attributeOf", F.col("target_iri")), t.iri(s, "attributeType", F.col("class_iri")), t.lit(s, "constructorArguments", ctor), t.lit(s, "namedArguments", named)],
        "class_iri is not null",
    )


def throws(rows: Rows, t: Terms) -> DataFrame | None:
    """iri, object_iri; duplicates stay."""
    return emit(rows, [t.iri(F.col("iri"), "throws", F.col("object_iri"))])


def related(rows: Rows, t: Terms) -> DataFrame | None:
    return emit(rows, [t.iri(F.col("iri"), "relatedTo", F.col("object_iri"))])
