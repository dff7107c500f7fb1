"""Schemas of the symbol tables and of triples."""

from __future__ import annotations

from symloom import vocab


def _flags(pairs) -> str:
    return ", ".join(f"{column} boolean" for _, column in pairs)


_member = dict.fromkeys(column for group in (vocab.METHOD_FLAGS, vocab.PROPERTY_FLAGS, vocab.FIELD_FLAGS, vocab.EVENT_FLAGS) for _, column in group)

TRIPLE = "subject string, predicate string, object string, is_iri boolean, datatype string"
TABLES = {
    "assemblies": "asm_id string, name string, version string, culture string, public_key_token binary, is_interactive boolean, is_target boolean",
    "namespaces": "ns_id string, parent_ns_id string, name string, full_name string, is_global boolean",
    "types": f"type_id string, shape string, asm_id string, ns_id string, containing_type_id string, name string, display_name string, type_kind string, accessibility string, {_flags(vocab.TYPE_FLAGS)}, is_implicit boolean, special_type string, enum_underlying_type_id string, base_type_id string, original_def_id string, is_unbound boolean, arity int, rank int, element_type_id string, owner_name string, walk_rank long",
    "type_ifaces": "type_id string, pos int, iface_type_id string",
    "type_args": "type_id string, pos int, arg_type_id string",
    "type_params": f"tp_id string, owner_kind string, owner_id string, ordinal int, name string, variance string, {_flags(vocab.TYPE_PARAM_FLAGS)}",
    "tp_constr": "tp_id string, pos int, type_id string",
    "members": f"member_id string, type_id string, pos long, member_kind string, name string, accessibility string, is_implicit boolean, method_kind string, {', '.join(f'{c} boolean' for c in _member)}, returns_void boolean, value_type_id string, const_value string, has_const boolean, getter_acc string, setter_acc string, is_init_only boolean, is_indexer boolean, overridden_member_id string",
    "member_impls": "member_id string, pos int, impl_member_id string",
    "params": f"owner_member_id string, ordinal int, name string, type_id string, ref_kind string, {_flags(vocab.PARAM_FLAGS)}, has_default boolean, default_value string",
    "attributes": "target_kind string, target_id string, pos int, is_return boolean, class_type_id string, ctor_args array<struct<kind:string,text:string,items:array<string>>>, named_args array<struct<key:string,value:struct<kind:string,text:string,items:array<string>>>>",
    "docs": "owner_kind string, owner_id string, xml string",
    "manifest": "assembly string, name string, version string, culture string, public_key_token binary",
}
