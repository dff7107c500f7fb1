"""Terms of the emitted graph, and the classes' hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"
XSD_BOOLEAN, XSD_INTEGER, XSD_LONG = XSD + "boolean", XSD + "integer", XSD + "long"
PREFIX = "dt"

# Classes, then the classes' parents.
CLASSES = ("Assembly", "Namespace", "Type", "Class", "Struct", "Interface", "Enum", "Delegate", "Record", "Member", "Method", "Constructor", "Property", "Field", "Event", "Parameter", "TypeParameter", "Attribute")
PARENTS = {"Class": "Type", "Struct": "Type", "Interface": "Type", "Enum": "Type", "Delegate": "Type", "Record": "Type", "Method": "Member", "Constructor": "Member", "Property": "Member", "Field": "Member", "Event": "Member"}
# Flags, in order of emission, with the symbol tables' column for each.
TYPE_FLAGS = (("isAbstract", "is_abstract"), ("isSealed", "is_sealed"), ("isStatic", "is_static"), ("isGeneric", "is_generic"), ("isValueType", "is_value_type"), ("isRecord", "is_record"), ("isRefLikeType", "is_ref_like"), ("isReadOnly", "is_read_only"), ("isUnmanagedType", "is_unmanaged"))
METHOD_FLAGS = (("isStatic", "is_static"), ("isAbstract", "is_abstract"), ("isVirtual", "is_virtual"), ("isOverride", "is_override"), ("isSealed", "is_sealed"), ("isExtern", "is_extern"), ("isAsync", "is_async"), ("isExtensionMethod", "is_extension"), ("isPartialDefinition", "is_partial"), ("isReadOnly", "is_read_only"))
PROPERTY_FLAGS = (("isStatic", "is_static"), ("isAbstract", "is_abstract"), ("isVirtual", "is_virtual"), ("isOverride", "is_override"), ("isSealed", "is_sealed"), ("isRequired", "is_required"), ("hasGetter", "has_getter"), ("hasSetter", "has_setter"))
FIELD_FLAGS = (("isStatic", "is_static"), ("isReadOnly", "is_read_only"), ("isConst", "is_const"), ("isVolatile", "is_volatile"), ("isRequired", "is_required"))
EVENT_FLAGS = (("isStatic", "is_static"), ("isAbstract", "is_abstract"), ("isVirtual", "is_virtual"), ("isOverride", "is_override"), ("isSealed", "is_sealed"))
PARAM_FLAGS = (("isOptional", "is_optional"), ("isParams", "is_params"), ("isThis", "is_this"), ("isDiscard", "is_discard"))
TYPE_PARAM_FLAGS = (("hasReferenceTypeConstraint", "ref_constraint"), ("hasValueTypeConstraint", "value_constraint"), ("hasUnmanagedTypeConstraint", "unmanaged_constraint"), ("hasNotNullConstraint", "not_null_constraint"), ("hasConstructorConstraint", "ctor_constraint"))
# Standard prefixes, in order.
PREFIXES = (("rdf", RDF), ("rdfs", RDFS), ("xsd", XSD))


def class_table(spark: SparkSession) -> DataFrame:
    """class, parent (null at the top); 18 rows, so it may always be broadcast."""
    return spark.createDataFrame([(c, PARENTS.get(c)) for c in CLASSES], "class string, parent string")
