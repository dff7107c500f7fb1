"""Visibility and kind filters; expressions only, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.options import ExtractionOptions

# Kinds of methods that are members of the graph.
METHOD_KINDS = ("Ordinary", "Constructor", "StaticConstructor", "Destructor", "UserDefinedOperator", "Conversion")


def visible(accessibility: Column, is_implicit: Column, o: ExtractionOptions) -> Column:
    """The rule for types and members alike; protected and unknown accessibilities always pass."""
    ok = F.lit(True)
    if not o.include_compiler_generated:
        ok = ok & ~F.coalesce(is_implicit, F.lit(False))
    hidden = ([] if o.include_private else ["Private"]) + ([] if o.include_internal else ["Internal", "ProtectedAndInternal"])
    return ok & ~F.coalesce(accessibility, F.lit("")).isin(*hidden) if hidden else ok


def visible_types(types: DataFrame, o: ExtractionOptions) -> DataFrame:
    """Not hierarchical: a nested type is judged alone, whatever its outer type."""
    return types.where(visible(F.col("accessibility"), F.col("is_implicit"), o))


def visible_members(members: DataFrame, o: ExtractionOptions) -> DataFrame:
    kinds = F.col("member_kind").isin("property", "field", "event") | ((F.col("member_kind") == "method") & F.col("method_kind").isin(*METHOD_KINDS))
    return members.where(kinds & visible(F.col("accessibility"), F.col("is_implicit"), o))


def constructed(generic_arity: Column, is_unbound: Column, original_def: Column, own: Column) -> Column:
    return (F.coalesce(generic_arity, F.lit(0)) > 0) & ~F.coalesce(is_unbound, F.lit(False)) & original_def.isNotNull() & (original_def != own)
