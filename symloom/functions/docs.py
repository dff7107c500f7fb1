"""Documentation XML and cref strings, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crefs(xml: Column, element: str) -> Column:
    """``cref`` values of an element at any depth, in document order; null for blank or malformed XML.

    ``xpath`` fails the job on malformed input, so a permissive parse looks first.
    """
    broken = F.from_xml(xml, "_broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})["_broken"]
    return F.when((F.trim(xml) != "") & broken.isNull(), F.filter(F.xpath(xml, F.lit(f"//{element}/@cref")), lambda c: c != ""))


def cref_prefix(cref: Column) -> Column:
    """What stands before the first colon, if that is the second or third character."""
    at = F.instr(cref, ":")
    return F.when(at.isin(2, 3), F.substring(cref, F.lit(1), at - 1))


def cref_name(cref: Column) -> Column:
    at = F.instr(cref, ":")
    return F.when(at.isin(2, 3), F.substring(cref, at + 1, F.length(cref))).otherwise(cref)


def cref_owner_member(name: Column) -> tuple[Column, Column, Column]:
    """Type, member (``#`` stands for a dot) and parameter list (null if none) of a method's name."""
    head, tail = F.substring_index(name, "(", 1), F.instr(name, "(")
    inside = F.when(tail > 0, F.rtrim(F.substring(name, tail + 1, F.length(name)), F.lit(")")))
    dot = F.length(head) - F.instr(F.reverse(head), ".") + 1
    has = F.instr(head, ".") > 0
    return F.when(has, F.substring(head, F.lit(1), dot - 1)), F.when(has, F.replace(F.substring(head, dot + 1, F.length(head)), F.lit("#"), F.lit("."))), inside


def split_params(text: Column) -> Column:
    """Parts at commas outside ``{}``, ``<>`` and ``[]``, trimmed; empty ones in the middle stay, an empty last one goes."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(a, c):
        cut = (c == ",") & (a["depth"] == 0)
        return F.struct(
            (a["depth"] + F.when(c.isin("{", "<", "["), 1).when(c.isin("}", ">", "]"), -1).otherwise(0)).alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(a["part"], c)).alias("part"),
            F.when(cut, F.concat(a["parts"], F.array(F.trim(a["part"])))).otherwise(a["parts"]).alias("parts"),
        )

    last = lambda a: F.when(F.trim(a["part"]) != "", F.concat(a["parts"], F.array(F.trim(a["part"])))).otherwise(a["parts"])
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), state, step, last)


def short_name(meta_name: Column) -> Column:
    """A type's own metadata name, without namespace and outer types; empty for arrays and pointers, which have none."""
    return F.when(F.rlike(meta_name, F.lit(r"[\[\]*]")), F.lit("")).otherwise(F.regexp_extract(meta_name, r"([^.+]+)$", 1))
