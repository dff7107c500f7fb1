"""Literal escapes and lines of N-Triples and Turtle, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom import vocab

CONTROLS = r"\x00-\x08\x0B\x0C\x0E-\x1F"


def escape_literal(text: Column) -> Column:
    """Backslash, quote, LF, CR and TAB by short escapes, other controls under U+0020 as ``\\uXXXX``; the rest raw."""
    out = text
    for raw, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    # one pass: parts that a control starts
    code = lambda p: F.concat(F.lit("\\u00"), F.lpad(F.hex(F.ascii(p).cast("long")), 2, "0"), F.substring(p, F.lit(2), F.length(p)))
    rare = F.array_join(F.transform(F.split(out, f"(?=[{CONTROLS}])", -1), lambda p: F.when(F.rlike(p, F.lit(f"^[{CONTROLS}]")), code(p)).otherwise(p)), "")
    return F.when(F.rlike(text, F.lit(f"[{CONTROLS}]")), rare).otherwise(out)


def _line(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), o, F.lit(" ."))


def _quoted(o: Column, datatype: Column) -> Column:
    return F.concat(F.lit('"'), escape_literal(o), F.lit('"'), F.when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(F.lit("")))


def nt_line(s: Column, p: Column, o: Column, is_iri: Column, datatype: Column) -> Column:
    return _line(s, p, F.when(is_iri, F.concat(F.lit("<"), o, F.lit(">"))).otherwise(_quoted(o, datatype)))


def ttl_line(s: Column, p: Column, o: Column, is_iri: Column, datatype: Column, verb: Column | None = None) -> Column:
    """Booleans and integers stand bare; with ``verb`` given, only those that were emitted by it (bool, int)."""
    bare = datatype.isin(vocab.XSD_BOOLEAN, vocab.XSD_INTEGER) if verb is None else verb.isin("bool", "int")
    return _line(s, p, F.when(is_iri, F.concat(F.lit("<"), o, F.lit(">"))).when(F.coalesce(bare, F.lit(False)), o).otherwise(_quoted(o, datatype)))


def unescape_literal(text: Column) -> Column:
    """The inverse of ``escape_literal``."""
    hidden = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for raw, short in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        hidden = F.replace(hidden, F.lit(short), F.lit(raw))
    back = lambda c: F.replace(c, F.lit("\0"), F.lit("\\"))
    code = lambda p: F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("int"))
    split = F.split(hidden, r"\\u00(?=[01][0-9A-Fa-f])", -1)
    rare = F.array_join(F.transform(split, lambda p, i: F.when(i == 0, back(p)).otherwise(F.concat(code(p), back(F.substring(p, F.lit(3), F.length(p)))))), "")
    return F.when(F.contains(hidden, F.lit("\\u00")), rare).otherwise(back(hidden))
