"""Basic graph patterns compiled to joins of a triples table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.staging import near, stage


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    """A plain string: never a typed literal, never an IRI."""

    value: str


Pattern = tuple[Var | Iri, Var | Iri, Var | Iri | Lit]


def _kind(name: str) -> str:
    return f"_kind_{name}"


Source = DataFrame | Callable[[str | None, str | None], DataFrame]


def _read(triples: Source, pattern: Pattern) -> DataFrame:
    constant = lambda t: None if isinstance(t, Var) else t.value
    return triples(constant(pattern[1]), constant(pattern[2])) if callable(triples) else triples


def _scan(triples: DataFrame, pattern: Pattern, tag: int, iris: frozenset[str] = frozenset()) -> tuple[DataFrame, list[str]]:
    """Rows of one pattern, repeated ones too; ``iris`` are variables that stand for IRIs elsewhere.  Other objects carry their kind of term."""
    rows, out, seen = triples, [], {}
    for role, term in zip(("subject", "predicate", "object"), pattern, strict=True):
        if isinstance(term, Var):
            if role == "object" and term.name in iris:
                rows = rows.where("is_iri")
            if term.name in seen:
                rows = rows.where(F.col(role) == F.col(seen[term.name]))
            else:
                seen[term.name] = role
                out.append(F.col(role).alias(term.name))
                if role == "object" and term.name not in iris:
                    out.append(F.when(F.col("is_iri"), F.lit("<>")).otherwise(F.coalesce("datatype", F.lit(""))).alias(_kind(term.name)))
        else:
            # a store has a folder for each predicate
            rows = rows.where(F.col("folder" if role == "predicate" and "folder" in triples.columns else role) == term.value)
            if isinstance(term, Lit):
                rows = rows.where("not is_iri and datatype is null")
            elif role == "object":
                rows = rows.where("is_iri")
    return rows.select(*out) if out else rows.limit(1).select(F.lit(1).alias(f"_hit{tag}")), list(seen)


def _weight(pattern: Pattern) -> tuple[int, int]:
    """Bound objects first, then bound subjects; what is left goes by the number of variables."""
    s, _, o = pattern
    return (0 if isinstance(o, Lit) else 1 if isinstance(s, Iri) else 2 if isinstance(o, Iri) else 3, sum(isinstance(t, Var) for t in pattern))


def order(patterns: list[Pattern]) -> list[Pattern]:
    """The most selective first, then always one that shares a variable with those before."""
    left, out, known = sorted(patterns, key=_weight), [], set()
    while left:
        names = [{t.name for t in p if isinstance(t, Var)} for p in left]
        at = next((i for i, n in enumerate(names) if not known or not n or n & known), 0)
        known |= names[at]
        out.append(left.pop(at))
    return out


def solve(triples: Source, patterns: list[Pattern], select: list[str] | None = None, allow_product: bool = False) -> DataFrame:
    """Solutions as a bag over the set of triples; columns are the variables' names.

    Patterns that share no variable with the others would multiply rows; that is refused unless
    asked for.

    ``triples`` may be a function of a pattern's predicate and object (None for variables) that
    makes rows holding all that match.  Then solutions so far are written after each pattern,
    and while they are few the next one's rows are held against their hashes before they are dealt out.
    """
    result, known = None, []
    iris = frozenset(t.name for p in patterns for t in p[:2] if isinstance(t, Var))
    for i, pattern in enumerate(order(patterns)):
        rows, names = _scan(_read(triples, pattern), pattern, i, iris)
        if result is None:
            result, known = rows.distinct() if names else rows, names
            continue
        shared = [n for n in names if n in known]
        if not shared and names and known and not allow_product:
            raise ValueError(f"pattern {pattern} shares no variable with the others")
        if callable(triples):
            result = stage(result)
            rows = near(rows, result.select(shared)) if shared else rows
        rows = rows.distinct() if names else rows
        keys = shared + [_kind(n) for n in shared if n not in iris]
        result = result.join(rows, keys) if shared else result.crossJoin(rows)
        known += [n for n in names if n not in known]
    return result.select(*(select or known))
