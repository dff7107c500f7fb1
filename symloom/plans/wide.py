"""DuckDB forms of the queries over the wide mapping of the star schema."""

from __future__ import annotations

from symloom import vocab
from symloom.plans import oracle
from symloom.plans.oracle import BASE, CTES, esc, rows

BUILT_IN = f"'{BASE}/type/_builtin_/'"
LEVEL = "left(o_orderpriority, 1)"
OWN = {
    "cmeta": "SELECT k, CASE WHEN k % 10 = 7 THEN c_name ELSE ns || '.' || c_name END meta, 0 depth, 'c' || k path FROM cust WHERE NOT nested UNION ALL SELECT c.k, m.meta || '+' || c.c_name, m.depth + 1, m.path || '/c' || c.k FROM cust c JOIN cmeta m ON c.nested AND m.k = c.k // 10",
    "mem": f"""SELECT o_orderkey o, o_custkey c, {LEVEL} lv, CASE WHEN {LEVEL} IN ('1', '5') THEN 'method' WHEN {LEVEL} = '2' THEN 'property' WHEN {LEVEL} = '3' THEN 'field' ELSE 'event' END kind,
        CASE WHEN {LEVEL} = '5' THEN '.ctor' WHEN {LEVEL} = '2' AND o_orderkey % 4 = 2 THEN 'this[]' ELSE 'M' || o_orderkey END nm, {oracle.ACCESS}[o_orderkey % 6 + 1] acc, {LEVEL} = '2' AND o_orderkey % 4 = 2 idx, {LEVEL} = '1' AND o_orderkey % 19 = 0 accessor FROM orders""",
    "sigs": "SELECT ok, string_agg(CASE WHEN rf = 'A' THEN 'ref ' WHEN rf = 'R' THEN 'out ' WHEN ln = 2 THEN 'in ' ELSE '' END || meta, ',' ORDER BY ord) sig, string_agg(meta, ',' ORDER BY ord) plain FROM items JOIN pref ON p = lp GROUP BY ok",
    "memb": f"""SELECT *, type_iri || '/member/' || {esc('nm')} || list iri FROM (SELECT mem.*, t.iri type_iri, CASE WHEN mem.kind = 'method' THEN '(' || coalesce(sig, '') || ')' WHEN idx THEN '[' || coalesce(plain, '') || ']' ELSE '' END list,
        (t.vis AND o % 6 <> 1 AND o % 17 <> 0 AND NOT accessor) vis FROM mem JOIN ctype t ON t.k = mem.c LEFT JOIN sigs ON ok = o)""",
    "par": CTES["par"].replace("memb.kind = 'method'", "(memb.kind = 'method' OR memb.idx)"),
    "att": f"""SELECT memb.iri || CASE WHEN back THEN '/return' ELSE '' END target_iri, memb.iri || '/attr/' || i iri, ln, rf, st, {BUILT_IN} || {esc("'Marks.' || s_name")} class_iri
        FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY back, ord) - 1 i FROM (SELECT items.*, mem.kind = 'method' AND ln = 6 back FROM items JOIN mem ON o = ok)) JOIN memb ON ok = o JOIN supplier ON s_suppkey = ls WHERE memb.vis AND ls % 5 <> 4""",
}
TAKES = "SELECT iri || '/typeparam/0' iri, iri owner_iri, 'None' variance FROM memb WHERE vis AND kind = 'method' AND o % 4 = 1 UNION ALL SELECT iri || '/typeparam/0', iri, 'Out' FROM ctype WHERE vis AND k % 8 = 1"
LIMITS = f"""SELECT m.iri || '/typeparam/0' iri, {BUILT_IN} || {esc('d.meta')} c_iri FROM memb m JOIN (SELECT unnest([1, 2]) i) ON i = 1 OR o % 8 = 1 JOIN pdef d ON d.p = (o + i) % d.n WHERE vis AND kind = 'method' AND o % 4 = 1
        UNION ALL SELECT t.iri || '/typeparam/0', b.iri FROM ctype t JOIN ctype b ON b.k = t.k // 2 WHERE t.vis AND t.k % 8 = 1"""
CLICKED = """SELECT m.iri s, x.iri o FROM (SELECT event_id % no a, (event_id + 1) % no b FROM events, (SELECT count(*) no FROM orders) WHERE event_type = 'click')
        JOIN memb x ON x.o = a AND x.lv = '1' JOIN cust ON k = x.c AND NOT nested AND k % 10 <> 7 JOIN memb m ON m.o = b WHERE m.vis AND m.kind IN ('method', 'property')"""


def sql(body: str, *names: str) -> str:
    return oracle.sql(body, *names, own=OWN)


WIDE = {
    "wide_iri_member": sql("SELECT 'o' || o AS key, iri FROM memb", "memb"),
    "wide_member_kinds": sql("SELECT 'o' || o AS key, kind FROM memb WHERE vis", "memb"),
    "wide_types": sql(
        " UNION ALL ".join([
            rows(oracle.FULL_TYPES, *oracle.TYPES[:-1], ("i", "iri", "inNamespace", f"'{BASE}/namespace/' || {esc('ns')}", "k % 10 <> 7"), ("l", "iri", "specialType", "'System_Object'", "k = 4")),
            rows(oracle.BASES.replace("WHERE", "WHERE b.k <> 4 AND"), ("i", "iri", "inherits", "b_iri")), rows(oracle.OUTER, ("i", "iri", "nestedIn", "o_iri")),
            rows(oracle.ENUMS, ("i", "iri", "enumUnderlyingType", "e_iri")), rows(oracle.FACES, ("i", "iri", "implements", "f_iri")),
        ]), "ctype", "pq",
    ),
    "wide_type_parameters": sql(
        rows(f"({TAKES})", ("a", "iri", "", "'TypeParameter'"), ("l", "iri", "name", "'T0'"), ("n", "iri", "ordinal", "0"), ("l", "iri", "variance", "variance"), ("b", "iri", "hasReferenceTypeConstraint", "true"), *[("b", "iri", n, "false") for n, _ in vocab.TYPE_PARAM_FLAGS[1:]], ("i", "owner_iri", "hasTypeParameter", "iri"), ("i", "iri", "typeParameterOf", "owner_iri"))
        + " UNION ALL " + rows(f"({LIMITS})", ("i", "iri", "constrainedToType", "c_iri")), "memb", "pdef",
    ),
    "wide_implementations": sql(rows("(SELECT m.iri, b.iri b_iri FROM memb m JOIN memb b ON b.o = m.o // 2 WHERE m.vis AND m.o % 10 = 3 AND m.kind <> 'field')", ("i", "iri", "explicitInterfaceImplementation", "b_iri")), "memb"),
    "wide_parameters": sql(
        rows("par", ("a", "iri", "", "'Parameter'"), ("l", "iri", "name", "'x' || ord"), ("n", "iri", "ordinal", "ord"), ("b", "iri", "isOptional", "ln = 1"), ("b", "iri", "isParams", "false"), ("b", "iri", "isThis", "false"), ("b", "iri", "isDiscard", "false"),
             ("l", "iri", "refKind", "CASE WHEN rf = 'A' THEN 'Ref' WHEN rf = 'R' THEN 'Out' WHEN ln = 2 THEN 'In' ELSE 'None' END"), ("b", "iri", "hasExplicitDefaultValue", "ln % 3 = 0"), ("l", "iri", "defaultValue", "CASE WHEN ln = 3 THEN st ELSE 'null' END", "ln % 3 = 0"),
             ("i", "owner_iri", "hasParameter", "iri"), ("i", "iri", "parameterOf", "owner_iri"), ("i", "iri", "parameterType", "value_iri")), "par",
    ),
    "wide_attributes": sql(
        rows("att", ("a", "iri", "", "'Attribute'"), ("i", "target_iri", "hasAttribute", "iri"), ("i", "iri", "attributeOf", "target_iri"), ("i", "iri", "attributeType", "class_iri"),
             ("l", "iri", "constructorArguments", "CASE WHEN ln = 3 THEN '[' || rf || ', ' || st || '], null' ELSE '\"' || rf || '\", ' || ln END", "ln % 2 = 0 OR ln = 3"), ("l", "iri", "namedArguments", "'Key=typeof(' || st || ')'", "ln = 5")), "att",
    ),
    "wide_related": sql(f"SELECT m.iri s, target o FROM docs2 d JOIN memb m USING (o) WHERE et = 'view' AND vis AND kind IN ('method', 'property') UNION ALL {CLICKED}", "memb", "docs2"),
}
