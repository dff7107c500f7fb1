"""DuckDB forms of the queries over whole tables and the whole bag of triples."""

from __future__ import annotations

from symloom import vocab
from symloom.plans import oracle

BUILT_IN = f"'{oracle.BASE}/type/_builtin_/'"
NAMED = "SELECT 'c' || k AS key, meta FROM ctype UNION ALL SELECT 'p' || p, meta FROM pdef UNION ALL SELECT 's' || s_suppkey, 'Marks.' || s_name FROM supplier"
OUTSIDE = "SELECT 'p' || p AS key, meta FROM pdef UNION ALL SELECT 'q' || p, meta FROM pq UNION ALL SELECT 'a' || p, meta || '[]' FROM pdef WHERE p % 5 = 0 UNION ALL SELECT 'r' || p, meta || '*' FROM pdef WHERE p % 7 = 0 UNION ALL SELECT 's' || s_suppkey, 'Marks.' || s_name FROM supplier"
SPACES = "SELECT 'n' || n_nationkey id, ns AS full_name, 'r' || r_regionkey up FROM (SELECT *, r_name || '.' || n_name ns FROM places) UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region UNION ALL SELECT 'P' || p_partkey, 'Parts.P' || p_partkey, 'Parts' FROM part UNION ALL SELECT 'Parts', 'Parts', NULL UNION ALL SELECT 'Marks', 'Marks', NULL"
ATTRIBUTED = oracle.sql("", "ctype", "memb", "pq", "items", "docs2", "att").rstrip() + f", {oracle.STUBS} "
MARKS = f"(SELECT {BUILT_IN} || {oracle.esc(chr(39) + 'Marks.' + chr(39) + ' || s_name')} iri, s_name FROM supplier WHERE s_suppkey IN (SELECT ls FROM items JOIN memb ON ok = o WHERE memb.vis AND ls % 5 <> 4))"
MARK_STUBS = oracle.rows(MARKS, ("a", "iri", "", "'Type'"), ("l", "iri", "name", "s_name"), ("l", "iri", "fullName", "'Marks.' || s_name"), ("l", "iri", "typeKind", "'Class'"), ("i", "iri", "inNamespace", f"'{oracle.BASE}/namespace/Marks'"))
OWN = f"(SELECT DISTINCT r_name, n_name, ns FROM ctype WHERE vis OR iri IN (SELECT iri FROM {oracle.HIDDEN}))"
USED = f"SELECT ns full_name, n_name nm, r_name up FROM {OWN} UNION SELECT r_name, r_name, NULL FROM {OWN} UNION SELECT 'Parts.P' || p, 'P' || p, 'Parts' FROM seen UNION SELECT 'Parts', 'Parts', NULL FROM seen UNION SELECT 'Marks', 'Marks', NULL FROM att"
SPACE = f"'{oracle.BASE}/namespace/' || "
USED_SPACES = oracle.rows(f"(SELECT {SPACE} {oracle.esc('full_name')} iri, full_name, nm, {SPACE} {oracle.esc('up')} up_iri, up FROM ({USED}))", ("a", "iri", "", "'Namespace'"), ("l", "iri", "name", "nm"), ("l", "iri", "fullName", "full_name"), ("i", "iri", "parentNamespace", "up_iri", "up IS NOT NULL"))
MADE = f"(SELECT {BUILT_IN} || {oracle.esc('pq.meta')} iri, {BUILT_IN} || {oracle.esc('pdef.meta')} d_iri, pq.ar, m0, m1 FROM pq JOIN pdef USING (p) WHERE p IN (SELECT p FROM seen WHERE f = 'q'))"
ARGS = f"(SELECT iri, iri || '/typearg/' || i node, i, {BUILT_IN} || {oracle.esc('m')} a_iri FROM (SELECT iri, i, CASE i WHEN 0 THEN m0 ELSE m1 END m FROM {MADE} JOIN (SELECT unnest([0, 1]) i) ON i < ar))"
GENERICS = oracle.rows(MADE, ("i", "iri", "genericDefinition", "d_iri")) + " UNION ALL " + oracle.rows(ARGS, ("i", "iri", "typeArgument", "node"), ("n", "node", "index", "i"), ("i", "node", "type", "a_iri"))
EDGES = [oracle.rows(f"({oracle.ORACLE[name]})", ("i", "s", p, "o")) for name, p in (("throws_edges", "throws"), ("related_edges", "relatedTo"))]
PROJECTED = [oracle.ORACLE[f"project_{x}"] for x in ("assembly", "type", "method", "property", "field", "event", "parameter", "attribute")] + [oracle.ORACLE["stub_types"]]
BLOCKS = [*PROJECTED, *EDGES, ATTRIBUTED + MARK_STUBS, ATTRIBUTED + USED_SPACES, ATTRIBUTED + GENERICS]
BAG = "WITH bag AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT subject, predicate, object, is_iri, datatype FROM ({b})" for b in BLOCKS) + ")"
ASKED = "(SELECT o, 'M:' || meta || '.' || replace(nm, '.', '#') head, coalesce(list, '') list FROM mem JOIN ctype ON k = c LEFT JOIN (SELECT ok, string_agg(meta, ',' ORDER BY ord) list FROM items JOIN pref ON p = lp GROUP BY ok) ON ok = o WHERE mem.kind = 'method')"
WHOLE = {
    "project_namespace": ATTRIBUTED + USED_SPACES,
    "emitted_once": f"{BAG} SELECT subject iri, count(*) n FROM bag WHERE predicate = '{vocab.RDF_TYPE}' AND object LIKE '%/ontology/Type' GROUP BY ALL",
    "iri_type_all": oracle.sql(f"SELECT 'c' || k AS key, iri FROM ctype UNION ALL SELECT key, {BUILT_IN} || {oracle.esc('meta')} FROM ({OUTSIDE})", "ctype", "pq"),
    "iri_namespace_all": oracle.sql(f"SELECT id AS key, '{oracle.BASE}/namespace/' || {oracle.esc('full_name')} iri FROM ({SPACES})", "places"),
    "type_class_all": oracle.sql(f"SELECT 'c' || k AS key, CASE WHEN k % 11 = 0 THEN 'Record' ELSE kind END cls FROM cust UNION ALL SELECT key, CASE WHEN left(key, 1) IN ('a', 'r') THEN 'Type' ELSE 'Class' END FROM ({OUTSIDE})", "cust", "pq"),
    "nested_types_walk_all": oracle.sql(f"SELECT 'c' || k AS key, depth, path FROM ctype UNION ALL SELECT key, 0, key FROM ({OUTSIDE})", "ctype", "pq"),
    "namespace_ancestors_all": oracle.sql(f"SELECT id ns, id ancestor FROM ({SPACES}) UNION ALL SELECT id, up FROM ({SPACES}) WHERE up IS NOT NULL", "places"),
    "cref_type_all": oracle.sql(f"SELECT 'T:' || meta cref, key target FROM ({NAMED})", "ctype", "pdef"),
    "mentioned_generics": ATTRIBUTED + GENERICS,
    "triple_count_all": f"{BAG} SELECT count(*) n FROM bag",
    "triples_by_class_all": f"{BAG} SELECT regexp_extract(object, '[^/]*$') cls, count(*) n FROM bag WHERE predicate = '{vocab.RDF_TYPE}' GROUP BY ALL",
    "triples_by_predicate": f"{BAG} SELECT predicate, count(*) n FROM bag GROUP BY ALL",
    "cref_overload": oracle.sql(f"SELECT head || '(' || list || ')' cref, 'o' || min(o) target FROM {ASKED} GROUP BY ALL", "mem", "ctype", "items", "pref"),
    "cref_fallback": oracle.sql(f"SELECT head || '(No.Such)' cref, 'o' || min(o) target FROM {ASKED} GROUP BY ALL", "mem", "ctype", "items", "pref"),
    "type_closure_all": f"SELECT * FROM ({oracle.ORACLE['type_closure']}) UNION ALL SELECT * FROM ({ATTRIBUTED} SELECT iri FROM {MARKS})",
    "stub_types_all": f"SELECT * FROM ({oracle.ORACLE['stub_types']}) UNION ALL SELECT * FROM ({ATTRIBUTED + MARK_STUBS})",
    "nt_lines_all": f"{BAG} SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN is_iri THEN '<' || object || '>' ELSE '\"' || {oracle.lit('object')} || '\"' || coalesce('^^<' || datatype || '>', '') END || ' .' line FROM bag",
    "ttl_lines_all": f"{BAG} SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN is_iri THEN '<' || object || '>' WHEN datatype IN ('{vocab.XSD_BOOLEAN}', '{vocab.XSD_INTEGER}') THEN object ELSE '\"' || {oracle.lit('object')} || '\"' || coalesce('^^<' || datatype || '>', '') END || ' .' line FROM bag",
}
