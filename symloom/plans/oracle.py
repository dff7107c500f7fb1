"""DuckDB forms of the catalogue's queries, written against the star schema itself."""

from __future__ import annotations

from symloom import vocab

BASE = "http://dotnet.example"
DT = f"{BASE}/ontology/"


def esc(x: str) -> str:
    return f"array_to_string([CASE WHEN octet_length(encode(c)) = 4 THEN '%EF%BF%BD%EF%BF%BD' WHEN regexp_full_match(c, '[\\p{{L}}\\p{{Nd}}._~-]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END FOR c IN string_split({x}, '')], '')"


def lit(x: str) -> str:
    """Literal escapes."""
    out = f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    for code in (1, 2, 31):
        out = f"replace({out}, chr({code}), '\\u{code:04X}')"
    return out


ACCESS = "['Public', 'Private', 'Internal', 'Protected', 'ProtectedAndInternal', 'ProtectedOrInternal']"
CTES = {
    "places": "SELECT n_nationkey, n_name, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey",
    "cust": f"""SELECT c_custkey k, c_name, r_regionkey rk, r_name, n_name, r_name || '.' || n_name ns, (c_custkey % 3 = 0 AND c_custkey > 0) nested,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Class' WHEN 'AUTOMOBILE' THEN 'Struct' WHEN 'FURNITURE' THEN 'Interface' WHEN 'HOUSEHOLD' THEN 'Enum' ELSE 'Delegate' END kind,
        {ACCESS}[c_custkey % 6 + 1] acc, n_nationkey nk FROM customer JOIN places ON c_nationkey = n_nationkey""",
    "cmeta": "SELECT k, ns || '.' || c_name meta, 0 depth, 'c' || k path FROM cust WHERE NOT nested UNION ALL SELECT c.k, m.meta || '+' || c.c_name, m.depth + 1, m.path || '/c' || c.k FROM cust c JOIN cmeta m ON c.nested AND m.k = c.k // 10",
    "ctype": f"SELECT cust.*, meta, depth, path, '{BASE}/type/' || {esc('r_name')} || '/' || rk || '.0.0.0/' || {esc('meta')} iri, (k % 6 <> 1 AND k % 13 <> 0) vis FROM cust JOIN cmeta USING (k)",
    "pdef": "SELECT p_partkey p, p_name, p_size % 3 ar, n, 'Parts.P' || p_partkey || '.' || p_name || CASE WHEN p_size % 3 > 0 THEN '`' || (p_size % 3) ELSE '' END meta FROM part, (SELECT count(*) n FROM part)",
    "pq": "SELECT d.p, d.p_name, d.ar, d.meta || '[' || a.meta || CASE WHEN d.ar = 2 THEN ',' || b.meta ELSE '' END || ']' meta, a.meta m0, b.meta m1 FROM pdef d JOIN pdef a ON a.p = (d.p + 1) % d.n JOIN pdef b ON b.p = (d.p + 2) % d.n WHERE d.ar > 0",
    "pref": "SELECT d.p, coalesce(q.meta, d.meta) meta FROM pdef d LEFT JOIN pq q USING (p)",
    "items": "SELECT l_orderkey ok, l_partkey lp, l_suppkey ls, l_linenumber ln, l_returnflag rf, l_linestatus st, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS INTEGER) ord FROM lineitem",
    "mem": f"""SELECT o_orderkey o, o_custkey c, left(o_orderpriority, 1) lv, CASE WHEN left(o_orderpriority, 1) IN ('1', '5') THEN 'method' WHEN left(o_orderpriority, 1) = '2' THEN 'property' WHEN left(o_orderpriority, 1) = '3' THEN 'field' ELSE 'event' END kind,
        CASE WHEN left(o_orderpriority, 1) = '5' THEN '.ctor' ELSE 'M' || o_orderkey END nm, {ACCESS}[o_orderkey % 6 + 1] acc, o_orderstatus os FROM orders""",
    "sigs": "SELECT ok, '(' || string_agg(CASE rf WHEN 'A' THEN 'ref ' WHEN 'R' THEN 'out ' ELSE '' END || meta, ',' ORDER BY ord) || ')' sig FROM items JOIN pref ON p = lp GROUP BY ok",
    "memb": f"""SELECT mem.*, t.iri type_iri, CASE WHEN mem.kind = 'method' THEN coalesce(sig, '()') ELSE '' END sig, t.iri || '/member/' || {esc('nm')} || CASE WHEN mem.kind = 'method' THEN coalesce(sig, '()') ELSE '' END iri,
        (t.vis AND o % 6 <> 1 AND o % 17 <> 0) vis, '{BASE}/type/_builtin_/' || {esc('v.meta')} value_iri FROM mem JOIN ctype t ON t.k = mem.c LEFT JOIN sigs ON ok = o JOIN pdef v ON v.p = o % v.n""",
    "par": f"SELECT memb.iri owner_iri, memb.iri || '/param/' || ord iri, ord, rf, ln, st, '{BASE}/type/_builtin_/' || {esc('pref.meta')} value_iri FROM items JOIN memb ON ok = o AND memb.kind = 'method' JOIN pref ON pref.p = lp WHERE memb.vis",
    "att": f"SELECT memb.iri owner_iri, memb.iri || '/attr/' || ord iri, ln, rf, st, '{BASE}/type/_builtin_/' || {esc(chr(39) + 'Marks.' + chr(39) + ' || s_name')} class_iri FROM items JOIN memb ON ok = o JOIN supplier ON s_suppkey = ls WHERE memb.vis AND ls % 5 <> 4",
    "docs2": f"SELECT event_id e, event_type et, event_id % no o, d.p, d.meta, 'T:' || d.meta cref, '{BASE}/type/_builtin_/' || {esc('d.meta')} target FROM events, (SELECT count(*) no FROM orders) JOIN pdef d ON d.p = user_id % d.n WHERE event_type IN ('error', 'view') AND event_id % 10 <> 3",
}
NEEDS = {
    "cust": ["places"], "cmeta": ["cust"], "ctype": ["cmeta"], "pq": ["pdef"], "pref": ["pq"], "sigs": ["items", "pref"], "memb": ["mem", "ctype", "sigs", "pdef"], "par": ["memb", "items", "pref"], "att": ["memb", "items"], "docs2": ["pdef"],
}


def sql(body: str, *names: str, own: dict[str, str] | None = None) -> str:
    """``body`` with the CTEs it needs; ``own`` ones stand in the place of CTES of the same name."""
    wanted: set[str] = set()

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        wanted.add(n)

    for n in names:
        add(n)
    # materialised, as DuckDB stops with an internal error on some of the inlined forms; a recursive one can't be
    ctes = ", ".join(f"{n} AS {'' if n == 'cmeta' else 'MATERIALIZED '}({q})" for n, q in (CTES | (own or {})).items() if n in wanted)
    return (f"WITH RECURSIVE {ctes} " if ctes else "") + body


def rows(source: str, *parts: tuple) -> str:
    """UNION ALL of (kind, subject, predicate, object[, condition]); kind: a, i(ri), l(iteral), b(ool), n(umber)."""
    out = []
    for kind, s, p, o, *cond in parts:
        pred = f"'{vocab.RDF_TYPE}'" if kind == "a" else f"'{DT}{p}'"
        obj = f"'{DT}' || {o}" if kind == "a" else f"CASE WHEN {o} THEN 'true' ELSE 'false' END" if kind == "b" else f"CAST({o} AS VARCHAR)"
        dt = {"b": f"'{vocab.XSD_BOOLEAN}'", "n": f"'{vocab.XSD_INTEGER}'"}.get(kind, "CAST(NULL AS VARCHAR)")
        out.append(f"SELECT {s} subject, {pred} predicate, {obj} object, {'true' if kind in 'ai' else 'false'} is_iri, {dt} datatype FROM {source}" + (f" WHERE {cond[0]}" if cond else ""))
    return " UNION ALL ".join(out)


F_ = "false"
VIS = "(SELECT * FROM memb WHERE vis AND kind = '{}')"
MEMBER = [("a", "iri", "", "'Member'"), ("l", "iri", "name", "nm"), ("l", "iri", "accessibility", "acc"), ("i", "type_iri", "hasMember", "iri"), ("i", "iri", "memberOf", "type_iri")]
OVER = f"(SELECT m.iri, m.kind, b.iri over_iri FROM memb m JOIN memb b ON b.o = m.o // 9 WHERE m.vis AND m.o % 9 = 0 AND m.o > 0)"
TYPES = [
    ("a", "iri", "", "'Type'"), ("a", "iri", "", "CASE WHEN k % 11 = 0 THEN 'Record' ELSE kind END"), ("l", "iri", "name", "c_name"), ("l", "iri", "fullName", "ns || '.' || c_name"), ("l", "iri", "typeKind", "kind"), ("l", "iri", "accessibility", "acc"),
    ("b", "iri", "isAbstract", "k % 2 = 0"), ("b", "iri", "isSealed", "k % 5 = 0"), ("b", "iri", "isStatic", "k % 7 = 0"), ("b", "iri", "isGeneric", F_), ("b", "iri", "isValueType", "kind IN ('Struct', 'Enum')"), ("b", "iri", "isRecord", "k % 11 = 0"),
    ("b", "iri", "isRefLikeType", F_), ("b", "iri", "isReadOnly", F_), ("b", "iri", "isUnmanagedType", F_), ("i", "iri", "definedInAssembly", f"'{BASE}/assembly/' || {esc('r_name')} || '/' || rk || '.0.0.0'"), ("i", "iri", "inNamespace", f"'{BASE}/namespace/' || {esc('ns')}"),
]
MFLAGS = {"isStatic": "o % 2 = 0", "isVirtual": "o % 3 = 0", "isReadOnly": "o % 5 = 0", "hasGetter": "o % 2 = 1", "hasSetter": "o % 3 = 1"}


def flags(pairs) -> list[tuple]:
    return [("b", "iri", name, MFLAGS.get(name, F_)) for name, _ in pairs]


def project(kind: str, cls: str, *more: tuple) -> str:
    return rows(VIS.format(kind), *MEMBER, ("a", "iri", "", cls), *more)


def over(kind: str) -> str:
    return " UNION ALL " + rows(OVER, ("i", "iri", "overridesMethod", "over_iri", f"kind = '{kind}'"))


FULL_TYPES = "(SELECT * FROM ctype WHERE vis)"
BASES = "(SELECT t.iri, b.iri b_iri FROM ctype t JOIN ctype b ON b.k = t.k // 7 WHERE t.vis AND t.k % 4 = 1)"
OUTER = "(SELECT t.iri, b.iri o_iri FROM ctype t JOIN ctype b ON b.k = t.k // 10 WHERE t.vis AND t.nested)"
ENUMS = f"(SELECT t.iri, '{BASE}/type/_builtin_/' || {esc('d.meta')} e_iri FROM ctype t JOIN pdef d ON d.p = t.k % d.n WHERE t.vis AND t.kind = 'Enum')"
FACES = f"(SELECT t.iri, '{BASE}/type/_builtin_/' || {esc('q.meta')} f_iri FROM ctype t JOIN pdef d ON d.p = t.k % d.n JOIN pq q ON q.p = d.p WHERE t.vis AND t.k % 6 = 5)"
ACCESS_OK = "{a} <> 'x' AND ({priv} OR {a} <> 'Private') AND ({intr} OR {a} NOT IN ('Internal', 'ProtectedAndInternal')) AND ({gen} OR NOT {imp})"
SETS = ((False, True, False), (True, True, False), (False, False, False), (True, False, True))


def visibility(source: str, key: str, implicit: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} options, {key} AS key FROM {source} WHERE " + ACCESS_OK.format(a="acc", priv=p, intr=n, gen=g, imp=f"({implicit})") for i, (p, n, g) in enumerate(SETS))


EDGE_STRINGS = ("", "a b", "é世", "x/y?z#", "List`1[T]", "~._-", "\U0001f600")
CREFS = ("T:A.B", "M:A.B.C(System.Int32,System.String)", "N:A", "!:X", "A.B", "AB:C", "ABC:D", ":x", "T:")
PARAM_LISTS = ("A,B", "A{B,C},D", "A<B,C>,[D,E],F", "A,,B", "A,B,", " A , B ", "A[,],B")
STUBS = """start AS (SELECT k % n p, 'p' f FROM ctype, (SELECT count(*) n FROM part) WHERE vis AND kind = 'Enum' UNION SELECT q.p, 'q' FROM ctype t JOIN pdef d ON d.p = t.k % d.n JOIN pq q ON q.p = d.p WHERE t.vis AND t.k % 6 = 5
        UNION SELECT o % n, 'p' FROM memb, (SELECT count(*) n FROM part) WHERE vis AND NOT (kind = 'method' AND (lv = '5' OR o % 4 = 0))
        UNION SELECT lp, CASE WHEN ar > 0 THEN 'q' ELSE 'p' END FROM items JOIN memb ON ok = o AND memb.kind = 'method' JOIN pdef ON p = lp WHERE memb.vis
        UNION SELECT p, 'p' FROM docs2 JOIN memb USING (o) WHERE memb.vis),
    seen AS (SELECT p, f FROM start UNION SELECT q.p, 'p' FROM start s JOIN pq q ON s.f = 'q' AND q.p = s.p UNION SELECT (q.p + i) % (SELECT count(*) FROM part), 'p' FROM start s JOIN pq q ON s.f = 'q' AND q.p = s.p JOIN (SELECT unnest([1, 2]) i) ON i <= q.ar)"""


def with_stubs(body: str) -> str:
    head = sql("", "ctype", "memb", "pq", "items", "docs2").rstrip()
    return f"{head}, {STUBS} {body}"


HIDDEN = "(SELECT DISTINCT b.* FROM ctype t JOIN ctype b ON b.k = t.k // 7 WHERE t.vis AND t.k % 4 = 1 AND NOT b.vis)"
PART_IRI = f"'{BASE}/type/_builtin_/' || {esc('meta')}"
FLAGSHIP = "blue rod"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = {
    "iri_escape_names": f"SELECT s, {esc('s')} iri FROM (SELECT c_name s FROM customer UNION SELECT r_name FROM region UNION SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT unnest([{', '.join(map(q, EDGE_STRINGS))}]))",
    "iri_assembly": f"SELECT r_regionkey AS key, '{BASE}/assembly/' || {esc('r_name')} || '/' || r_regionkey || '.0.0.0' iri FROM region",
    "iri_namespace": sql(f"SELECT 'n' || n_nationkey AS key, '{BASE}/namespace/' || {esc('r_name || chr(46) || n_name')} iri FROM places", "places"),
    "iri_type": sql("SELECT 'c' || k AS key, iri FROM ctype", "ctype"),
    "iri_member": sql("SELECT 'o' || o AS key, iri FROM memb", "memb"),
    "iri_parameter": sql("SELECT owner_iri AS key, iri FROM par", "par"),
    "iri_typeparam": sql(f"SELECT 'p' || p || '/' || i AS key, {PART_IRI} || '/typeparam/' || i iri FROM pdef JOIN (SELECT unnest([0, 1]) i) ON i < ar", "pdef"),
    "iri_attribute": sql("SELECT owner_iri AS key, iri FROM att", "att"),
    "metadata_name_generic": sql("SELECT p p_partkey, meta meta_name FROM pq", "pq"),
    "member_signature": sql("SELECT o o_orderkey, sig FROM memb WHERE kind = 'method'", "memb"),
    "type_class": sql("SELECT k c_custkey, CASE WHEN k % 11 = 0 THEN 'Record' ELSE kind END cls FROM cust", "cust"),
    "attr_args_text": sql("SELECT owner_iri AS key, CASE WHEN ln % 2 = 0 THEN '\"' || rf || '\", ' || ln END ctor, CASE WHEN ln = 5 THEN 'Key=typeof(' || st || ')' END named FROM att WHERE ln % 2 = 0 OR ln = 5", "att"),
    "key_token_hex": "SELECT r_regionkey AS key, lower(hex(encode(r_name))) hex FROM region",
    "cref_split": f"SELECT cref, CASE WHEN strpos(cref, ':') IN (2, 3) THEN left(cref, strpos(cref, ':') - 1) END prefix, CASE WHEN strpos(cref, ':') IN (2, 3) THEN substr(cref, strpos(cref, ':') + 1) ELSE cref END AS name FROM (SELECT unnest([{', '.join(map(q, CREFS))}]) cref)",
    "cref_params_split": "SELECT * FROM (VALUES ('A,B', 0, 'A'), ('A,B', 1, 'B'), ('A{B,C},D', 0, 'A{B,C}'), ('A{B,C},D', 1, 'D'), ('A<B,C>,[D,E],F', 0, 'A<B,C>'), ('A<B,C>,[D,E],F', 1, '[D,E]'), ('A<B,C>,[D,E],F', 2, 'F'), ('A,,B', 0, 'A'), ('A,,B', 1, ''), ('A,,B', 2, 'B'), ('A,B,', 0, 'A'), ('A,B,', 1, 'B'), (' A , B ', 0, 'A'), (' A , B ', 1, 'B'), ('A[,],B', 0, 'A[,]'), ('A[,],B', 1, 'B')) t(cref, pos, part)",
    "literal_escape": f"SELECT doc_id, {lit('x')} esc FROM (SELECT doc_id, chr(1) || chr(2) || chr(31) || '\\\"' || chr(9) || chr(13) || text x FROM documents)",
    "nt_lines": sql(f"SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN is_iri THEN '<' || object || '>' ELSE '\"' || {lit('object')} || '\"' || coalesce('^^<' || datatype || '>', '') END || ' .' line FROM ({rows(FULL_TYPES, *TYPES)})", "ctype"),
    "ttl_lines": sql(f"SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN is_iri THEN '<' || object || '>' WHEN datatype IN ('{vocab.XSD_BOOLEAN}', '{vocab.XSD_INTEGER}') THEN object ELSE '\"' || {lit('object')} || '\"' || coalesce('^^<' || datatype || '>', '') END || ' .' line FROM ({rows(FULL_TYPES, *TYPES)})", "ctype"),
    "nt_header": f"SELECT * FROM (VALUES (0, '# @prefix rdf: <{vocab.RDF}> .'), (1, '# @prefix rdfs: <{vocab.RDFS}> .'), (2, '# @prefix xsd: <{vocab.XSD}> .'), (3, '# @prefix dt: <{DT}> .')) t(pos, line)",
    "ttl_header": f"SELECT * FROM (VALUES (0, '@prefix rdf: <{vocab.RDF}> .'), (1, '@prefix rdfs: <{vocab.RDFS}> .'), (2, '@prefix xsd: <{vocab.XSD}> .'), (3, '@prefix dt: <{DT}> .'), (4, '')) t(pos, line)",
    "nt_roundtrip": sql(rows("(SELECT 'd:' || doc_id iri, chr(1) || '\\\"' || chr(9) || text x, doc_id n FROM documents)", ("l", "iri", "text", "x"), ("n", "iri", "id", "n"))),
    "triple_count": sql(f"SELECT count(*) n FROM ({rows('par', *[('l', 'iri', 'x', 'ord')] * 10)} UNION ALL {rows('par', ('l', 'iri', 'x', 'ln', 'ln % 3 = 0'), ('l', 'iri', 'x', 'ln'), ('l', 'iri', 'x', 'ln'))})", "par"),
    "triples_by_class": sql("SELECT cls, count(*) n FROM (SELECT 'Type' cls FROM ctype WHERE vis UNION ALL SELECT CASE WHEN k % 11 = 0 THEN 'Record' ELSE kind END FROM ctype WHERE vis UNION ALL SELECT 'Member' FROM memb WHERE vis UNION ALL SELECT CASE kind WHEN 'method' THEN CASE WHEN lv = '5' THEN 'Constructor' ELSE 'Method' END WHEN 'property' THEN 'Property' WHEN 'field' THEN 'Field' ELSE 'Event' END FROM memb WHERE vis) GROUP BY cls", "ctype", "memb"),
    "visible_types": sql(visibility("cust", "'c' || k", "k % 13 = 0"), "cust"),
    "visible_members": sql(visibility("mem", "'o' || o", "o % 17 = 0"), "mem"),
    "member_kind_filter": sql("SELECT 'o' || o AS key, kind FROM mem", "mem"),
    "project_assembly": rows(f"(SELECT '{BASE}/assembly/' || {esc('r_name')} || '/' || r_regionkey || '.0.0.0' iri, * FROM region)", ("a", "iri", "", "'Assembly'"), ("l", "iri", "name", "r_name"), ("l", "iri", "version", "r_regionkey || '.0.0.0'"), ("l", "iri", "culture", "'neutral'", "r_regionkey % 2 = 0"), ("l", "iri", "publicKeyToken", "lower(hex(encode(r_name)))"), ("b", "iri", "isInteractive", F_)),
    "project_type": sql(rows(FULL_TYPES, *TYPES) + " UNION ALL " + rows(BASES, ("i", "iri", "inherits", "b_iri")) + " UNION ALL " + rows(OUTER, ("i", "iri", "nestedIn", "o_iri")) + " UNION ALL " + rows(ENUMS, ("i", "iri", "enumUnderlyingType", "e_iri")) + " UNION ALL " + rows(FACES, ("i", "iri", "implements", "f_iri")), "ctype", "pq"),
    "project_method": sql(project("method", "CASE WHEN lv = '5' THEN 'Constructor' ELSE 'Method' END", ("l", "iri", "methodKind", "CASE WHEN lv = '5' THEN 'Constructor' ELSE 'Ordinary' END"), *flags(vocab.METHOD_FLAGS), ("i", "iri", "returnType", "value_iri", "lv <> '5' AND o % 4 <> 0")) + over("method"), "memb"),
    "project_property": sql(project("property", "'Property'", *flags(vocab.PROPERTY_FLAGS), ("l", "iri", "getterAccessibility", "'Public'", "o % 2 = 1"), ("l", "iri", "setterAccessibility", "'Private'", "o % 3 = 1"), ("b", "iri", "isInitOnly", "o % 7 = 1", "o % 3 = 1"), ("i", "iri", "propertyType", "value_iri")) + over("property"), "memb"),
    "project_field": sql(project("field", "'Field'", *flags(vocab.FIELD_FLAGS), ("l", "iri", "constValue", "CASE WHEN o % 12 = 0 THEN os ELSE 'null' END", "o % 6 = 0"), ("i", "iri", "fieldType", "value_iri")), "memb"),
    "project_event": sql(project("event", "'Event'", *flags(vocab.EVENT_FLAGS), ("i", "iri", "eventType", "value_iri")) + over("event"), "memb"),
    "project_parameter": sql(rows("par", ("a", "iri", "", "'Parameter'"), ("l", "iri", "name", "'x' || ord"), ("n", "iri", "ordinal", "ord"), ("b", "iri", "isOptional", "ln = 1"), ("b", "iri", "isParams", F_), ("b", "iri", "isThis", F_), ("b", "iri", "isDiscard", F_), ("l", "iri", "refKind", "CASE rf WHEN 'A' THEN 'Ref' WHEN 'R' THEN 'Out' ELSE 'None' END"), ("b", "iri", "hasExplicitDefaultValue", "ln % 3 = 0"), ("l", "iri", "defaultValue", "CASE WHEN ln = 3 THEN st ELSE 'null' END", "ln % 3 = 0"), ("i", "owner_iri", "hasParameter", "iri"), ("i", "iri", "parameterOf", "owner_iri"), ("i", "iri", "parameterType", "value_iri")), "par"),
    "project_attribute": sql(rows("att", ("a", "iri", "", "'Attribute'"), ("i", "owner_iri", "hasAttribute", "iri"), ("i", "iri", "attributeOf", "owner_iri"), ("i", "iri", "attributeType", "class_iri"), ("l", "iri", "constructorArguments", "'\"' || rf || '\", ' || ln", "ln % 2 = 0"), ("l", "iri", "namedArguments", "'Key=typeof(' || st || ')'", "ln = 5")), "att"),
    "project_type_parameter": sql(rows(f"(SELECT {PART_IRI} owner_iri, {PART_IRI} || '/typeparam/' || i iri, i FROM pdef JOIN (SELECT unnest([0, 1]) i) ON i < ar)", ("a", "iri", "", "'TypeParameter'"), ("l", "iri", "name", "'T' || i"), ("n", "iri", "ordinal", "i"), ("l", "iri", "variance", "'None'"), ("b", "iri", "hasReferenceTypeConstraint", "i = 0"), *[("b", "iri", n, F_) for n, _ in vocab.TYPE_PARAM_FLAGS[1:]], ("i", "owner_iri", "hasTypeParameter", "iri"), ("i", "iri", "typeParameterOf", "owner_iri")), "pdef"),
    "generic_block": sql(rows(f"(SELECT {PART_IRI} iri, '{BASE}/type/_builtin_/' || {esc('dm')} d_iri FROM (SELECT q.meta, d.meta dm FROM pq q JOIN pdef d USING (p)))", ("i", "iri", "genericDefinition", "d_iri")) + " UNION ALL " + rows(f"(SELECT {PART_IRI} iri, {PART_IRI} || '/typearg/' || i node, i, '{BASE}/type/_builtin_/' || {esc('m')} a_iri FROM (SELECT meta, i, CASE i WHEN 0 THEN m0 ELSE m1 END m FROM pq JOIN (SELECT unnest([0, 1]) i) ON i < ar))", ("i", "iri", "typeArgument", "node"), ("n", "node", "index", "i"), ("i", "node", "type", "a_iri")), "pq"),
    "stub_arrays": sql(rows(f"(SELECT '{BASE}/type/_builtin_/' || {esc('meta || chr(91) || chr(93)')} iri, {PART_IRI} e_iri, 'Parts.P' || p || '.' || p_name || '[]' nm FROM pdef WHERE p % 5 = 0)", ("a", "iri", "", "'Type'"), ("l", "iri", "name", "nm"), ("l", "iri", "typeKind", "'Array'"), ("n", "iri", "arrayRank", "1"), ("i", "iri", "arrayElementType", "e_iri")), "pdef"),
    "stub_pointers": sql(rows(f"(SELECT '{BASE}/type/_builtin_/' || {esc('meta || chr(42)')} iri, {PART_IRI} e_iri, 'Parts.P' || p || '.' || p_name || '*' nm FROM pdef WHERE p % 7 = 0)", ("a", "iri", "", "'Type'"), ("l", "iri", "name", "nm"), ("l", "iri", "typeKind", "'Pointer'"), ("i", "iri", "pointerElementType", "e_iri")), "pdef"),
    "type_closure": with_stubs(f"SELECT '{BASE}/type/_builtin_/' || {esc('meta')} iri FROM (SELECT DISTINCT CASE f WHEN 'q' THEN pq.meta ELSE pdef.meta END meta FROM seen JOIN pdef USING (p) LEFT JOIN pq USING (p)) UNION SELECT iri FROM {HIDDEN}"),
    "stub_types": with_stubs(rows(f"(SELECT {PART_IRI} iri, p, p_name FROM (SELECT DISTINCT CASE f WHEN 'q' THEN pq.meta ELSE pdef.meta END meta, p, pdef.p_name FROM seen JOIN pdef USING (p) LEFT JOIN pq USING (p)))", ("a", "iri", "", "'Type'"), ("l", "iri", "name", "p_name"), ("l", "iri", "fullName", "'Parts.P' || p || '.' || p_name"), ("l", "iri", "typeKind", "'Class'"), ("i", "iri", "inNamespace", f"'{BASE}/namespace/Parts.P' || p")) + " UNION ALL " + rows(HIDDEN, TYPES[0], *TYPES[2:5], *TYPES[-2:])),
    "nested_types_walk": sql("SELECT 'c' || k AS key, depth, path FROM ctype", "ctype"),
    "namespace_ancestors": sql("SELECT 'n' || n_nationkey ns, 'n' || n_nationkey ancestor FROM places UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey FROM places UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region", "places"),
    "doc_exceptions": sql("SELECT 'o' || o AS owner, cref, count(*) n FROM docs2 WHERE et = 'error' GROUP BY ALL", "docs2"),
    "doc_seealso": sql("SELECT 'o' || o AS owner, cref, count(*) n FROM docs2 WHERE et = 'view' GROUP BY ALL", "docs2"),
    "doc_malformed_ignored": "SELECT count(*) n FROM events WHERE event_type IN ('error', 'view') AND event_id % 10 = 3",
    "cref_type": sql("SELECT 'T:' || meta cref, 'p' || p target FROM pdef", "pdef"),
    "cref_member_first": sql("SELECT 'M:' || meta || '.#ctor' cref, 'o' || min(o) target FROM ctype JOIN mem ON mem.c = k AND lv = '5' GROUP BY meta", "ctype", "mem"),
    "reference_closure": "WITH RECURSIVE r AS (SELECT 'customer0' AS name UNION SELECT 'customer' || e.b FROM r JOIN (SELECT c_custkey a, (c_custkey * 7 + 3) % n b FROM customer, (SELECT count(*) n FROM customer)) e ON 'customer' || e.a = r.name WHERE e.b % 11 <> 5) SELECT name, 'd' || (CAST(substr(name, 9) AS BIGINT) % 3) || '/' || name AS path FROM r",
    "assembly_path_priority": "SELECT file_name, min_by(path, dir_rank) AS path FROM (SELECT lower(p_name) file_name, p_brand || '/' || p_name AS path, p_partkey dir_rank FROM part) GROUP BY file_name",
    "throws_edges": sql("SELECT iri s, target o FROM docs2 JOIN memb USING (o) WHERE et = 'error' AND vis AND kind = 'method'", "memb", "docs2"),
    "related_edges": sql("SELECT iri s, target o FROM docs2 JOIN memb USING (o) WHERE et = 'view' AND vis AND kind IN ('method', 'property')", "memb", "docs2"),
    "overrides_edges": sql(f"SELECT iri s, over_iri o FROM {OVER} WHERE kind <> 'field'", "memb"),
    "implements_edges": sql(f"SELECT iri s, f_iri o FROM {FACES}", "ctype", "pq"),
    "inherits_edges": sql(f"SELECT iri s, b_iri o FROM {BASES}", "ctype"),
    "q1_methods_that_throw": sql(f"SELECT DISTINCT m.iri AS method, m.nm AS \"methodName\", t.c_name AS \"typeName\" FROM docs2 d JOIN memb m USING (o) JOIN ctype t ON t.k = m.c JOIN pdef x ON x.p = d.p WHERE d.et = 'error' AND m.vis AND m.kind = 'method' AND m.lv = '1' AND x.p_name IN ('{FLAGSHIP}')", "memb", "docs2"),
    "q2_classes_implementing": sql("SELECT t.iri AS class, t.c_name AS \"className\" FROM ctype t JOIN pdef d ON d.p = t.k % d.n JOIN pq q ON q.p = d.p WHERE t.vis AND t.k % 6 = 5 AND t.kind = 'Class' AND t.k % 11 <> 0 AND left(d.p_name, 1) IN ('b', 'o', 'r')", "ctype", "pq"),
    "vocab_subclass_join": sql("SELECT iri subject, CASE WHEN kind IN ('Class', 'Struct', 'Interface', 'Enum', 'Delegate') THEN 'Type' END super FROM ctype WHERE vis", "ctype"),
    "page_links": "SELECT page_id, CAST(pos - 1 AS INTEGER) pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) pos FROM pages)",
}
