"""The symbol-graph engine on fixtures with complete expected results."""

import pytest
from pyspark.sql import functions as F

from symloom import vocab
from symloom.functions import docs as D
from symloom.functions import identity as I
from symloom.functions import literals as L
from symloom.operators import closure, crefs, filters
from symloom.options import ExtractionOptions
from symloom.plans.bgp import Iri, Lit, Var, solve
from symloom.plans.extract import Extraction
from symloom.sources import loader, tables, triples

DT = "http://test.example/ontology/"
ASM = {"asm_id": "x", "name": "Test Asm", "version": "0.0.0.0", "is_target": True}
OUTSIDE = {"asm_id": "y", "name": "Lib", "version": "1.0", "is_target": False}
NS = {"ns_id": "n", "name": "N", "full_name": "N", "is_global": False}


def type_(i, **more):
    return {"type_id": i, "shape": "named", "asm_id": "x", "ns_id": "n", "name": i, "display_name": f"N.{i}", "type_kind": "Class", "accessibility": "Public", "special_type": "None", "arity": 0, **more}


def member(i, owner, kind="method", **more):
    return {"member_id": i, "type_id": owner, "pos": 0, "member_kind": kind, "name": i, "accessibility": "Public", "method_kind": "Ordinary" if kind == "method" else None, "returns_void": True if kind == "method" else None, **more}


def run(spark, mode="canonical", **rows):
    options = {k: rows.pop(k) for k in list(rows) if k.startswith(("include_", "extract_"))}
    rows = {"assemblies": [ASM, OUTSIDE], "namespaces": [NS], **rows}
    return Extraction(tables.of_rows(spark, **rows), ExtractionOptions(base_uri="http://test.example///", mode=mode, **options))


def short(df):
    return sorted((r.subject.rsplit("/type/", 1)[-1], r.predicate.replace(DT, "").replace(vocab.RDF_TYPE, "a"), r.object.replace(DT, "").rsplit("/type/", 1)[-1]) for r in df.collect())


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "iri"), [("", ""), ("a b", "a%20b"), ("é世", "é世"), ("List`1", "List%601"), ("A+B", "A%2BB"), ("x[]*", "x%5B%5D%2A"), ("™", "%E2%84%A2"), ("\U0001f600", "%EF%BF%BD%EF%BF%BD"), ("-_.~9", "-_.~9")])
def test_escape(spark, text, iri):
    assert one(spark, I.escape(F.lit(text))) == iri


def test_bases():
    assert I.base_of("http://test.example///") == "http://test.example" and I.base_of("") == ""


@pytest.mark.parametrize(("text", "line"), [("", ""), ('\\ \n " \r \t', '\\\\ \\n \\" \\r \\t'), ("\x01\x02\x1f", "\\u0001\\u0002\\u001F"), ("世\U0001f600\x7f", "世\U0001f600\x7f")])
def test_literal_escape_and_back(spark, text, line):
    assert one(spark, L.escape_literal(F.lit(text))) == line
    assert one(spark, L.unescape_literal(F.lit(line))) == text


def test_lines(spark):
    rows = [("s", "p", "o", True, None), ("s", "p", "a\nb", False, None), ("s", "p", "true", False, vocab.XSD_BOOLEAN), ("s", "p", "-42", False, vocab.XSD_INTEGER), ("s", "p", "7", False, vocab.XSD_LONG)]
    bag = spark.createDataFrame(rows, "subject string, predicate string, object string, is_iri boolean, datatype string")
    nt = [r.line for r in triples.lines(bag).collect()]
    assert nt == ["<s> <p> <o> .", '<s> <p> "a\\nb" .', f'<s> <p> "true"^^<{vocab.XSD_BOOLEAN}> .', f'<s> <p> "-42"^^<{vocab.XSD_INTEGER}> .', f'<s> <p> "7"^^<{vocab.XSD_LONG}> .']
    assert [r.line for r in triples.lines(bag, "ttl").collect()] == [*nt[:2], "<s> <p> true .", "<s> <p> -42 .", nt[4]]
    told = bag.withColumn("verb", F.when(F.col("object") == "true", "bool").when(F.col("object") == "-42", "typed"))
    assert [r.line for r in triples.lines(told, "ttl").collect()] == [*nt[:2], "<s> <p> true .", *nt[3:]]
    assert [r.line for r in triples.lines(told).collect()] == nt


def test_headers():
    assert triples.nt_header([("a", "x"), ("a", "y")]) == ["# @prefix a: <x> .", "# @prefix a: <y> ."]
    assert triples.ttl_header([("a", "x"), ("b", "z"), ("a", "y")]) == ["@prefix a: <y> .", "@prefix b: <z> .", ""]
    assert triples.ttl_header([("a", "x")], any_triples=False) == [] == triples.ttl_header([])


def test_files_round_trip(spark, tmp_path):
    rows = [("http://a/member/M(ref T`1[x y])", "http://p", 'q"\\\n\x01\t', False, None), ("s", "http://p", "http://o", True, None), ("s", "http://q", "1", False, vocab.XSD_INTEGER), ("s", "http://q", "1", False, vocab.XSD_INTEGER), ("s", "http://q", "", False, None)]
    bag = spark.createDataFrame(rows, "subject string, predicate string, object string, is_iri boolean, datatype string")
    for one_file in (False, True):
        path = f"{tmp_path}/{one_file}"
        triples.write_lines(bag, path, "nt", triples.standard_prefixes("http://b/"), one_file=one_file)
        assert sorted(map(tuple, triples.read_nt(spark, path).collect()), key=str) == sorted(rows, key=str)
    triples.write_store(bag, f"{tmp_path}/store")
    assert triples.read_store(spark, f"{tmp_path}/store").count() == 5


def test_visibility(spark):
    access = ("Public", "Private", "Internal", "Protected", "ProtectedAndInternal", "ProtectedOrInternal", "NotApplicable")
    rows = spark.createDataFrame([(a, i) for a in access for i in (False, True)], "accessibility string, is_implicit boolean")
    for n in range(8):
        private, internal, generated = n & 1 > 0, n & 2 > 0, n & 4 > 0
        o = ExtractionOptions(include_private=private, include_internal=internal, include_compiler_generated=generated)
        want = {(a, i) for a in access for i in (False, True) if (generated or not i) and (private or a != "Private") and (internal or a not in ("Internal", "ProtectedAndInternal"))}
        assert {tuple(r) for r in filters.visible_types(rows, o).collect()} == want


def test_complete_graph_of_a_small_assembly(spark):
    x = run(spark, types=[type_("A", walk_rank=0), type_("I", type_kind="Interface", asm_id="y")], type_ifaces=[{"type_id": "A", "pos": 0, "iface_type_id": "I"}], members=[member("M", "A")])
    got = short(x.triples())
    a, i, m = "Test%20Asm/0.0.0.0/N.A", "Lib/1.0/N.I", "Test%20Asm/0.0.0.0/N.A/member/M()"
    ns, asm = "http://test.example/namespace/N", "http://test.example/assembly/Test%20Asm/0.0.0.0"
    want = [(asm, "a", "Assembly"), (asm, "name", "Test Asm"), (asm, "version", "0.0.0.0"), (asm, "isInteractive", "false"), (ns, "a", "Namespace"), (ns, "name", "N"), (ns, "fullName", "N")]
    want += [(a, "a", "Type"), (a, "a", "Class"), (a, "name", "A"), (a, "fullName", "N.A"), (a, "typeKind", "Class"), (a, "accessibility", "Public"), *((a, n, "false") for n, _ in vocab.TYPE_FLAGS), (a, "definedInAssembly", asm), (a, "inNamespace", ns), (a, "implements", i)]
    want += [(i, "a", "Type"), (i, "name", "I"), (i, "fullName", "N.I"), (i, "typeKind", "Interface"), (i, "definedInAssembly", "http://test.example/assembly/Lib/1.0"), (i, "inNamespace", ns)]
    want += [(m, "a", "Member"), (m, "a", "Method"), (m, "name", "M"), (m, "accessibility", "Public"), (m, "methodKind", "Ordinary"), *((m, n, "false") for n, _ in vocab.METHOD_FLAGS), (a, "hasMember", m), (m, "memberOf", a)]
    assert got == sorted(want)


def test_external_types_off(spark):
    x = run(spark, types=[type_("A", walk_rank=0, base_type_id="B"), type_("B", asm_id="y")], include_external_types=False)
    got = short(x.triples())
    assert ("Test%20Asm/0.0.0.0/N.A", "inherits", "Lib/1.0/N.B") in got and not any(s.startswith("Lib") for s, _, _ in got)


def test_object_base_and_nesting(spark):
    x = run(spark, types=[type_("A", walk_rank=0, base_type_id="O", accessibility="Private"), type_("O", asm_id="y", special_type="System_Object"), type_("C", walk_rank=1, containing_type_id="A", base_type_id="O")])
    got = short(x.type_triples())
    c = "Test%20Asm/0.0.0.0/N.A%2BC"
    assert (c, "nestedIn", "Test%20Asm/0.0.0.0/N.A") in got and not any(p == "inherits" for _, p, _ in got) and {s for s, _, _ in got} == {c}
    assert [r.iri for r in x.stubs.collect()] == []


def test_generics_arrays_pointers(spark):
    types = [type_("A", walk_rank=0), type_("L", asm_id="y", arity=1), type_("LA", name="L", asm_id="y", arity=1, original_def_id="L"), {"type_id": "arr", "shape": "array", "display_name": "N.LA[]", "rank": 1, "element_type_id": "LA"}, {"type_id": "ptr", "shape": "pointer", "display_name": "N.A*", "element_type_id": "A"}]
    types += [{"type_id": "T", "shape": "type_param", "name": "T", "owner_name": "N.L"}, type_("LT", name="L", asm_id="y", arity=1, original_def_id="L")]
    x = run(spark, types=types, type_args=[{"type_id": "LA", "pos": 0, "arg_type_id": "A"}, {"type_id": "LT", "pos": 0, "arg_type_id": "T"}], members=[member("P", "A", "property", value_type_id="arr", has_setter=True), member("Q", "A", "field", value_type_id="ptr", has_const=True)])
    got = short(x.triples())
    la, arr, ptr = "Lib/1.0/N.L%601%5BN.A%5D", "_builtin_/N.L%601%5BN.A%5D%5B%5D", "_builtin_/N.A%2A"
    assert {(la, "genericDefinition", "Lib/1.0/N.L%601"), (la, "typeArgument", f"{la}/typearg/0"), (f"{la}/typearg/0", "index", "0"), (f"{la}/typearg/0", "type", "Test%20Asm/0.0.0.0/N.A"), (arr, "arrayRank", "1"), (arr, "arrayElementType", la), (ptr, "pointerElementType", "Test%20Asm/0.0.0.0/N.A")} <= set(got)
    assert ("Test%20Asm/0.0.0.0/N.A/member/P", "isInitOnly", "false") in got and ("Test%20Asm/0.0.0.0/N.A/member/Q", "constValue", "null") in got
    assert {r.type_id: r.meta_name for r in x.names.collect()}["LT"] == "N.L`1"


def test_first_touch(spark):
    rows = dict(types=[type_("A", walk_rank=0), type_("B", walk_rank=1)], members=[member("P", "A", "property", value_type_id="B"), member("Q", "B", "property", value_type_id="A")])
    assert {r.type_id for r in run(spark, **rows).full.collect()} == {"A", "B"}
    x = run(spark, "first_touch", **rows)
    b = "Test%20Asm/0.0.0.0/N.B"
    assert [p for s, p, _ in short(x.triples()) if s == b] == ["a", "definedInAssembly", "fullName", "inNamespace", "name", "typeKind"]
    assert not any(s == b for s, _, _ in short(run(spark, "first_touch", include_external_types=False, **rows).triples()))


def test_signatures(spark):
    params = [{"owner_member_id": "M", "ordinal": 1, "name": "b", "type_id": "A", "ref_kind": "Out"}, {"owner_member_id": "M", "ordinal": 0, "name": "a", "type_id": "A", "ref_kind": "Ref"}, {"owner_member_id": "I", "ordinal": 0, "name": "i", "type_id": "A", "ref_kind": "In"}]
    x = run(spark, types=[type_("A", walk_rank=0)], members=[member("M", "A"), member("I", "A", "property", name="this[]", is_indexer=True)], params=params)
    assert {r.member_id: r.iri.rsplit("/member/")[-1] for r in x.members.collect()} == {"M": "M(ref N.A,out N.A)", "I": "this%5B%5D[N.A]"}


def test_attribute_index_runs_on(spark):
    attr = lambda pos, cls, ret=False: {"target_kind": "method", "target_id": "M", "pos": pos, "is_return": ret, "class_type_id": cls}
    x = run(spark, types=[type_("A", walk_rank=0), type_("Mark", asm_id="y")], members=[member("M", "A")], attributes=[attr(0, None), attr(1, "Mark"), attr(0, "Mark", True)])
    m = "Test%20Asm/0.0.0.0/N.A/member/M()"
    assert [t for t in short(x.attribute_triples()) if t[1] == "hasAttribute"] == [(m, "hasAttribute", f"{m}/attr/1"), (f"{m}/return", "hasAttribute", f"{m}/attr/2")]


def test_bad_owners_and_targets(spark):
    for expr in (I.type_parameter_iri(F.lit("field"), F.lit("x"), F.lit(0)), I.attribute_iri(F.lit("namespace"), F.lit("x"), F.lit(0))):
        with pytest.raises(Exception, match="type parameter owner|no IRI"):
            one(spark, expr)


@pytest.mark.parametrize(("xml", "want"), [('<d><exception cref="T:A"/><p><exception cref="T:A"/></p><exception/></d>', ["T:A", "T:A"]), ("<d><exception", None), ("", None), ("  ", None), ("<d/>", []), ('<d><exception cref=""/></d>', [])])
def test_crefs_of_xml(spark, xml, want):
    assert one(spark, D.crefs(F.lit(xml), "exception")) == want


def test_cref_resolution(spark):
    types = spark.createDataFrame([("a", "N.A"), ("in", "N.A+In"), ("d1", "N.D"), ("d2", "N.D")], "type_id string, lookup_name string")
    rows = [("m1", "a", "M", "method", 1, ["Int32"]), ("m2", "a", "M", "method", 2, ["N.A", "N.A"]), ("m3", "a", "M", "method", 5, ["N.A+In", "In[]"]), ("c", "a", ".ctor", "method", 3, None), ("p", "a", "P", "property", 4, None)]
    members = spark.createDataFrame(rows, "member_id string, type_id string, name string, member_kind string, pos long, param_names array<string>")
    asked = {"T:N.A": "a", "N.A": "a", "T:N.A+In": "in", "T:N.A.In": None, "T:N.D": None, "M:N.A.M": "m1", "M:N.A.M(N.A,N.A)": "m2", "M:N.A.M(A,N.A)": "m2", "M:N.A.M(In,In[])": "m3", "M:N.A.M(In,)": "m1", "M:N.A.M(X,Y,Z)": "m1", "M:N.A.#ctor": "c", "P:N.A.P": "p", "N.A.P": "p", "N:N": None, "!:N.A": None, "M:N.A.Gone": None, "M:N.A.#ctor()": "c"}
    got = crefs.resolve(spark.createDataFrame([(c,) for c in asked], "cref string"), types, members)
    assert {r.cref: r.target_id for r in got.collect()} == {k: v for k, v in asked.items() if v}


def test_assembly_closure(spark):
    names = lambda rows, schema: spark.createDataFrame(rows, schema)
    refs = names([("A", "b"), ("B", "C"), ("c", "A"), ("A", "gone"), ("gone", "D")], "name string, ref string")
    files = names([("a", "1/a", 0), ("B", "2/b", 1), ("B", "1/b", 0), ("c", "1/c", 0), ("d", "1/d", 0)], "file_name string, path string, dir_rank int")
    extra = names([("C", "x/c"), ("E", "x/e")], "name string, path string")
    got = closure.assembly_closure(names([("a",)], "name string"), refs, files, extra)
    assert {(r.name, r.path) for r in got.collect()} == {("a", "1/a"), ("b", "1/b"), ("c", "1/c"), ("e", "x/e")}


def test_missing_tables(spark, tmp_path):
    with pytest.raises(tables.AssemblyNotFound, match="Assembly not found"):
        tables.load(spark, f"{tmp_path}/none")
    tables.of_rows(spark, assemblies=[ASM])["assemblies"].write.parquet(f"{tmp_path}/t/assemblies.parquet")
    assert Extraction(tables.load(spark, f"{tmp_path}/t")).triples().count() == 4


def test_patterns(spark):
    rows = [("m", "throws", "e", True, None), ("m", "throws", "e", True, None), ("e", "name", "Oops", False, None), ("f", "name", "Oops", False, "dt"), ("m", "name", "Run", False, None)]
    bag = spark.createDataFrame(rows, "subject string, predicate string, object string, is_iri boolean, datatype string")
    m, e = Var("m"), Var("e")
    got = solve(bag, [(m, Iri("throws"), e), (e, Iri("name"), Lit("Oops")), (m, Iri("name"), Var("n"))], ["m", "n"])
    assert [tuple(r) for r in got.collect()] == [("m", "Run")]
    with pytest.raises(ValueError, match="shares no variable"):
        solve(bag, [(m, Iri("throws"), Iri("e")), (e, Iri("name"), Lit("Oops"))])


def test_command_line(spark, tmp_path, capsys):
    from symloom import cli

    assert cli.main([f"{tmp_path}/none"], spark) == 1 and "Assembly not found" in capsys.readouterr().err
    for name, rows in tables.of_rows(spark, assemblies=[ASM], namespaces=[NS], types=[type_("A", walk_rank=0)]).items():
        rows.write.parquet(f"{tmp_path}/in/{name}.parquet")
    assert cli.main([f"{tmp_path}/in", "-f", "Turtle", "-q", "--one-file"], spark) == 0 and not capsys.readouterr().out
    lines = [r.value for r in spark.read.text(f"{tmp_path}/in.ttl").collect()]
    assert lines[0].startswith("@prefix rdf:") and lines[4] == "" and any(x.endswith("isInteractive> false .") for x in lines)


def test_streams(spark, tmp_path):
    from symloom.streaming import triples as S

    rows = [("a", f"{DT}name", "A", False, None), ("b", f"{DT}name", "B", False, None)]
    bag = spark.createDataFrame(rows, "subject string, predicate string, object string, is_iri boolean, datatype string")
    bag.coalesce(1).write.parquet(f"{tmp_path}/in")
    S.append_store(S.read(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store").where("p = 'name'").count() == 2
    again = lambda: S.append_known_once(S.read(spark, f"{tmp_path}/in"), f"{tmp_path}/known", f"{tmp_path}/once", f"{tmp_path}/c2").awaitTermination()
    again()
    bag.limit(1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again()
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2


def test_ids_may_overlap_across_kinds(spark):
    doc = '<doc><exception cref="T:N.E"/></doc>'
    rows = {"types": [type_("1", walk_rank=0), type_("E", walk_rank=1)], "members": [{"member_id": "1", "type_id": "1", "pos": 0, "member_kind": "method", "name": "Run", "accessibility": "Public", "method_kind": "Ordinary", "returns_void": True}]}
    docs = [{"owner_kind": "member", "owner_id": "1", "xml": doc}]
    got = Extraction(tables.of_rows(spark, assemblies=[ASM], namespaces=[NS], docs=docs, **rows)).throws_triples().collect()
    assert len(got) == 1 and "/member/Run" in got[0].subject


def test_literals_are_not_iris_in_patterns(spark):
    rows = [("a", "p", "e", False, None), ("b", "p", "e", True, None), ("e", "q", "x", False, None), ("c", "r", "x", False, "dt"), ("d", "r", "x", False, None)]
    bag = spark.createDataFrame(rows, "subject string, predicate string, object string, is_iri boolean, datatype string")
    s, e, v, o = Var("s"), Var("e"), Var("v"), Var("o")
    assert [tuple(r) for r in solve(bag, [(s, Iri("p"), e), (e, Iri("q"), v)], ["s", "e"]).collect()] == [("b", "e")]
    assert [tuple(r) for r in solve(bag, [(e, Iri("q"), v), (o, Iri("r"), v)], ["o"]).collect()] == [("d",)]


def test_header_is_read_with_the_lines(spark, tmp_path):
    bag = spark.createDataFrame([("a", f"{DT}name", str(i), False, None) for i in range(20)], "subject string, predicate string, object string, is_iri boolean, datatype string").repartition(3)
    triples.write_lines(bag, f"{tmp_path}/out", "ttl", [("x", "http://x/")])
    got = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert got.count("@prefix x: <http://x/> .") == 1 and len(got) == 22
    first = min(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert first.read_text() == "@prefix x: <http://x/> .\n\n"


def _folder(spark, path, **rows):
    for name, table in tables.of_rows(spark, **rows).items():
        if name in rows:
            table.write.parquet(f"{path}/{name}.parquet")


def _manifest(own, *names):
    return [{"assembly": own, "name": n} for n in names]


def test_loader_follows_manifests(spark, tmp_path):
    lib = {"asm_id": "l", "name": "Lib", "version": "2.0", "is_target": True}
    outer = type_("Base", asm_id="l", walk_rank=0, name="Base")
    _folder(spark, tmp_path / "app/App", assemblies=[ASM], namespaces=[NS], types=[type_("A", walk_rank=0, base_type_id="Base")], manifest=_manifest("App", "LIB", "Gone"))
    _folder(spark, tmp_path / "one/lib", assemblies=[lib], namespaces=[NS], types=[outer], manifest=_manifest("Lib", "Deep", "App"))
    _folder(spark, tmp_path / "two/Lib", assemblies=[{**lib, "version": "9.9"}], types=[outer], manifest=_manifest("Lib", "Shadowed"))
    _folder(spark, tmp_path / "two/Deep", types=[outer, type_("D", walk_rank=5)])
    _folder(spark, tmp_path / "two/Shadowed", types=[type_("S")])
    for name in ("Gone", "deep", "Late"):
        _folder(spark, tmp_path / "more" / name, types=[type_(f"Extra{name}")])

    def load(*search):
        x = loader.Loader(spark)
        for folder in (*search, "none"):
            x.add_search_dir(f"{tmp_path}/{folder}")
        for name in ("Gone", "deep", "Late", "none"):
            x.add_reference(f"{tmp_path}/more/{name}")
        return x, x.load(f"{tmp_path}/app/App")

    x, got = load("one", "two")
    ids = lambda t: sorted(r.type_id for r in t["types"].collect())
    assert ids(got) == ["A", "Base", "D", "ExtraLate"]  # Gone was asked for in vain, Deep is known, Shadowed is hidden
    assert sorted((r.asm_id, r.version, r.is_target) for r in got["assemblies"].collect()) == [("l", "2.0", False), ("x", "0.0.0.0", True)]
    triples_of = Extraction(got, ExtractionOptions(base_uri="http://test.example/"))
    assert [r.object for r in triples_of.type_triples().where(f"predicate = '{DT}inherits'").collect()] == ["http://test.example/type/Lib/2.0/N.Base"]
    assert triples_of.full.count() == 1
    assert ids(load("two", "one")[1]) == ["A", "Base", "ExtraLate", "Extradeep", "S"]
    before = list(x.search)
    assert ids({"types": x.load(f"{tmp_path}/two/Deep")["types"]}) == ["Base", "D", "ExtraGone", "ExtraLate"]
    assert x.search == [*before, f"{tmp_path}/two"]
