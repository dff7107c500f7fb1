"""The query catalogue: each operator applied to the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import vocab
from symloom.functions import docs as D
from symloom.functions import identity as I
from symloom.functions import literals as L
from symloom.operators import closure, crefs, filters
from symloom.operators import project as P
from symloom.options import ExtractionOptions
from symloom.plans import oracle, whole, wide
from symloom.plans.bgp import Iri, Lit, Var, solve
from symloom.plans.extract import Extraction
from symloom.sources import star, triples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OPTIONS = ExtractionOptions()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_made: dict[tuple, Extraction] = {}
#: Queries whose SQL holds them to part of their table; ``NAME_all`` is registered in their place.
SUBSETS = ("iri_type", "iri_namespace", "type_class", "nt_lines", "ttl_lines", "triple_count", "triples_by_class", "type_closure", "stub_types", "nested_types_walk", "namespace_ancestors", "cref_type")


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every file of the star schema's tables."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in star.SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def of(spark: SparkSession, sf_dir: str, wide: bool = False, **options) -> Extraction:
    """The extraction of a data folder.  Queries of one session share its written tables while the folder's files stay the same."""
    key = (spark.sparkContext.applicationId, sf_dir, wide, tuple(sorted(options.items())), stamp(spark, sf_dir))
    if key not in _made:
        _made[key] = Extraction(star.load(spark, sf_dir, wide), ExtractionOptions(**options))
    return _made[key]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query
def iri_escape_names(spark, d):
    names = raw(spark, d, "customer").select(F.col("c_name").alias("s"))
    for table, column in (("region", "r_name"), ("part", "p_name"), ("part", "p_brand")):
        names = names.unionByName(raw(spark, d, table).select(F.col(column).alias("s")))
    names = names.unionByName(values(spark, [(s,) for s in oracle.EDGE_STRINGS], "s string")).distinct()
    return names.select("s", I.escape(F.col("s")).alias("iri"))


@query
def iri_assembly(spark, d):
    return of(spark, d).assemblies.select(F.col("asm_id").cast("int").alias("key"), "iri")


@query
def iri_namespace(spark, d):
    return of(spark, d).namespaces.where("startswith(ns_id, 'n')").select(F.col("ns_id").alias("key"), "iri")


@query
def iri_namespace_all(spark, d):
    """Every namespace; ``iri_namespace`` is held to the nations by its SQL form."""
    return of(spark, d).namespaces.select(F.col("ns_id").alias("key"), "iri")


@query
def iri_type(spark, d):
    return of(spark, d).types.where("startswith(type_id, 'c')").select(F.col("type_id").alias("key"), "iri")


@query
def iri_type_all(spark, d):
    """Types of every shape; ``iri_type`` is held to the target types by its SQL form."""
    return of(spark, d).types.select(F.col("type_id").alias("key"), "iri")


@query
def iri_member(spark, d):
    return of(spark, d).members.select(F.col("member_id").alias("key"), "iri")


@query
def iri_parameter(spark, d):
    return of(spark, d).parameters.select(F.col("owner_iri").alias("key"), "iri")


@query
def iri_typeparam(spark, d):
    x = of(spark, d)
    rows = x.t["type_params"].join(x.type_iris.select(F.col("type_id").alias("owner_id"), F.col("iri").alias("owner_iri")), "owner_id")
    return rows.select(F.col("tp_id").alias("key"), I.type_parameter_iri(F.col("owner_kind"), F.col("owner_iri"), F.col("ordinal")).alias("iri"))


@query
def iri_attribute(spark, d):
    return of(spark, d).attribute_rows().where("class_iri is not null").select(F.col("owner").alias("key"), "iri")


@query
def metadata_name_generic(spark, d):
    return of(spark, d).names.where("startswith(type_id, 'q')").select(F.substring("type_id", 2, 20).cast("long").alias("p_partkey"), "meta_name")


@query
def member_signature(spark, d):
    return of(spark, d).members.where("member_kind = 'method'").select(F.col("pos").alias("o_orderkey"), "sig")


@query
def type_class(spark, d):
    return of(spark, d).t["types"].where("startswith(type_id, 'c')").select(F.col("walk_rank").alias("c_custkey"), I.type_class(F.col("type_kind"), F.col("is_record")).alias("cls"))


@query
def type_class_all(spark, d):
    return of(spark, d).t["types"].select(F.col("type_id").alias("key"), I.type_class(F.col("type_kind"), F.col("is_record")).alias("cls"))


@query
def attr_args_text(spark, d):
    rows = of(spark, d).attribute_rows().where("class_iri is not null and (size(ctor_args) > 0 or size(named_args) > 0)")
    text = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(c, f), ", "))
    return rows.select(F.col("owner").alias("key"), text("ctor_args", I.constant_text).alias("ctor"), text("named_args", lambda a: F.concat(a["key"], F.lit("="), I.constant_text(a["value"]))).alias("named"))


@query
def key_token_hex(spark, d):
    return of(spark, d).t["assemblies"].select(F.col("asm_id").cast("int").alias("key"), I.key_token_hex(F.col("public_key_token")).alias("hex"))


@query
def cref_split(spark, d):
    return values(spark, [(c,) for c in oracle.CREFS], "cref string").select("cref", D.cref_prefix(F.col("cref")).alias("prefix"), D.cref_name(F.col("cref")).alias("name"))


@query
def cref_params_split(spark, d):
    return values(spark, [(c,) for c in oracle.PARAM_LISTS], "cref string").select("cref", F.posexplode(D.split_params(F.col("cref"))).alias("pos", "part"))


def _controls(text):
    return F.concat(F.lit('\x01\x02\x1f\\"\t\r'), text)


@query
def literal_escape(spark, d):
    return raw(spark, d, "documents").select("doc_id", L.escape_literal(_controls(F.col("text"))).alias("esc"))


def _own_type_triples(spark, d):
    x = of(spark, d)
    rows = x._placed(x.full, x.terms).withColumns({c: F.lit(None).cast("string") for c in ("base_iri", "base_special", "outer_iri", "enum_iri")})
    return P.types(rows, x.terms)


@query
def nt_lines(spark, d):
    return triples.lines(_own_type_triples(spark, d), "nt")


@query
def ttl_lines(spark, d):
    return triples.lines(_own_type_triples(spark, d), "ttl")


@query
def nt_lines_all(spark, d):
    """Lines of the whole bag, no column emptied; ``nt_lines`` is held to the types' own triples by its SQL form."""
    return triples.lines(of(spark, d).triples(), "nt")


@query
def ttl_lines_all(spark, d):
    return triples.lines(of(spark, d).triples(), "ttl")


def _numbered(spark, lines):
    return values(spark, list(enumerate(lines)), "pos int, line string")


@query
def nt_header(spark, d):
    return _numbered(spark, triples.nt_header(triples.standard_prefixes(OPTIONS.base_uri)))


@query
def ttl_header(spark, d):
    return _numbered(spark, triples.ttl_header(triples.standard_prefixes(OPTIONS.base_uri)))


@query
def nt_roundtrip(spark, d):
    t = P.Terms(OPTIONS)
    rows = raw(spark, d, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("iri"), F.concat(F.lit('\x01\\"\t'), F.col("text")).alias("x"), F.col("doc_id").alias("n"))
    bag = P.emit(rows, [t.lit(F.col("iri"), "text", F.col("x")), t.int(F.col("iri"), "id", F.col("n"))])
    return triples.lines(bag).select(*triples.parse_nt(F.col("line")))


@query
def triple_count(spark, d):
    return of(spark, d).parameter_triples().agg(F.count(F.lit(1)).alias("n"))


@query
def triples_by_class(spark, d):
    x = of(spark, d)
    bag = x.type_triples()
    for more in (x.method_triples(), x.property_triples(), x.field_triples(), x.event_triples()):
        bag = bag.unionByName(more)
    return bag.where(F.col("predicate") == vocab.RDF_TYPE).groupBy(F.substring_index("object", "/", -1).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query
def triple_count_all(spark, d):
    """Every emitted triple; ``triple_count`` is held to the parameters' by its SQL form."""
    return of(spark, d).triples(columns=("object",)).agg(F.count(F.lit(1)).alias("n"))


@query
def triples_by_class_all(spark, d):
    bag = of(spark, d).triples({vocab.RDF_TYPE: None}, ("object",))
    return bag.groupBy(F.substring_index("object", "/", -1).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query
def triples_by_predicate(spark, d):
    return of(spark, d).triples(columns=("predicate", "object")).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def _sets():
    return [ExtractionOptions(include_private=p, include_internal=i, include_compiler_generated=g) for p, i, g in oracle.SETS]


def _visible(rows, key, choose):
    out = None
    for i, o in enumerate(_sets()):
        part = choose(rows, o).select(F.lit(i).alias("options"), F.col(key).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def visible_types(spark, d):
    return _visible(of(spark, d).t["types"].where("startswith(type_id, 'c')"), "type_id", filters.visible_types)


@query
def visible_members(spark, d):
    return _visible(of(spark, d).t["members"], "member_id", filters.visible_members)


@query
def member_kind_filter(spark, d):
    everything = ExtractionOptions(include_private=True, include_compiler_generated=True)
    return filters.visible_members(of(spark, d).t["members"], everything).select(F.col("member_id").alias("key"), F.col("member_kind").alias("kind"))


@query
def project_assembly(spark, d):
    return of(spark, d).assembly_triples()


@query
def project_namespace(spark, d):
    return of(spark, d).namespace_triples()


@query
def project_type(spark, d):
    return of(spark, d).type_triples()


@query
def project_method(spark, d):
    return of(spark, d).method_triples()


@query
def project_property(spark, d):
    return of(spark, d).property_triples()


@query
def project_field(spark, d):
    return of(spark, d).field_triples()


@query
def project_event(spark, d):
    return of(spark, d).event_triples()


@query
def project_parameter(spark, d):
    return of(spark, d).parameter_triples()


@query
def project_attribute(spark, d):
    return of(spark, d).attribute_triples()


@query
def project_type_parameter(spark, d):
    x = of(spark, d)
    rows = x.t["type_params"].join(x.type_iris.select(F.col("type_id").alias("owner_id"), F.col("iri").alias("owner_iri")), "owner_id")
    return P.type_parameters(rows.withColumn("iri", I.type_parameter_iri(F.col("owner_kind"), F.col("owner_iri"), F.col("ordinal"))), x.terms)


@query
def generic_block(spark, d):
    x = of(spark, d)
    made = x.types.where(filters.constructed(F.col("arity"), F.col("is_unbound"), F.col("original_def_id"), F.col("type_id")))
    args = x._ref(x.t["type_args"], "arg_type_id", "arg_iri", "type_id").join(made.select("type_id", "iri"), "type_id")
    return P.generic_definitions(x._ref(made, "original_def_id", "def_iri"), x.terms).unionByName(P.generic_arguments(args, x.terms))


@query
def stub_arrays(spark, d):
    x = of(spark, d)
    return P.stub_arrays(x._ref(x.types.where("shape = 'array'"), "element_type_id", "element_iri"), x.terms)


@query
def stub_pointers(spark, d):
    x = of(spark, d)
    return P.stub_pointers(x._ref(x.types.where("shape = 'pointer'"), "element_type_id", "element_iri"), x.terms)


@query
def type_closure(spark, d):
    return of(spark, d, include_attributes=False).stubs.select("iri")


@query
def type_closure_all(spark, d):
    """By the default options; ``type_closure`` is held to references outside attributes by its SQL form."""
    return of(spark, d).stubs.select("iri")


@query
def stub_types(spark, d):
    x = of(spark, d, include_attributes=False)
    return P.stub_types(x._placed(x.stubs.where("shape = 'named'"), x.terms), x.terms)


@query
def stub_types_all(spark, d):
    x = of(spark, d)
    return P.stub_types(x._placed(x.stubs.where("shape = 'named'"), x.terms), x.terms)


@query
def emitted_once(spark, d):
    x = of(spark, d)
    t = P.Terms(OPTIONS, {vocab.RDF_TYPE: x.terms.term("Type")}, ("subject", "object"))
    bag = P.union(x.type_triples(t), x.stub_triples(t)).where(F.endswith("object", F.lit("/ontology/Type")))
    return bag.groupBy(F.col("subject").alias("iri")).agg(F.count(F.lit(1)).alias("n"))


@query
def nested_types_walk(spark, d):
    return closure.walk(of(spark, d).t["types"].where("startswith(type_id, 'c')")).select(F.col("type_id").alias("key"), "depth", "path")


@query
def nested_types_walk_all(spark, d):
    return closure.walk(of(spark, d).t["types"]).select(F.col("type_id").alias("key"), "depth", "path")


@query
def namespace_ancestors(spark, d):
    spaces = of(spark, d).t["namespaces"].where("substring(ns_id, 1, 1) in ('r', 'n')")
    return closure.ancestors(spaces).select(F.col("ns_id").alias("ns"), "ancestor")


@query
def namespace_ancestors_all(spark, d):
    return closure.ancestors(of(spark, d).t["namespaces"]).select(F.col("ns_id").alias("ns"), "ancestor")


def _references(spark, d, element):
    return crefs.references(of(spark, d).t["docs"], element).groupBy(F.col("owner_id").alias("owner"), "cref").agg(F.count(F.lit(1)).alias("n"))


@query
def doc_exceptions(spark, d):
    return _references(spark, d, "exception")


@query
def doc_seealso(spark, d):
    return _references(spark, d, "seealso")


@query
def doc_malformed_ignored(spark, d):
    docs = of(spark, d).t["docs"]
    return docs.where(D.crefs(F.col("xml"), "exception").isNull()).agg(F.count(F.lit(1)).alias("n"))


@query
def cref_type(spark, d):
    x = of(spark, d)
    asked = x.names.where("startswith(type_id, 'p')").select(F.concat(F.lit("T:"), F.col("meta_name")).alias("cref"))
    return crefs.resolve(asked, *x._lookup).where("target_kind = 'type'").select("cref", F.col("target_id").alias("target"))


@query
def cref_type_all(spark, d):
    """Asks for every type; constructed ones, arrays and pointers are no targets and have no row."""
    x = of(spark, d)
    asked = x.names.select(F.concat(F.lit("T:"), F.col("meta_name")).alias("cref"))
    return crefs.resolve(asked, *x._lookup).where("target_kind = 'type'").select("cref", F.col("target_id").alias("target"))


@query
def cref_member_first(spark, d):
    x = of(spark, d)
    asked = x.names.where("startswith(type_id, 'c')").select(F.concat(F.lit("M:"), F.col("meta_name"), F.lit(".#ctor")).alias("cref"))
    return crefs.resolve(asked, *x._lookup).where("target_kind = 'method'").select("cref", F.col("target_id").alias("target"))


def _methods_asked(x, inside):
    """A cref for every method, its parameter list being ``inside``, and what it resolves to."""
    lookup = x._lookup
    asked = lookup[1](True).where("member_kind = 'method'").join(x.names, "type_id")
    asked = asked.select(F.concat(F.lit("M:"), "meta_name", F.lit("."), F.replace("name", F.lit("."), F.lit("#")), F.lit("("), inside, F.lit(")")).alias("cref"))
    return crefs.resolve(asked, *lookup).where("target_kind = 'method'").select("cref", F.col("target_id").alias("target"))


@query
def cref_overload(spark, d):
    return _methods_asked(of(spark, d), F.coalesce(F.array_join("param_names", ","), F.lit("")))


@query
def cref_fallback(spark, d):
    """No overload fits the list, so the first by declaration order is taken."""
    return _methods_asked(of(spark, d), F.lit("No.Such"))


@query
def reference_closure(spark, d):
    customers = raw(spark, d, "customer").select("c_custkey")
    n = customers.count()
    name = lambda k: F.concat(F.lit("customer"), k.cast("string"))
    key = F.col("c_custkey")
    files = customers.where(key % 11 != 5).select(name(key).alias("file_name"), F.concat(F.lit("d"), (key % 3).cast("string"), F.lit("/"), name(key)).alias("path"), F.lit(0).alias("dir_rank"))
    refs = customers.select(F.upper(name(key)).alias("name"), name((key * 7 + 3) % n).alias("ref"))
    return closure.assembly_closure(values(spark, [("customer0",)], "name string"), refs, files)


@query
def assembly_path_priority(spark, d):
    files = raw(spark, d, "part").select(F.col("p_name").alias("file_name"), F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_partkey").alias("dir_rank"))
    return closure.resolve_paths(files.select("file_name"), files)


def _edges(bag, name):
    return bag.where(F.col("predicate") == f"{I.base_of(OPTIONS.base_uri)}/ontology/{name}").select(F.col("subject").alias("s"), F.col("object").alias("o"))


@query
def throws_edges(spark, d):
    return _edges(of(spark, d).throws_triples(), "throws")


@query
def related_edges(spark, d):
    return _edges(of(spark, d).related_triples(), "relatedTo")


@query
def overrides_edges(spark, d):
    return _edges(of(spark, d).override_triples(), "overridesMethod")


@query
def implements_edges(spark, d):
    x = of(spark, d)
    return _edges(x.type_triples(P.Terms(OPTIONS, {x.terms.term("implements"): None})), "implements")


@query
def inherits_edges(spark, d):
    x = of(spark, d)
    return _edges(x.type_triples(P.Terms(OPTIONS, {x.terms.term("inherits"): None})), "inherits")


def _term(name):
    return Iri(f"{I.base_of(OPTIONS.base_uri)}/ontology/{name}")


def _asked(x):
    """The part of the bag that a pattern can match, made when the pattern is read."""

    def part(predicate, obj):
        return x.triples(None if predicate is None else {predicate: obj if predicate == vocab.RDF_TYPE else None})

    return part


@query
def q1_methods_that_throw(spark, d):
    """Methods that throw a named exception."""
    m, t, e = Var("method"), Var("t"), Var("ex")
    patterns = [(m, Iri(vocab.RDF_TYPE), _term("Method")), (m, _term("name"), Var("methodName")), (m, _term("throws"), e), (m, _term("memberOf"), t), (t, _term("name"), Var("typeName")), (e, _term("name"), Lit(oracle.FLAGSHIP))]
    return solve(_asked(of(spark, d)), patterns, ["method", "methodName", "typeName"]).distinct()


@query
def q2_classes_implementing(spark, d):
    """Classes that implement an interface of one of the asked names."""
    c, i = Var("class"), Var("i")
    patterns = [(c, Iri(vocab.RDF_TYPE), _term("Class")), (c, _term("name"), Var("className")), (c, _term("implements"), i), (i, _term("name"), Var("ifaceName"))]
    return solve(_asked(of(spark, d)), patterns).where(F.substring("ifaceName", 1, 1).isin("b", "o", "r")).select("class", "className")


@query
def vocab_subclass_join(spark, d):
    x = of(spark, d)
    kinds = x.full.select(F.col("iri").alias("subject"), F.col("type_kind").alias("class"))
    return kinds.join(F.broadcast(vocab.class_table(spark)), "class", "left").select("subject", F.col("parent").alias("super"))


@query
def first_touch_full_types(spark, d):
    """Types that a sequential walk describes in full; no SQL form, tested on fixtures."""
    return of(spark, d, mode="first_touch").full.select("type_id", "iri")


@query
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return raw(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


# over the wide mapping of the star schema


@query
def wide_iri_member(spark, d):
    """Indexers take their parameters in brackets, methods an ``in``."""
    return of(spark, d, wide=True).members.select(F.col("member_id").alias("key"), "iri")


@query
def wide_member_kinds(spark, d):
    """Accessors and other kinds of methods are no members."""
    x = of(spark, d, wide=True)
    return x.seen(x.full).select(F.col("member_id").alias("key"), F.col("member_kind").alias("kind"))


@query
def wide_types(spark, d):
    """Types of the global namespace have no ``inNamespace``, and the root of all objects is nobody's base."""
    return of(spark, d, wide=True).type_triples()


@query
def wide_type_parameters(spark, d):
    return of(spark, d, wide=True).type_parameter_triples()


@query
def wide_implementations(spark, d):
    return of(spark, d, wide=True).implementation_triples()


@query
def wide_parameters(spark, d):
    return of(spark, d, wide=True).parameter_triples()


@query
def wide_attributes(spark, d):
    return of(spark, d, wide=True).attribute_triples()


@query
def wide_related(spark, d):
    """Members are targets as types are."""
    return _edges(of(spark, d, wide=True).related_triples(), "relatedTo")


@query
def mentioned_generics(spark, d):
    """Constructed types that the graph mentions, with their definitions and arguments."""
    return of(spark, d).generic_triples()


def queries() -> dict[str, Query]:
    return {name: f for name, f in QUERIES.items() if name not in SUBSETS}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in (oracle.ORACLE | whole.WHOLE | wide.WIDE).items() if name not in SUBSETS}
