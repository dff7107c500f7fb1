"""What queries over large tables may not do: write the bag, carry IRIs through joins that don't need them, meet all nulls in one task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from symloom import staging, vocab
from symloom.operators import naming
from symloom.plans import catalogue, extract
from symloom.plans.bgp import Iri, Lit, Var, solve
from symloom.plans.extract import Extraction
from symloom.sources import star, tables

from test_engine import ASM, DT, NS, member, run, type_

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fresh(spark):
    """Extractions of the data folder that no other module has used."""
    made, catalogue._made = catalogue._made, {}
    yield lambda **o: catalogue.of(spark, DIR, **o)
    catalogue._made = made


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["project_namespace", "mentioned_generics", "emitted_once", "type_closure_all", "cref_member_first"])
def test_closure_makes_no_member_iris(spark, fresh, name):
    catalogue.QUERIES[name](spark, DIR)
    assert "members" not in fresh().__dict__


def test_kinds_need_no_member_iris(spark, fresh):
    catalogue.wide_member_kinds(spark, DIR)
    assert "members" not in fresh(wide=True).__dict__


@pytest.mark.parametrize("name", ["q2_classes_implementing", "nt_lines_all", "q1_methods_that_throw", "triples_by_class_all", "ttl_lines_all"])
def test_bag_is_not_written(spark, fresh, monkeypatch, name):
    written = []
    monkeypatch.setattr(extract, "stage", lambda df, *a, **k: (written.append(df.columns), staging.stage(df, *a, **k))[1])
    catalogue.QUERIES[name](spark, DIR)
    assert "store" not in fresh().__dict__ and not any("predicate" in c for c in written)


def test_classes_are_counted_without_iris_of_members(fresh):
    x = fresh()
    assert "/param/" not in _plan(x.triples({vocab.RDF_TYPE: None}, ("object",)).agg(F.count("object")))


@pytest.mark.parametrize("name", ["project_parameter", "iri_parameter", "wide_parameters", "project_field"])
def test_members_hold_what_blocks_need(spark, fresh, name):
    assert "Join" not in _plan(catalogue.QUERIES[name](spark, DIR))


@pytest.mark.parametrize("name", ["project_method", "project_property", "project_event", "overrides_edges"])
def test_only_overrides_meet_overridden(spark, fresh, name):
    plan = _plan(catalogue.QUERIES[name](spark, DIR))
    assert plan.count("Join Inner") == 1 and "LeftOuter" not in plan


@pytest.mark.parametrize("name", ["project_attribute", "iri_attribute", "wide_attributes"])
def test_attributes_meet_targets_last(spark, fresh, name):
    plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Window")]
    assert top.count("Join") == 1


def test_wide_attributes_read_items_once(spark):
    assert "LeftOuter" not in _plan(star.load(spark, DIR, wide=True)["attributes"])


def test_nulls_are_dealt_out(spark):
    rows = spark.range(64).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") == 5, "t").alias("to"))
    got = naming.refer(rows, "to", spark.createDataFrame([("t", 1), ("\0r6", 2)], "key string, v int"), "key", "id")
    assert sorted((r.id, r.v) for r in got.where("v is not null").collect()) == [("r5", 1)] and got.count() == 64
    assert "coalesce(to" in _plan(got)


def test_attributes_of_parameters(spark):
    params = [{"owner_member_id": "a/b", "ordinal": i, "name": f"x{i}", "type_id": "A", "ref_kind": "None"} for i in (0, 1)]
    on = lambda kind, i, pos: {"target_kind": kind, "target_id": i, "pos": pos, "class_type_id": "A"}
    attributes = [on("parameter", "a/b/1", 0), on("parameter", "a/b/1", 1), on("parameter", "a/b/7", 0), on("parameter", "a/b/01", 0), on("method", "a/b", 0), on("field", "a/b", 0), on("type", "A", 0), {**on("type", "A", 1), "class_type_id": None}]
    x = run(spark, types=[type_("A", walk_rank=1)], members=[member("a/b", "A")], params=params, attributes=attributes)
    got = sorted(r.iri.split("/type/")[1] for r in x.attribute_rows().collect())
    own = "Test%20Asm/0.0.0.0/N.A"
    assert got == sorted([f"{own}/attr/0", f"{own}/member/a%2Fb(N.A,N.A)/attr/0", *(f"{own}/member/a%2Fb(N.A,N.A)/param/1/attr/{i}" for i in (0, 1))])


@pytest.mark.parametrize("small", [0, 4_000_000])
def test_patterns_over_a_function(spark, monkeypatch, small):
    monkeypatch.setattr(staging, "SMALL", small)
    types = [type_("A", walk_rank=1), type_("B", walk_rank=2, base_type_id="A"), type_("C", walk_rank=3, base_type_id="A")]
    x = Extraction(tables.of_rows(spark, assemblies=[ASM], namespaces=[NS], types=types), run(spark).o)
    patterns = [(Var("c"), Iri(DT + "inherits"), Var("b")), (Var("b"), Iri(DT + "name"), Lit("A")), (Var("c"), Iri(vocab.RDF_TYPE), Iri(DT + "Class")), (Var("c"), Iri(DT + "name"), Var("n"))]
    rows = lambda source: Counter(map(tuple, solve(source, patterns, ["c", "b", "n"]).collect()))
    part = lambda p, o: x.triples({p: o if p == vocab.RDF_TYPE else None})
    assert rows(part) == rows(x.triples()) and len(rows(part)) == 2
