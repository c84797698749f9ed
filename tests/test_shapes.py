import pytest

from quadloom.engine import statements
from quadloom.operators import consumer, shape_plan
from quadloom.operators.paths import Path, evaluate, read_path
from quadloom.operators.shacl import Validator, conforms, result_statements
from quadloom.plans.local import Index
from quadloom.sources.rdf import parse_triples
from quadloom.vocab import PREFIXES, SH, TYPE

HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + "@prefix : <urn:x:> .\n"
X = "<urn:x:{}>".format


def found(spark, shapes, data):
    results = Validator(parse_triples(HEAD + shapes)).validate(statements(spark, HEAD + data))
    return sorted((r.focus[7:-1], r.component[len(SH) + 1 : -1].removesuffix("ConstraintComponent")) for r in results.collect())


@pytest.mark.parametrize("path,want", [
    (":p", {("a", "b"), ("b", "c")}), ("[ sh:inversePath :p ]", {("b", "a"), ("c", "b")}), ("(:p :q)", {("a", "d")}), ("[ sh:alternativePath (:p :q) ]", {("a", "b"), ("b", "c"), ("b", "d")}),
    ("[ sh:oneOrMorePath :p ]", {("a", "b"), ("b", "c"), ("a", "c")}), ("[ sh:zeroOrMorePath :p ]", {("a", "b"), ("b", "c"), ("a", "c"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")}), ("[ sh:zeroOrOnePath :q ]", {("b", "d"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")}),
])
def test_paths(spark, path, want):
    index = Index(parse_triples(HEAD + f":s sh:path {path}."))
    compiled = read_path(next(o for _, p, o in index.all if p == SH.path), index)
    got = {(r.a[7:-1], r.b[7:-1]) for r in evaluate(compiled, statements(spark, HEAD + ":a :p :b. :b :p :c; :q :d.")).collect()}
    assert got == want and Path.from_json(compiled.to_json()) == compiled


def test_constraints(spark):
    shapes = """:S a sh:NodeShape; sh:targetClass :T; sh:property
        [ sh:path :n; sh:minCount 1; sh:maxCount 1; sh:datatype xsd:integer; sh:minInclusive 1; sh:maxExclusive 9 ], [ sh:path :s; sh:minLength 2; sh:maxLength 3; sh:pattern "^b"; sh:flags "i"; sh:singleLine true ],
        [ sh:path :c; sh:class :K; sh:in (:k :l) ], [ sh:path :h; sh:hasValue :must ]. :K2 rdfs:subClassOf :K."""
    good = ":a a :T; :n 5; :s \"Bx\"; :c :k; :h :must, :more. :k a :K2."
    assert found(spark, shapes, good) == []
    bad = ":a a :T; :n 0, 9, \"x\"^^xsd:integer; :s \"a\", \"bbbb\", \"b\\n\"; :c :z. :e a :T."
    got = found(spark, shapes, bad)
    assert got.count(("a", "MaxCount")) == 1 and ("e", "MinCount") in got and got.count(("a", "Datatype")) == 1 and ("a", "MinInclusive") in got and ("a", "MaxExclusive") in got
    assert {("a", "MinLength"), ("a", "MaxLength"), ("a", "Pattern"), ("a", "Class"), ("a", "In"), ("a", "HasValue"), ("e", "HasValue"), ("a", "SingleLine")} <= set(got)


def test_targets_deactivation_and_flags(spark):
    assert found(spark, ":S a sh:NodeShape; sh:targetNode :a; sh:class :K.", ":a :p :b.") == [("a", "Class")]
    assert found(spark, ":S a sh:NodeShape, rdfs:Class; sh:property [ sh:path :p; sh:minCount 1 ].", ":a a :S.") == [("a", "MinCount")]
    assert found(spark, ":S a sh:ShapeClass; sh:property [ sh:path :p; sh:minCount 1 ].", ":a a :S.") == [("a", "MinCount")]
    assert found(spark, ":S a sh:NodeShape; sh:targetObjectsOf :p; sh:deactivated true; sh:class :K.", ":a :p :b.") == []
    assert found(spark, ":S a sh:NodeShape; sh:property [ sh:path :q; sh:minCount 1 ].", ":a sh:shape :S.") == [("a", "MinCount")]
    assert found(spark, ":S a sh:NodeShape; sh:targetSubjectsOf :p; sh:xone (:o :o).", ":a :p :b.") == [("a", "Xone")]
    with pytest.raises(ValueError, match="flags"):
        found(spark, ':S a sh:NodeShape; sh:targetSubjectsOf :p; sh:property [ sh:path :p; sh:pattern "a"; sh:flags "x" ].', ":a :p :b.")


def test_newer_features(spark):
    assert found(spark, ":S a sh:NodeShape; sh:targetSubjectsOf :p; sh:property [ sh:path :q; sh:defaultValue :d; sh:class :K ].", ":a :p :b.") == [("a", "Class")]
    assert found(spark, ":S a sh:NodeShape; sh:targetSubjectsOf :p; sh:property [ sh:path :q; sh:values :d; sh:in (:e) ].", ":a :p :b; :q :e.") == [("a", "In")]
    nested = ":S a sh:NodeShape; sh:targetSubjectsOf :p; sh:property [ sh:path :p; sh:property [ sh:path :q; sh:class :K ] ]."
    assert found(spark, nested, ":a :p :b. :b :q :c.") == [("b", "Class")]
    where = ":S a sh:NodeShape; sh:targetWhere [ sh:property [ sh:path :sex; sh:hasValue :m ], [ sh:path (:child :child); sh:minCount 1 ] ]; sh:property [ sh:path :name; sh:minCount 1 ]."
    assert found(spark, where, ":a :sex :m; :child :b. :b :child :c; :sex :m.") == [("a", "MinCount")]
    reified = ":S a sh:NodeShape; sh:targetSubjectsOf :p; sh:property [ sh:path :p; sh:reificationRequired true; sh:reifierShape :R ]. :R a sh:NodeShape; sh:property [ sh:path :by; sh:minCount 1 ]."
    assert found(spark, reified, ":a :p :b {| :by :z |} .") == []
    assert found(spark, reified, ":a :p :b .") == [("a", "ReifierShape")]
    assert [c for _, c in found(spark, reified, ":a :p :b {| :other :z |} .")] == ["MinCount"]


def test_conformance_by_message_and_severity(spark):
    facts = statements(spark, 'VERSION "1.2-messages"\nPREFIX : <urn:x:>\n:a :p :b .\nMESSAGE\n:a :p :b ; :q :c .')
    results = Validator(parse_triples(HEAD + ":S a sh:NodeShape; sh:severity sh:Warning; sh:targetSubjectsOf :p; sh:property [ sh:path :q; sh:minCount 1; sh:severity sh:Warning ].")).validate(facts)
    assert {r.msg_id: r.conforms for r in conforms(facts, results).collect()} == {0: False, 1: True}
    assert {r.msg_id: r.conforms for r in conforms(facts, results, [SH.Violation]).collect()} == {0: True, 1: True}
    assert result_statements(results).where(f"p = '{SH.focusNode}'").count() == 1


PLAN = """:In a sh:NodeShape; sh:closed true; sh:targetSubjectsOf :mark; sh:ignoredProperties (:note); sh:property [ sh:path :p; sh:minCount 1; sh:maxCount 1 ].
:Open a sh:NodeShape; sh:targetSubjectsOf :q."""


def test_closed_shapes_prune_even_what_open_ones_use(spark):
    graph = shape_plan.compile_shapes(parse_triples(HEAD + PLAN))
    facts = statements(spark, 'VERSION "1.2-messages"\nPREFIX : <urn:x:>\n:a :mark :m ; :p :b ; :q :c ; :note :n ; :z :z .\nMESSAGE\n:a :q :c ; :z :z .\nMESSAGE\n:a :other :c .')
    kept = {(r.msg_id, r.p[7:-1]) for r in shape_plan.prune_input(facts, graph)[0].collect()}
    # Message 2 selects no shape, so all are active and the closed one binds it.
    assert kept == {(0, "mark"), (0, "p"), (0, "note"), (1, "q"), (1, "z")}
    again = shape_plan.ShapeGraph.from_json(graph.to_json())
    assert again == graph and "2 shape(s)" in graph.summary() and dict(graph.join_hints())[X("p")] == 1
    with pytest.raises(ValueError, match="version"):
        shape_plan.ShapeGraph.from_json({"version": 99})


def test_output_projection_limits_objects(spark):
    graph = shape_plan.compile_shapes(parse_triples(HEAD + ":S a sh:NodeShape; sh:targetNode :a; sh:class :C; sh:property [ sh:path :p; sh:in (:b) ], [ sh:path :q ]."))
    out = shape_plan.project_output(statements(spark, HEAD + ":a a :C, :D; :p :b, :c; :q :d; :r :e."), graph)
    assert {(r.p, r.o) for r in out.collect()} == {(TYPE, X("C")), (X("p"), X("b")), (X("q"), X("d"))}


def test_compact_records(spark):
    graph = shape_plan.compile_shapes(parse_triples(HEAD + ":S a sh:NodeShape; sh:targetClass :T; sh:property [ sh:path :p; sh:maxCount 1 ], [ sh:path :q ]."))
    row = shape_plan.compact_records(statements(spark, HEAD + ":a a :T; :p :x, :y; :q :x, :y."), graph).first()
    assert row.slots == {X("p"): [X("x")], X("q"): [X("x"), X("y")]}


def test_consumer_fields_are_a_union(spark):
    shapes = ":C a sh:NodeShape; sh:targetClass :T; sh:property [ sh:path :name ], [ sh:path :part; sh:node :N ], [ sh:path [ sh:inversePath :of ] ]. :N sh:property [ sh:path (:x :y) ]."
    data = ":a a :T; :name 1, 2; :part :p; :other 3. :p :x :m; a :Part. :m :y :end. :b :of :a. :z :name 9."
    projection = consumer.compile_projection(parse_triples(HEAD + shapes))
    got = {(r.s[7:-1], r.p.rpartition(":")[2][:-1], r.o) for r in consumer.project(statements(spark, HEAD + data), projection).collect()}
    assert {s + p for s, p, _ in got} == {"a//www.w3.org/1999/02/22-rdf-syntax-ns#type", "aname", "apart", "p//www.w3.org/1999/02/22-rdf-syntax-ns#type", "px", "my", "bof"} and len(got) == 8
    assert any(m["path"] == X("name") for m in projection.mappings)
    for bad in (":C a sh:NodeShape; sh:targetClass :T; sh:property [ sh:path [ sh:alternativePath (:p :q) ] ].", ":C a sh:NodeShape; sh:targetClass :T; sh:deactivated true.", ":C a sh:NodeShape; sh:targetClass :T; sh:node :Missing."):
        with pytest.raises(consumer.ProjectionFault):
            consumer.compile_projection(parse_triples(HEAD + bad))
