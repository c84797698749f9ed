import random

import pytest

from quadloom.engine import Engine, NotLoaded, Profile, statements
from quadloom.operators import emit, owl, skos
from quadloom.plans.compile import RuleFault
from quadloom.plans.local import closure
from quadloom.streaming.messages import FactStore, infer_with_store, stream
from quadloom.vocab import OWL, PREFIXES, RDFS, SKOS, TYPE

HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + "@prefix : <urn:x:> .\n"
X = "<urn:x:{}>".format


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def derive(spark, ontology, data, **options):
    return {r[1:] for r in rows(Engine(spark).load(HEAD + ontology).infer(statements(spark, HEAD + data), **options))}


def test_fleet(spark):
    got = derive(spark, ":Bus rdfs:subClassOf :Vehicle. :EBus rdfs:subClassOf :Bus. :operatedBy rdfs:domain :Vehicle; rdfs:range :Operator.", ":b a :EBus; :operatedBy :o.")
    assert got == {(X("b"), TYPE, X("Bus")), (X("b"), TYPE, X("Vehicle")), (X("o"), TYPE, X("Operator"))}


def test_properties_and_restrictions(spark):
    ontology = """:Express rdfs:subClassOf :Shipment. :Fragile rdfs:subClassOf [ owl:onProperty :needs; owl:hasValue :care ]. :Abroad owl:equivalentClass [ owl:onProperty :to; owl:someValuesFrom :Country ].
        :Regulated owl:equivalentClass [ owl:onProperty :contains; owl:allValuesFrom :Item ]. :contains owl:equivalentProperty :hasPart. :handledBy owl:inverseOf :handles. :partner a owl:SymmetricProperty.
        :in a owl:TransitiveProperty. :code a owl:FunctionalProperty. :manifest a owl:InverseFunctionalProperty."""
    data = ":s a :Express, :Fragile, :Regulated; :to :be; :contains :i; :handledBy :al; :code :c1, :c2; :manifest :m. :be a :Country. :al :partner :bo. :i :in :box. :box :in :hall. :t :manifest :m."
    got = derive(spark, ontology, data)
    want = {(X("s"), TYPE, X("Shipment")), (X("s"), X("needs"), X("care")), (X("s"), TYPE, X("Abroad")), (X("i"), TYPE, X("Item")), (X("s"), X("hasPart"), X("i")), (X("al"), X("handles"), X("s")), (X("bo"), X("partner"), X("al")),
            (X("i"), X("in"), X("hall")), (X("c1"), OWL.sameAs, X("c2")), (X("s"), OWL.sameAs, X("t")), (X("t"), TYPE, X("Shipment"))}
    assert want <= got
    assert not any(s == o and p == OWL.sameAs for s, p, o in got)


def test_lists_keys_and_cardinality(spark):
    ontology = """:FemaleParent owl:intersectionOf (:Female :Parent). :All owl:intersectionOf (:A :B :C :D :E). :Pet owl:unionOf (:Cat :Dog). :Day owl:oneOf (:mon :tue).
        :Person owl:hasKey (:name :born). :uncle owl:propertyChainAxiom (:parent :brother). :far owl:propertyChainAxiom (:p :p :p :p). :Solo owl:onProperty :has; owl:maxCardinality 1."""
    data = ":a a :Female, :Parent, :A, :B, :C, :D, :E. :c a :Cat. :u a :Person; :name \"n\"; :born 1. :v a :Person; :name \"n\"; :born 1. :w a :Person; :name \"n\"; :born 2. :k :parent :l. :l :brother :m. :1 :p :2. :2 :p :3. :3 :p :4. :4 :p :5. :s a :Solo; :has :g, :h."
    got = derive(spark, ontology, data)
    assert {(X("a"), TYPE, X("FemaleParent")), (X("a"), TYPE, X("All")), (X("c"), TYPE, X("Pet")), (X("u"), OWL.sameAs, X("v")), (X("k"), X("uncle"), X("m")), (X("1"), X("far"), X("5")), (X("g"), OWL.sameAs, X("h"))} <= got
    assert (X("u"), OWL.sameAs, X("w")) not in got


def test_skos_with_non_entailments(spark):
    got = derive(spark, "", ":a skos:broader :b. :b skos:broader :c. :x skos:closeMatch :y. :y skos:closeMatch :z. :p skos:exactMatch :q. :q skos:exactMatch :r. :a skos:prefLabel \"A\"@en; skos:definition \"d\". :l skos:memberList (:m :n).")
    assert {(X("a"), SKOS.broaderTransitive, X("c")), (X("c"), SKOS.narrowerTransitive, X("a")), (X("p"), SKOS.exactMatch, X("r")), (X("a"), RDFS.label, '"A"@en'), (X("a"), TYPE, SKOS.Concept)} <= got
    assert (X("a"), SKOS.broader, X("c")) not in got and (X("x"), SKOS.closeMatch, X("z")) not in got


def test_messages_do_not_mix(spark):
    engine = Engine(spark).load(HEAD + ":p a owl:TransitiveProperty.")
    log = 'VERSION "1.2-messages"\nPREFIX : <urn:x:>\n:a :p :b .\nMESSAGE\n:b :p :c .\nMESSAGE\n:a :p :b . :b :p :c .'
    assert rows(engine.infer(statements(spark, log))) == [(2, X("a"), X("p"), X("c"))]


def test_contradictions_are_reported_once_and_explained(spark):
    engine = Engine(spark).load(HEAD + ":A owl:disjointWith :B. :q a owl:IrreflexiveProperty. :d a owl:AllDifferent; owl:distinctMembers (:m :n). [ a owl:AllDisjointClasses; owl:members (:U :V) ]. :r a owl:AsymmetricProperty.")
    out, found = engine.infer_with_diagnostics(statements(spark, HEAD + ":x a :A, :B. :x :q :x. :m owl:sameAs :n. :y a :U, :V. :s :r :t. :t :r :s."))
    got = {(r.rule.split(":")[-1][:-1], tuple(r.terms)[-1]) for r in found.collect()}
    assert {("cax-dw", X("x")), ("prp-irp", X("x")), ("cax-adc", X("y")), ("cax-dw", X("y"))} <= got and any(k == "eq-diff3" for k, _ in got) and any(k == "prp-asyp" for k, _ in got)
    told = {r.message for r in emit.explained(found).collect()}
    assert f"{X('x')} is in the disjoint classes {X('A')} and {X('B')}" in told
    assert {r.id for r in emit.grouped_reports(out).collect()} == {r.id for r in found.collect()}
    assert engine.static_inconsistencies() == []


def test_output_modes(spark):
    engine = Engine(spark).load(HEAD + ":C rdfs:subClassOf [ owl:onProperty :p; owl:hasValue 1 ].")
    data = statements(spark, HEAD + ":a a :C.")
    assert all(not r[3].startswith("_:") for r in rows(engine.infer(data)))
    assert any(r[3].startswith("_:") for r in rows(engine.infer(data, mode="conformance")))
    with pytest.raises(ValueError, match="output mode"):
        engine.infer(data, mode="other")


@pytest.mark.parametrize("seed", range(3))
def test_distributed_and_local_agree(spark, seed):
    rng = random.Random(seed)
    classes, properties, people = [X(f"C{i}") for i in range(4)], [X(f"p{i}") for i in range(4)], [X(f"i{i}") for i in range(6)]
    schema = {(rng.choice(classes), RDFS.subClassOf, rng.choice(classes)) for _ in range(3)} | {(rng.choice(properties), rng.choice([RDFS.domain, RDFS.range]), rng.choice(classes)) for _ in range(3)}
    schema |= {(rng.choice(properties), rng.choice([RDFS.subPropertyOf, OWL.inverseOf]), rng.choice(properties)), (properties[0], TYPE, rng.choice([OWL.TransitiveProperty, OWL.SymmetricProperty, OWL.FunctionalProperty]))}
    data = {(rng.choice(people), rng.choice(properties), rng.choice(people)) for _ in range(8)} | {(rng.choice(people), TYPE, rng.choice(classes)) for _ in range(3)}
    engine = Engine(spark, "conformance").load(list(schema), ["owl2rl", "skos"])
    got = {r[1:] for r in rows(engine.infer(statements(spark, list(data))))}
    index, _ = closure([*engine.background.all, *data], [*owl.rules(), *skos.rules()])
    reflexive = lambda t: t[1] == OWL.sameAs and t[0] == t[2]
    want = {t for t in index.all - engine.background.all - data if not reflexive(t) and t[0][0] != '"'}
    assert {t for t in got if t not in engine.background.all and t[0][0] != '"'} == want


def test_rules_of_ones_own(spark):
    engine = Engine(spark).load("", [Profile(HEAD + "{ ?s :v ?x } <= { ?s :a ?x }. { ?s :v ?x. (?x 2) math:product ?y } => { ?s :r ?y }. { ?s :v ?x. 1 log:notIncludes { ?s :off true } } => { ?s a :On }.")])
    got = {r[1:] for r in rows(engine.infer(statements(spark, HEAD + ":s :a 2. :t :v 3; :off true. :u :a \"none\".")))}
    assert (X("s"), X("r"), '"4"^^<http://www.w3.org/2001/XMLSchema#integer>') in got and (X("s"), TYPE, X("On")) in got and (X("t"), TYPE, X("On")) not in got
    assert not any(s == X("u") and p == X("r") for s, p, _ in got)
    for bad in ("{ ?s :p ?x } => { ?s :q ?y }.", "{ ?s :h ?o } <= { ?s :h ?o }. { ?s :h ?o } => { ?s :q ?o }.", "{ ?s :p ?x. ?x <http://www.w3.org/2000/10/swap/time#year> ?y } => { ?s :q ?y }."):
        with pytest.raises(RuleFault):
            Profile(HEAD + bad)


def test_limits_throw(spark):
    engine = Engine(spark).load("", [Profile(HEAD + "{ ?s :n ?x. (?x 1) math:sum ?y } => { ?s :n ?y }.")])
    with pytest.raises(RuntimeError, match="did not converge"):
        engine.infer(statements(spark, HEAD + ":s :n 1."), max_rounds=3).count()


def test_runtime_is_saved_and_loaded(spark, tmp_path):
    shapes = HEAD + ":S a sh:NodeShape; sh:closed true; sh:targetSubjectsOf :p; sh:property [ sh:path :p ]."
    Engine(spark).load(HEAD + ":p rdfs:range :C.", shapes_in=shapes).save_runtime(f"file://{tmp_path}/rt")
    again = Engine(spark, runtime=f"file://{tmp_path}/rt")
    assert rows(again.infer(statements(spark, HEAD + ":a :p :b; :q :c."))) == [(0, X("b"), TYPE, X("C"))]
    with pytest.raises(NotLoaded):
        Engine(spark).infer(statements(spark, []))
    with pytest.raises(ValueError, match="no bundled profile"):
        Engine(spark).load("", ["other"])


ONTOLOGY = ":Mother owl:equivalentClass :FemaleParent. :FemaleParent owl:intersectionOf (:Female :Parent). :hasParent rdfs:range :Parent. :A owl:disjointWith :B."


def test_store_sees_earlier_messages(spark, tmp_path):
    engine = Engine(spark).load(HEAD + ONTOLOGY)
    log = 'VERSION "1.2-messages"\nPREFIX : <urn:x:>\n:al a :Female .\nMESSAGE\nMESSAGE\n:bo :hasParent :al . :x a :A .'
    store = FactStore(spark, "one", str(tmp_path), clear=True)
    out0, _ = infer_with_store(engine, statements(spark, log), store)
    out = out0
    got = [r for r in rows(out) if "Thing" not in r[3]]
    assert {(2, X("al"), TYPE, X("Parent")), (2, X("al"), TYPE, X("Mother"))} <= set(got) and all(r[0] == 2 for r in got)
    later = statements(spark, [(X("x"), TYPE, X("B"))], msg_id=7)
    out, found = infer_with_store(engine, later, FactStore(spark, "one", str(tmp_path)), diagnostics=True)
    assert [(r.msg_id, r.terms[-1]) for r in found.collect()] == [(7, X("x"))]
    _, other = infer_with_store(engine, statements(spark, [(X("x"), TYPE, X("A")), (X("x"), TYPE, X("B"))]), FactStore(spark, "two", str(tmp_path), clear=True), diagnostics=True)
    assert other.first().id != found.first().id  # another store, another scope
    again, _ = infer_with_store(engine, statements(spark, log), FactStore(spark, "one", str(tmp_path)))
    assert again.count() == 0
    passing, _ = infer_with_store(engine, statements(spark, log), FactStore.temporary(spark, "one"))
    assert sorted(rows(passing)) == sorted(rows(out0))


def test_stream(spark, tmp_path):
    engine = Engine(spark).load(HEAD + ONTOLOGY)
    source = tmp_path / "in"
    statements(spark, [(X("bo"), X("hasParent"), X("al"))]).write.parquet(str(source))
    facts = spark.readStream.schema("msg_id long, s string, p string, o string").parquet(str(source))
    stream(engine, facts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("msg_id", "s", "p", "o")) == [(0, X("al"), TYPE, X("Parent"))]


def test_literals_in_conformance_mode(spark):
    engine = Engine(spark, "conformance").load(HEAD + ":f a owl:FunctionalProperty.")
    out, found = engine.infer_with_diagnostics(statements(spark, HEAD + ':a :f 1, 2. :b :g "01"^^xsd:integer, "1.0"^^xsd:decimal, "x"^^xsd:byte.'))
    got = {r[1:] for r in rows(out)}
    one, two = '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"2"^^<http://www.w3.org/2001/XMLSchema#integer>'
    assert (one, OWL.differentFrom, two) in got and (one, OWL.sameAs, '"1.0"^^<http://www.w3.org/2001/XMLSchema#decimal>') in got
    assert (one, TYPE, "<http://www.w3.org/2001/XMLSchema#decimal>") in got and (one, TYPE, RDFS.Literal) in got
    told = {(r.rule.rpartition(":")[2][:-1], r.terms[0]) for r in found.collect()}
    assert ("eq-diff1", one) in told and ("dt-not-type", '"x"^^<http://www.w3.org/2001/XMLSchema#byte>') in told
    assert all(r[1][0] != '"' for r in rows(engine.infer(statements(spark, HEAD + ":a :f 1."), mode="application")))


def test_sql_program_of_an_engine(spark):
    from quadloom.plans import sql

    engine = Engine(spark).load(HEAD + ":p rdfs:domain :C. :C rdfs:subClassOf :D. :l owl:intersectionOf (:C :D).")
    facts = statements(spark, HEAD + ":a :p :b.")
    made = engine.sql_program(facts)
    got = {tuple(r)[1:] for r in sql.execute(spark, made.program, facts)["derived"].collect()}
    assert {r[1:] for r in rows(engine.infer(facts))} <= got
