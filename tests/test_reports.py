"""Reports alone: the same as beside all statements, derived from what bears on them."""

import pytest

from quadloom import engine as E
from quadloom.plans.storage import stored
from quadloom.queries import HEAD
from quadloom.vocab import SAME_AS, TYPE

INTEGER = "^^<http://www.w3.org/2001/XMLSchema#integer>"
ONTOLOGY = """x:home owl:propertyDisjointWith x:avoids. x:home rdfs:domain x:Person; owl:inverseOf x:hosts. x:Person rdfs:subClassOf x:Agent. x:Agent owl:disjointWith x:Thing.
    x:age owl:inverseOf x:ageOf; rdfs:subPropertyOf x:number. x:Six owl:intersectionOf (x:A x:B x:C x:D x:E x:F). x:Six owl:disjointWith x:Person. x:worth owl:hasValue "ten"^^xsd:integer; owl:onProperty x:number."""


def facts(*more):
    one = [("<urn:x:a>", "<urn:x:home>", "<urn:x:n>"), ("<urn:x:a>", "<urn:x:avoids>", "<urn:x:n>"), ("<urn:x:b>", "<urn:x:home>", "<urn:x:n>"), ("<urn:x:b>", TYPE, "<urn:x:Thing>"),
           ("<urn:x:b>", "<urn:x:age>", f'"old"{INTEGER}'), ("<urn:x:c>", TYPE, "<urn:x:worth>"), *(("<urn:x:a>", TYPE, f"<urn:x:{c}>") for c in "ABCDEF")]
    return [(0, *t) for t in [*one, *more]]


@pytest.mark.parametrize("more,pairs", [((), False), ((("<urn:x:a>", SAME_AS, "<urn:x:b>"),), True)])
def test_reports_alone_are_all_reports(spark, monkeypatch, more, pairs):
    """disjoint properties tell all subjects of a value apart, which no report asks for unless something is said to be the same."""
    df = stored(spark.createDataFrame(facts(*more), "msg_id long, s string, p string, o string"), "facts")
    engine = E.Engine(spark).load(HEAD + ONTOLOGY, ["owl2rl"])
    run, seen = E.fixpoint, []
    monkeypatch.setattr(E, "fixpoint", lambda f, variants, *a, **b: seen.append({v.name for v in variants}) or run(f, variants, *a, **b))
    want = engine.infer_with_diagnostics(df)[1].collect()
    got = engine.inconsistencies(df).collect()
    rules = {r.rule.rsplit(":", 1)[1].rstrip(">") for r in got}
    assert sorted(want) == sorted(got) and {"prp-pdw", "cax-dw", "dt-not-type"} <= rules and ("eq-diff1" in rules) == pairs
    assert "pdw-diff-s" in seen[0] and ("pdw-diff-s" in seen[1]) == pairs
    assert len({r.terms[-2] for r in got if r.rule.endswith("dt-not-type>")}) == 2  # the literal of the data and that of the ontology
