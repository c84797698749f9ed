"""SKOS entailment (W3C SKOS Reference): renamings, swaps and three transitive closures."""

from __future__ import annotations

from quadloom.operators.owl import read_rules
from quadloom.plans.local import Triple
from quadloom.plans.rules import Rule
from quadloom.vocab import OWL, RDFS, SKOS, TYPE

#: Property -> the more general ones it implies.
IMPLIES = {
    "hasTopConcept": [], "topConceptOf": ["inScheme"],
    "broader": ["broaderTransitive"], "narrower": ["narrowerTransitive"],
    "broaderTransitive": ["semanticRelation"], "narrowerTransitive": ["semanticRelation"], "related": ["semanticRelation"],
    "mappingRelation": ["semanticRelation"], "closeMatch": ["mappingRelation"], "exactMatch": ["closeMatch"],
    "broadMatch": ["mappingRelation", "broader"], "narrowMatch": ["mappingRelation", "narrower"], "relatedMatch": ["mappingRelation", "related"],
    "changeNote": ["note"], "definition": ["note"], "editorialNote": ["note"], "example": ["note"], "historyNote": ["note"], "scopeNote": ["note"],
}
INVERSE = [("hasTopConcept", "topConceptOf"), ("broader", "narrower"), ("broaderTransitive", "narrowerTransitive"), ("broadMatch", "narrowMatch")]
SYMMETRIC = ["related", "closeMatch", "exactMatch", "relatedMatch"]
TRANSITIVE = ["broaderTransitive", "narrowerTransitive", "exactMatch"]
TYPED = {"inScheme": (None, "ConceptScheme"), "hasTopConcept": ("ConceptScheme", "Concept"), "topConceptOf": ("Concept", "ConceptScheme"), "semanticRelation": ("Concept", "Concept"), "member": ("Collection", None), "memberList": ("OrderedCollection", None)}


def rules() -> list[Rule]:
    table = {}
    for p, more in IMPLIES.items():
        for q in more:
            table[f"skos {p} {q}"] = f"?x skos:{p} ?y => ?x skos:{q} ?y"
    for p in ("prefLabel", "altLabel", "hiddenLabel"):
        table[f"skos label {p}"] = f"?x skos:{p} ?y => ?x rdfs:label ?y"
    for p, q in INVERSE:
        table[f"skos inverse {p}"] = f"?x skos:{p} ?y => ?y skos:{q} ?x"
        table[f"skos inverse {q}"] = f"?x skos:{q} ?y => ?y skos:{p} ?x"
    for p in SYMMETRIC:
        table[f"skos symmetric {p}"] = f"?x skos:{p} ?y => ?y skos:{p} ?x"
    for p in TRANSITIVE:
        table[f"skos transitive {p}"] = f"?x skos:{p} ?y. ?y skos:{p} ?z => ?x skos:{p} ?z"
    for p, (domain, range_) in TYPED.items():
        if domain:
            table[f"skos domain {p}"] = f"?x skos:{p} ?y => ?x a skos:{domain}"
        if range_:
            table[f"skos range {p}"] = f"?x skos:{p} ?y => ?y a skos:{range_}"
    table["skos list type"] = "?x skos:memberList ?l => ?l a rdf:List"
    table["skos ordered"] = "?x a skos:OrderedCollection => ?x a skos:Collection"
    table["skos memberList"] = "?x skos:memberList ?l. ?l list:member ?y => ?x skos:member ?y"
    return read_rules(table)


def axioms() -> list[Triple]:
    """The vocabulary itself, for backgrounds that don't bring it."""
    out = [(SKOS[c], TYPE, OWL["Class"]) for c in ("Concept", "ConceptScheme", "Collection", "OrderedCollection")]
    out += [(SKOS.OrderedCollection, RDFS.subClassOf, SKOS.Collection)]
    out += [(SKOS[p], RDFS.subPropertyOf, SKOS[q]) for p, more in IMPLIES.items() for q in more]
    out += [(SKOS[p], TYPE, OWL.SymmetricProperty) for p in SYMMETRIC] + [(SKOS[p], TYPE, OWL.TransitiveProperty) for p in TRANSITIVE]
    return out + [(SKOS[p], OWL.inverseOf, SKOS[q]) for p, q in INVERSE]
