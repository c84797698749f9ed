"""OWL 2 RL entailment (W3C OWL 2 Profiles, section 4.3) as rules over term keys.

Rules whose premises are an axiom with a list are made one by one from the lists of the background; all others are
general and become lookups when the engine compiles them. Inconsistencies are rules too: their solutions are reports.
"""

from __future__ import annotations

from collections.abc import Iterable

from quadloom.functions.builtins import is_builtin
from quadloom.functions.datatypes import AXIOMS, BOUNDS, ancestors, short, subtypes
from quadloom.plans.local import Index, Triple
from quadloom.plans.rules import Atom, Rule, Var
from quadloom.sources.rdf import parse
from quadloom.vocab import NIL, OWL, PREFIXES, RDFS, TYPE, XSD

#: name: body => head. A body of several premises is a join; `1 log:notIncludes` isn't needed here.
ENTAILMENTS = {
    # equality
    "eq-sym": "?x owl:sameAs ?y => ?y owl:sameAs ?x",
    "eq-trans": "?x owl:sameAs ?y. ?y owl:sameAs ?z => ?x owl:sameAs ?z",
    "eq-rep-s": "?s owl:sameAs ?t. ?s ?p ?o => ?t ?p ?o",
    "eq-rep-p": "?p owl:sameAs ?q. ?s ?p ?o => ?s ?q ?o",
    "eq-rep-o": "?o owl:sameAs ?t. ?s ?p ?o => ?s ?p ?t",
    # properties
    "prp-dom": "?p rdfs:domain ?c. ?x ?p ?y => ?x a ?c",
    "prp-rng": "?p rdfs:range ?c. ?x ?p ?y => ?y a ?c",
    "prp-fp": "?p a owl:FunctionalProperty. ?x ?p ?y. ?x ?p ?z => ?y owl:sameAs ?z",
    "prp-ifp": "?p a owl:InverseFunctionalProperty. ?x ?p ?z. ?y ?p ?z => ?x owl:sameAs ?y",
    "prp-symp": "?p a owl:SymmetricProperty. ?x ?p ?y => ?y ?p ?x",
    "prp-trp": "?p a owl:TransitiveProperty. ?x ?p ?y. ?y ?p ?z => ?x ?p ?z",
    "prp-rp": "?p a owl:ReflexiveProperty. ?x a owl:NamedIndividual => ?x ?p ?x",
    "prp-spo1": "?p rdfs:subPropertyOf ?q. ?x ?p ?y => ?x ?q ?y",
    "prp-eqp1": "?p owl:equivalentProperty ?q. ?x ?p ?y => ?x ?q ?y",
    "prp-eqp2": "?p owl:equivalentProperty ?q. ?x ?q ?y => ?x ?p ?y",
    "prp-inv1": "?p owl:inverseOf ?q. ?x ?p ?y => ?y ?q ?x",
    "prp-inv2": "?p owl:inverseOf ?q. ?x ?q ?y => ?y ?p ?x",
    # what disjointness and functionality say about difference
    "pdw-diff-s": "?p owl:propertyDisjointWith ?q. ?x ?p ?o. ?y ?q ?o => ?x owl:differentFrom ?y. ?y owl:differentFrom ?x",
    "pdw-diff-o": "?p owl:propertyDisjointWith ?q. ?s ?p ?x. ?s ?q ?y => ?x owl:differentFrom ?y. ?y owl:differentFrom ?x",
    "fp-diff": "?p a owl:FunctionalProperty. ?x ?p ?y. ?u ?p ?v. ?y owl:differentFrom ?v => ?x owl:differentFrom ?u",
    "ifp-diff": "?p a owl:InverseFunctionalProperty. ?x ?p ?y. ?u ?p ?v. ?x owl:differentFrom ?u => ?y owl:differentFrom ?v",
    # classes
    "cls-svf1": "?r owl:someValuesFrom ?c; owl:onProperty ?p. ?x ?p ?y. ?y a ?c => ?x a ?r",
    "cls-svf2": "?r owl:someValuesFrom owl:Thing; owl:onProperty ?p. ?x ?p ?y => ?x a ?r",
    "cls-avf": "?r owl:allValuesFrom ?c; owl:onProperty ?p. ?x a ?r; ?p ?y => ?y a ?c",
    "cls-hv1": "?r owl:hasValue ?v; owl:onProperty ?p. ?x a ?r => ?x ?p ?v",
    "cls-hv2": "?r owl:hasValue ?v; owl:onProperty ?p. ?x ?p ?v => ?x a ?r",
    "cls-maxc2": "?r owl:maxCardinality ?n; owl:onProperty ?p. ?n math:equalTo 1. ?x a ?r; ?p ?y; ?p ?z => ?y owl:sameAs ?z",
    "cls-maxqc3": "?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onClass ?c. ?n math:equalTo 1. ?x a ?r; ?p ?y; ?p ?z. ?y a ?c. ?z a ?c => ?y owl:sameAs ?z",
    "cls-maxqc4": "?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onClass owl:Thing. ?n math:equalTo 1. ?x a ?r; ?p ?y; ?p ?z => ?y owl:sameAs ?z",
    "maxqd-same": "?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onDataRange ?c. ?n math:equalTo 1. ?x a ?r; ?p ?y; ?p ?z. ?y dt:validForDatatype ?c. ?z dt:validForDatatype ?c => ?y owl:sameAs ?z",
    "maxqc-diff": "?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onClass ?c. ?n math:equalTo 1. ?x a ?r; ?p ?y; ?p ?z. ?y a ?c. ?y owl:differentFrom ?z. (internal:complement ?c) log:skolem ?k => ?z a ?k. ?k owl:complementOf ?c",
    # class axioms
    "cax-sco": "?c rdfs:subClassOf ?d. ?x a ?c => ?x a ?d",
    "cax-eqc1": "?c owl:equivalentClass ?d. ?x a ?c => ?x a ?d",
    "cax-eqc2": "?c owl:equivalentClass ?d. ?x a ?d => ?x a ?c",
    # schema
    "scm-cls": "?c a owl:Class => ?c rdfs:subClassOf ?c. ?c owl:equivalentClass ?c. ?c rdfs:subClassOf owl:Thing. owl:Nothing rdfs:subClassOf ?c",
    "scm-sco": "?a rdfs:subClassOf ?b. ?b rdfs:subClassOf ?c => ?a rdfs:subClassOf ?c",
    "scm-eqc1": "?a owl:equivalentClass ?b => ?a rdfs:subClassOf ?b. ?b rdfs:subClassOf ?a",
    "scm-eqc2": "?a rdfs:subClassOf ?b. ?b rdfs:subClassOf ?a => ?a owl:equivalentClass ?b",
    "scm-op": "?p a owl:ObjectProperty => ?p rdfs:subPropertyOf ?p. ?p owl:equivalentProperty ?p",
    "scm-dp": "?p a owl:DatatypeProperty => ?p rdfs:subPropertyOf ?p. ?p owl:equivalentProperty ?p",
    "scm-spo": "?a rdfs:subPropertyOf ?b. ?b rdfs:subPropertyOf ?c => ?a rdfs:subPropertyOf ?c",
    "scm-eqp1": "?a owl:equivalentProperty ?b => ?a rdfs:subPropertyOf ?b. ?b rdfs:subPropertyOf ?a",
    "scm-eqp2": "?a rdfs:subPropertyOf ?b. ?b rdfs:subPropertyOf ?a => ?a owl:equivalentProperty ?b",
    "scm-dom1": "?p rdfs:domain ?a. ?a rdfs:subClassOf ?b => ?p rdfs:domain ?b",
    "scm-dom2": "?q rdfs:domain ?c. ?p rdfs:subPropertyOf ?q => ?p rdfs:domain ?c",
    "scm-rng1": "?p rdfs:range ?a. ?a rdfs:subClassOf ?b => ?p rdfs:range ?b",
    "scm-rng2": "?q rdfs:range ?c. ?p rdfs:subPropertyOf ?q => ?p rdfs:range ?c",
    "scm-hv": "?a owl:hasValue ?v; owl:onProperty ?p. ?b owl:hasValue ?v; owl:onProperty ?q. ?p rdfs:subPropertyOf ?q => ?a rdfs:subClassOf ?b",
    "scm-svf1": "?a owl:someValuesFrom ?c; owl:onProperty ?p. ?b owl:someValuesFrom ?d; owl:onProperty ?p. ?c rdfs:subClassOf ?d => ?a rdfs:subClassOf ?b",
    "scm-svf2": "?a owl:someValuesFrom ?c; owl:onProperty ?p. ?b owl:someValuesFrom ?c; owl:onProperty ?q. ?p rdfs:subPropertyOf ?q => ?a rdfs:subClassOf ?b",
    "scm-avf1": "?a owl:allValuesFrom ?c; owl:onProperty ?p. ?b owl:allValuesFrom ?d; owl:onProperty ?p. ?c rdfs:subClassOf ?d => ?a rdfs:subClassOf ?b",
    "scm-avf2": "?a owl:allValuesFrom ?c; owl:onProperty ?p. ?b owl:allValuesFrom ?c; owl:onProperty ?q. ?p rdfs:subPropertyOf ?q => ?b rdfs:subClassOf ?a",
    "com-subclass": "?c owl:disjointWith ?d. ?k owl:complementOf ?d => ?c rdfs:subClassOf ?k",
    "com-subclass2": "?c owl:disjointWith ?d. ?k owl:complementOf ?c => ?d rdfs:subClassOf ?k",
}

#: name: (body, terms of the report). What stands after a blank tells rules of one report apart.
CONTRADICTIONS = {
    "eq-diff1": ("?x owl:sameAs ?y. ?x owl:differentFrom ?y", "x y"),
    "eq-diff1 literal": ("?x owl:sameAs ?y. ?x dt:differentValueFrom ?y", "x y"),
    "prp-irp": ("?p a owl:IrreflexiveProperty. ?x ?p ?x", "p x"),
    "prp-asyp": ("?p a owl:AsymmetricProperty. ?x ?p ?y. ?y ?p ?x", "p x y"),
    "prp-pdw": ("?p owl:propertyDisjointWith ?q. ?x ?p ?y. ?x ?q ?y", "p q x y"),
    "prp-npa1": ("?n owl:sourceIndividual ?x; owl:assertionProperty ?p; owl:targetIndividual ?y. ?x ?p ?y", "n x p y"),
    "prp-npa2": ("?n owl:sourceIndividual ?x; owl:assertionProperty ?p; owl:targetValue ?v. ?x ?p ?v", "n x p v"),
    "cls-nothing2": ("?x a owl:Nothing", "x"),
    "cls-com": ("?c owl:complementOf ?d. ?x a ?c. ?x a ?d", "c d x"),
    "cls-maxc1": ("?r owl:maxCardinality ?n; owl:onProperty ?p. ?n math:equalTo 0. ?x a ?r; ?p ?y", "r x p y"),
    "cls-maxqc1": ("?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onClass ?c. ?n math:equalTo 0. ?x a ?r; ?p ?y. ?y a ?c", "r x p y c"),
    "cls-maxqc2": ("?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onClass owl:Thing. ?n math:equalTo 0. ?x a ?r; ?p ?y", "r x p y"),
    "cls-maxqd1": ("?r owl:maxQualifiedCardinality ?n; owl:onProperty ?p; owl:onDataRange ?c. ?n math:equalTo 0. ?x a ?r; ?p ?y. ?y dt:validForDatatype ?c", "r x p y c"),
    "cax-dw": ("?c owl:disjointWith ?d. ?x a ?c. ?x a ?d", "c d x"),
    "dt-not-type": ("?x ?p ?v. ?v dt:datatype ?d. ?v dt:invalidForDatatype ?d", "v d"),
}

#: Properties whose lists hold classes or individuals that all take part in one axiom.
LIST_AXIOMS = {OWL.intersectionOf, OWL.unionOf, OWL.oneOf, OWL.members, OWL.distinctMembers, OWL.hasKey, OWL.propertyChainAxiom}

_HEADER = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())


def read_rules(table: dict[str, str]) -> list[Rule]:
    text = _HEADER + "\n".join(f"{{ {body} }} => {{ {head} }} ." for body, head in (x.split(" => ") for x in table.values()))
    return [Rule(r.body, r.head, name) for name, r in zip(table, parse(text).forward, strict=True)]


def read_contradictions(table: dict[str, tuple[str, str]]) -> list[tuple[Rule, tuple]]:
    text = _HEADER + "\n".join(f"{{ {body} }} => {{ }} ." for body, _ in table.values())
    return [(Rule(r.body, (), name), tuple(Var(v) for v in terms.split())) for (name, (_, terms)), r in zip(table.items(), parse(text).forward, strict=True)]


def axioms() -> list[Triple]:
    """Facts that hold in every ontology: datatypes, their inclusion, annotation properties, Thing and Nothing."""
    notes = [RDFS.label, RDFS.comment, RDFS.seeAlso, RDFS.isDefinedBy, OWL.deprecated, OWL.versionInfo, OWL.priorVersion, OWL.backwardCompatibleWith, OWL.incompatibleWith]
    return [*AXIOMS, *((p, TYPE, OWL.AnnotationProperty) for p in notes), *((a, RDFS.subClassOf, b) for a, b in subtypes() if a != b)]


def _typed(x: str, c: str) -> Atom:
    return Atom(Var(x), TYPE, c)


def list_rules(index: Index, division_from: int = 5) -> tuple[list[Rule], list[tuple[Rule, tuple]], list[tuple[str, list[str]]]]:
    """Rules, contradictions and divisions of the background's list axioms.

    Intersections of fewer than division_from classes are joins; longer ones are divisions (class, members): individuals
    are grouped and their distinct classes counted, one shuffle whatever the length.
    """
    rules, errors, divisions = [], [], []
    by = lambda p: sorted((s, index.items(o)) for s, _, o in index.by_p.get(p, ()) if index.items(o))
    for n, (c, items) in enumerate(by(OWL.intersectionOf)):
        if len(items) < division_from:
            rules.append(Rule(tuple(_typed("x", k) for k in dict.fromkeys(items)), (_typed("x", c),), f"cls-int1 {n}"))
        else:
            divisions.append((c, sorted(set(items))))
        rules.append(Rule((_typed("x", c),), tuple(_typed("x", k) for k in items), f"cls-int2 {n}"))
    for n, (c, items) in enumerate(by(OWL.unionOf)):
        rules += [Rule((_typed("x", k),), (_typed("x", c),), f"cls-uni {n}.{i}") for i, k in enumerate(items)]
    for n, (p, items) in enumerate(by(OWL.propertyChainAxiom)):
        if items == [p, p]:  # prp-trp, by list_facts
            continue
        rules.append(Rule(tuple(Atom(Var(f"u{i}"), q, Var(f"u{i + 1}")) for i, q in enumerate(items)), (Atom(Var("u0"), p, Var(f"u{len(items)}")),), f"prp-spo2 {n}"))
    for n, (c, items) in enumerate(by(OWL.hasKey)):
        body = [_typed("x", c), _typed("y", c)]
        for i, p in enumerate(items):
            body += [Atom(Var("x"), p, Var(f"z{i}")), Atom(Var("y"), p, Var(f"z{i}"))]
        rules.append(Rule(tuple(body), (Atom(Var("x"), OWL.sameAs, Var("y")),), f"prp-key {n}"))
    members = [(a, i) for q in (OWL.members, OWL.distinctMembers) for a, i in by(q)]
    kinds = {a: {o for _, _, o in index.by_ps.get((TYPE, a), ())} for a, _ in members}
    for n, (a, items) in enumerate(members):
        distinct = a in {s for s, _, _ in index.by_p.get(OWL.distinctMembers, ())}
        pairs = [(i, j) for i in range(len(items)) for j in range(i + 1, len(items))]
        for i, j in pairs:
            x, y = items[i], items[j]
            if OWL.AllDifferent in kinds[a]:
                errors += [(Rule((Atom(p, OWL.sameAs, q),), (), "eq-diff3" if distinct else "eq-diff2"), (a, p, q)) for p, q in ((x, y), (y, x))]
            if OWL.AllDisjointProperties in kinds[a]:
                errors.append((Rule((Atom(Var("s"), x, Var("o")), Atom(Var("s"), y, Var("o"))), (), "prp-adp"), (a, x, y, Var("s"), Var("o"))))
                for p, q in ((x, y), (y, x)):
                    rules.append(Rule((Atom(Var("u"), p, Var("o")), Atom(Var("v"), q, Var("o"))), (Atom(Var("u"), OWL.differentFrom, Var("v")),), f"adp-diff-s {n}.{i}.{j}.{p == x}"))
                    rules.append(Rule((Atom(Var("s"), p, Var("u")), Atom(Var("s"), q, Var("v"))), (Atom(Var("u"), OWL.differentFrom, Var("v")),), f"adp-diff-o {n}.{i}.{j}.{p == x}"))
            if OWL.AllDisjointClasses in kinds[a]:
                errors.append((Rule((_typed("x", x), _typed("x", y)), (), "cax-adc"), (a, x, y, Var("x"))))
    return rules, errors, divisions


def list_facts(index: Index) -> list[Triple]:
    """What list axioms say about the schema itself: subclasses, members of enumerations, pairwise disjointness, transitivity."""
    out = [(p, TYPE, OWL.TransitiveProperty) for p, _, head in index.by_p.get(OWL.propertyChainAxiom, ()) if index.items(head) == [p, p]]
    for c, _, head in index.by_p.get(OWL.intersectionOf, ()):
        out += [(c, RDFS.subClassOf, k) for k in index.items(head) or ()]
    for c, _, head in index.by_p.get(OWL.unionOf, ()):
        out += [(k, RDFS.subClassOf, c) for k in index.items(head) or ()]
    for c, _, head in index.by_p.get(OWL.oneOf, ()):
        out += [(k, TYPE, c) for k in index.items(head) or ()]
    for a, _, head in index.by_p.get(OWL.members, ()):
        items = index.items(head) or ()
        if (a, TYPE, OWL.AllDisjointClasses) in index.all:
            out += [(x, OWL.disjointWith, y) for i, x in enumerate(items) for y in items[i + 1 :]]
        if (a, TYPE, OWL.AllDisjointProperties) in index.all:
            out += [(x, OWL.propertyDisjointWith, y) for i, x in enumerate(items) for y in items[i + 1 :]]
    return [t for t in out if t[0] != NIL]


def range_meets(index: Index) -> list[Triple]:
    """Two integer ranges of one property meet in the type of their common bounds, where there is one."""
    out = []
    for p in {s for s, _, _ in index.by_p.get(RDFS.range, ())}:
        names = [short(o) for _, _, o in index.by_ps[RDFS.range, p] if short(o) in BOUNDS]
        spans = [BOUNDS[n] for n in names]
        if len(names) < 2:
            continue
        low = max((b for b, _ in spans if b is not None), default=None)
        high = min((b for _, b in spans if b is not None), default=None)
        out += [(p, RDFS.range, XSD[n]) for n, span in BOUNDS.items() if span == (low, high) and "integer" in ancestors(n)]
    return out


def rules() -> list[Rule]:
    return read_rules(ENTAILMENTS)


def contradictions() -> list[tuple[Rule, tuple]]:
    return read_contradictions(CONTRADICTIONS)


def schema_closure(triples: Iterable[Triple], more_rules: Iterable[Rule] = (), with_axioms: bool = True) -> Index:
    """The background with all that follows from it alone."""
    from quadloom.plans.local import closure

    base = Index(triples)
    start = list(base.all) + (axioms() if with_axioms else [])
    made, _, _ = list_rules(base)
    start += list_facts(base)
    every = [*(r for r in rules() if r.name != "eq-rep-p" or base.by_p.get(OWL.sameAs)), *made, *more_rules]
    used = {p for _, p, _ in start} | {x for r in every for x in (a.p for a in r.head) if isinstance(x, str)}
    every = [r for r in every if all(not isinstance(a.p, str) or a.p in used or is_builtin(a.p) for a in r.body)]
    index, _ = closure(start, every)
    extra = [t for t in range_meets(index) if t not in index.all]
    if extra:
        index, _ = closure([*index.all, *extra], every)
    return index


__all__ = ["CONTRADICTIONS", "ENTAILMENTS", "axioms", "contradictions", "list_facts", "list_rules", "rules", "schema_closure"]
