import pytest

from quadloom.plans.local import Index
from quadloom.sources import nquads, writers
from quadloom.sources.rdf import SyntaxFault, lists_of, parse, parse_triples
from quadloom.vocab import FIRST, INTERNAL, OWL, RDFS, TYPE, XSD

P = "@prefix : <urn:x:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def test_turtle_forms():
    got = parse_triples(P + ':a a :C ; :p 1, 2.5, 1e3, true, "x"@EN-gb, "y"^^xsd:token ; :q [ :r """long "quoted" text""" ] . # end')
    objects = {o for _, _, o in got}
    assert {f'"1"^^{XSD.integer}', f'"2.5"^^{XSD.decimal}', f'"1e3"^^{XSD.double}', f'"true"^^{XSD.boolean}', '"x"@en-gb', f'"y"^^{XSD.token}', f'"long "quoted" text"^^{XSD.string}'} <= objects
    assert ("<urn:x:a>", TYPE, "<urn:x:C>") in got


def test_lists_and_malformed_lists():
    got = parse_triples(P + ":a :p (:b (:c :d) ()) . _:x a :Loop .")
    items = [v for v in lists_of(got).values() if "<urn:x:b>" in v][0]
    assert len(items) == 3 and lists_of(got)[items[1]] == ["<urn:x:c>", "<urn:x:d>"]
    cyclic = [("_:a", FIRST, "<urn:x:b>"), ("_:a", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>", "_:a")]
    assert "_:a" not in lists_of(cyclic)


def test_messages_keep_empty_ones_and_their_own_blank_nodes():
    doc = parse('VERSION "1.2-messages"\nPREFIX : <urn:x:>\n_:b :p :a .\nMESSAGE\nMESSAGE\n_:b :p :c .')
    assert [len(m) for m in doc.messages] == [1, 0, 1]
    assert doc.messages[0][0][0] != doc.messages[2][0][0]


def test_graphs_quads_and_annotations():
    doc = parse(P + "<urn:g> { :a :p :b } :a :p :b <urn:h> . :a :q :c {| :since 2020 |} .")
    assert {q[3] for q in doc.quads} == {"<urn:g>", "<urn:h>", ""}
    assert any(q[1] == INTERNAL.reifiesObject and q[2] == "<urn:x:c>" for q in doc.quads)


@pytest.mark.parametrize("text", ["not N3", P + ":a :p .", P + ":a b:c :d .", P + "{ ?s :p ?o } => { ?s :q [ :r ?o ] } ."])
def test_faults(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def test_rules_forward_and_backward():
    doc = parse(P + "{ ?s :p ?o } => { ?s :q ?o } . { ?s :h ?o } <= { ?s :p ?o } . :a :p :b .")
    assert (len(doc.forward), len(doc.backward), len(doc.quads)) == (1, 1, 1)


LINES = ['<urn:a> <urn:p> "x\\ty\\u00e9\\U0001F600\\\\n"@EN .', "_:b <urn:p> _:c <urn:g> .", '<urn:a> <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> . # note', "", "# comment", '<urn:a> <urn:p> "plain \\"q\\"" .', "broken"]


def test_lines_in_columns(spark, tmp_path):
    (tmp_path / "in.nq").write_text("\n".join(LINES))
    rows = nquads.read_nquads(spark, str(tmp_path / "in.nq"), strict=False).collect()
    got = {(r.s, r.o, r.g) for r in rows}
    assert got == {("<urn:a>", '"x\tyé😀\\n"@en', None), ("_:b", "_:c", "<urn:g>"), ("<urn:a>", f'"1"^^{XSD.integer}', None), ("<urn:a>", f'"plain "q""^^{XSD.string}', None)}
    back = nquads.parse_lines(nquads.read_nquads(spark, str(tmp_path / "in.nq"), strict=False).select(nquads.line_of("g").alias("value")))
    assert {(r.s, r.o, r.g) for r in back.collect()} == got
    with pytest.raises(Exception, match="no N-Quads"):
        nquads.read_nquads(spark, str(tmp_path / "in.nq")).collect()


def test_message_tables(spark):
    messages = spark.createDataFrame([(1, "_:b <urn:p> <urn:a> .\n<urn:a> <urn:p> _:b ."), (2, ""), (3, "_:b <urn:p> <urn:c> .")], "msg_id long, text string")
    rows = nquads.read_message_table(messages)
    assert {r.s for r in rows.collect() if r.s[0] == "_"} == {"_:m1_b", "_:m3_b"}
    log = nquads.message_log(nquads.message_texts(rows.drop("g"), messages))
    assert [len(m) for m in parse(log).messages] == [2, 0, 1]


def test_writers_use_only_needed_prefixes():
    triples = [("<urn:other/a>", TYPE, OWL["Class"]), ("<urn:other/b>", RDFS.subClassOf, "<urn:other/a>"), ("<urn:x:y>", RDFS.label, '"a\nb"@en')]
    text = writers.turtle(triples, {"unused": "urn:unused#"})
    assert "unused" not in text and "@prefix ns1: <urn:other/>" in text
    assert set(parse_triples(text)) == set(triples)
    log = writers.trig_messages([triples, [], triples[:1]])
    assert [len(m) for m in parse(log).messages] == [3, 0, 1]


def test_rdf_xml_with_imports():
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">'
    one = head + '<owl:Ontology rdf:about="urn:one"><owl:imports rdf:resource="urn:two"/></owl:Ontology><owl:Class rdf:about="urn:A"><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="urn:B"/><rdf:Description rdf:about="urn:C"/></owl:unionOf><rdfs:label xml:lang="en">A</rdfs:label></owl:Class></rdf:RDF>'
    two = head + '<owl:Class rdf:about="urn:B"><rdfs:subClassOf rdf:resource="urn:D"/><owl:imports rdf:resource="urn:one"/></owl:Class></rdf:RDF>'
    got = writers.rdf_xml(one, "urn:one", {"urn:two": two, "urn:one": one}.__getitem__)
    assert ("<urn:B>", RDFS.subClassOf, "<urn:D>") in got and ("<urn:A>", RDFS.label, '"A"@en') in got
    index = Index(got)
    assert index.items(next(o for s, p, o in got if p == OWL.unionOf)) == ["<urn:B>", "<urn:C>"]


def test_addresses_with_negotiation():
    from quadloom.sources.remote import UnknownMedia, fetch

    pages = {"http://x/a": ("<b> a <C> .", "text/turtle; charset=utf-8"), "http://x/a.rdf": ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="b"/></rdf:RDF>', ""), "http://x/p": ("<p>", "text/html")}
    opener = lambda url, headers: pages[url] if "text/turtle" in headers["Accept"] else None
    assert fetch("http://x/a", opener) == [("<http://x/b>", TYPE, "<http://x/C>")] and fetch("http://x/a.rdf", opener) == []
    with pytest.raises(UnknownMedia):
        fetch("http://x/p", opener)
