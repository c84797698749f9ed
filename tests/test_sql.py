import pytest

from quadloom.engine import Engine, Profile, statements
from quadloom.plans import sql
from quadloom.vocab import PREFIXES

HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + "@prefix : <urn:x:> .\n"
CASES = [
    ("{ ?s :e ?o } => { ?s :r ?o }. { ?s :r ?m. ?m :e ?o } => { ?s :r ?o }.", ":a :e :b. :b :e :c."),
    ("{ (?x ?f) :scaled ?y } <= { (?x ?f) math:product ?y }. { ?s :i ?x. (?x 4.0) :scaled ?y } => { ?s :r ?y }.", ":s :i 2.0."),
    ("{ ?s :i ?o. 1 log:notIncludes { ?s :b true } } => { ?s :r ?o }.", ":a :i 1. :b :i 2; :b true."),
    ('{ ?s :i ?x. ("n-" ?x) string:concatenation ?l. ?l string:startsWith "n". ?l dt:datatype ?d } => { ?s :l ?l; :d ?d }.', ":s :i 5.0."),
    ("{ ?s :i ?v. (?s ?v) log:skolem ?n } => { ?s :n ?n }.", ':s :i "same"; :i "same"@nl.'),
    ("{ ?s :i ?x. (?x 2) math:product ?y } => { ?s :ok true }.", ':s :i "none".'),
    ("{ ?s :i ?x. ?x math:rounded ?y } => { ?s :r ?y }.", ":s :i -1.5."),
]
FAULTS = ["{ ?s :i ?x. (?x 2) math:exponentiation ?y } => { ?s :r ?y }.", "{ ?s :i ?x } => { ?s :r ?u }.", "{ ?s :i ?x } => { ?s :r [ :v ?x ] }.", "{ ?s :i ?x } => { ?x math:equalTo 1 }.", "{ ?s :h ?o } <= { ?s :h ?o }. { ?s :h ?o } => { ?s :r ?o }.", "{ ?s :i ?x. (?u 2) math:product ?y } => { ?s :r ?y }.", "<urn:g> { :s :i 1 }", "not N3"]


@pytest.mark.parametrize("rules,data", CASES)
def test_programs_agree_with_the_engine(spark, rules, data):
    facts = statements(spark, HEAD + data)
    program = sql.translate(HEAD + rules).program
    got = sorted(tuple(r)[1:] for r in sql.execute(spark, sql.Program.from_json(program.to_json()), facts)["derived"].collect())
    want = sorted(tuple(r)[1:] for r in Engine(spark, "conformance").load("", [Profile(HEAD + rules)]).infer(facts).collect())
    assert got == want


@pytest.mark.parametrize("rules", FAULTS)
def test_faults_give_no_program(rules):
    made = sql.translate(HEAD + rules)
    assert made.program is None and any(d["severity"] == "error" for d in made.diagnostics)


def test_seeds_unused_helpers_and_limits(spark):
    made = sql.translate(HEAD + "{ ?a :u ?c } <= { ?a :v ?c }. :f :amount 2. { ?s :i ?x. :f :amount ?f. (?x ?f) math:product ?y } => { ?s :i2 ?y }.")
    assert any("unreachable" in d["message"] for d in made.diagnostics)
    out = sql.execute(spark, made.program, statements(spark, HEAD + ":s :i 3."))
    assert [r.o for r in out["derived"].collect()] == ['"6"^^<http://www.w3.org/2001/XMLSchema#integer>']
    loop = sql.translate(HEAD + "{ ?s :i ?x. (?x 1) math:sum ?y } => { ?s :i ?y }.").program
    with pytest.raises(RuntimeError, match="did not converge"):
        sql.execute(spark, loop, statements(spark, HEAD + ":s :i 1."), max_rounds=3)
    with pytest.raises(RuntimeError, match="exceeded"):
        sql.execute(spark, loop, statements(spark, HEAD + ":s :i 1."), max_facts=1)
    with pytest.raises(Exception, match="blank-node"):
        blank = sql.translate(HEAD + "{ ?s :i ?v. (?s ?v) log:skolem ?n } => { ?s :n ?n }.").program
        sql.execute(spark, blank, statements(spark, HEAD + "_:s :i 1."))["derived"].count()
