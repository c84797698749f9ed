"""Closures by component: held against plain Python, with loops, cycles, several messages and components too large for a task."""

import random
import re

import pytest

from quadloom.operators import closures
from quadloom.operators.paths import Path, evaluate, evaluate_all, transitive_closure
from quadloom.plans.storage import stored

P = "<urn:x:p>"


def brute(edges):
    after = {}
    for m, a, b in edges:
        after.setdefault((m, a), set()).add(b)
    out = set()
    for m, a in after:
        todo, seen = list(after[m, a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get((m, x), ())
        out |= {(m, a, x) for x in seen}
    return out


def graph(seed=3):
    r = random.Random(seed)
    edges = {(m, f"<urn:x:{m}-{k}-{r.randrange(9)}>", f"<urn:x:{m}-{k}-{r.randrange(9)}>") for m in (0, 1) for k in range(6) for _ in range(11)}
    edges |= {(0, f"<urn:x:c{i}>", f"<urn:x:c{i + 1}>") for i in range(70)} | {(2, "<urn:x:loop>", "<urn:x:loop>"), (0, "<urn:x:1-0-1>", "<urn:x:1-0-2>")}
    return sorted(edges)


@pytest.mark.parametrize("nodes,one", [(10_000, 2_000), (10_000, 0), (8, 0)])
def test_closure_of_any_graph(spark, monkeypatch, nodes, one):
    monkeypatch.setattr(closures, "LOCAL_NODES", nodes)
    monkeypatch.setattr(closures, "ONE_TASK", one)
    edges = graph()
    df = spark.createDataFrame(edges, "msg_id long, a string, b string")
    assert sorted(tuple(r) for r in transitive_closure(df).collect()) == sorted(brute(edges))
    assert sorted(tuple(r) for r in closures.closed(df, with_edges=False).collect()) == sorted(brute(edges) - set(edges))


def test_pairs_of_a_closure_are_not_shuffled(spark):
    """they are distinct as they are, so paths of any number of steps add no shuffle of all pairs."""
    edges = graph()
    facts = stored(spark.createDataFrame([(m, a, P, b) for m, a, b in edges], "msg_id long, s string, p string, o string"), "facts")
    plan = transitive_closure(evaluate(Path("predicate", P), facts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    star = evaluate(Path("*", parts=(Path("predicate", P),)), facts)
    nodes = {(m, x, x) for m, a, b in edges for x in (a, b)}
    assert sorted(tuple(r) for r in star.collect()) == sorted(brute(edges) | nodes)


def test_one_or_more_steps_are_not_shuffled(spark):
    """nor are the pairs of p+ beside other paths."""
    facts = stored(spark.createDataFrame([(0, f"<urn:x:{i}>", P, f"<urn:x:{i + 1}>") for i in range(5)], "msg_id long, s string, p string, o string"), "facts")
    plus = evaluate(Path("+", parts=(Path("predicate", P),)), facts)
    assert plus.count() == 15 and "Exchange" not in plus._jdf.queryExecution().executedPlan().toString()


def rounds_of(monkeypatch):
    from quadloom.plans import fixpoint

    names = []
    monkeypatch.setattr(fixpoint, "stored", lambda df, name: names.append(name) or stored(df, name))
    return names


@pytest.mark.parametrize("axiom", ["x:p a owl:TransitiveProperty.", "x:p owl:propertyChainAxiom (x:p x:p)."])
def test_transitive_property_takes_no_rounds(spark, monkeypatch, axiom):
    """F8 and F3: what no other rule reads is closed once, after the rounds; what a chain reads is still there for it."""
    from quadloom.queries import HEAD, Engine

    edges = [(m, a, b) for m, a, b in graph() if m == 0]
    facts = stored(spark.createDataFrame([(m, a, P, b) for m, a, b in edges], "msg_id long, s string, p string, o string"), "facts")
    names = rounds_of(monkeypatch)
    out = Engine(spark).load(HEAD + axiom, ["owl2rl"]).infer(facts)
    assert names.count("delta") <= 1
    assert sorted((r.msg_id, r.s, r.o) for r in out.collect()) == sorted(brute(edges) - set(edges))


def test_symmetric_transitive_property_and_what_it_implies(spark, monkeypatch):
    """a group of n concepts has n * n pairs, made once and not n times; a pair that is known by another way is left out."""
    from quadloom.queries import HEAD, Engine

    exact, close, broader = (f"<http://www.w3.org/2004/02/skos/core#{x}>" for x in ("exactMatch", "closeMatch", "broaderTransitive"))
    n = [f"<urn:x:{i}>" for i in range(5)]
    rows = [(0, n[i], exact, n[0]) for i in range(1, 4)] + [(0, n[1], close, n[2]), (0, n[0], close, n[4]), (0, n[3], broader, n[4]), (0, n[4], broader, n[0])]
    facts = stored(spark.createDataFrame(rows, "msg_id long, s string, p string, o string"), "facts")
    names = rounds_of(monkeypatch)
    got = Engine(spark).load(HEAD, ["skos"]).infer(facts).collect()
    assert names.count("delta") <= 2 and len(got) == len(set(got))
    of = lambda p: {(r.s, r.o) for r in got if r.p == p}
    group = {(a, b) for a in n[:4] for b in n[:4]}
    assert of(exact) == group - {(r[1], r[3]) for r in rows if r[2] == exact}
    assert of(close) == (group | {(n[4], n[0])}) - {(n[1], n[2])}
    assert of(broader) == {(n[3], n[0])}
    related = of("<http://www.w3.org/2004/02/skos/core#semanticRelation>")
    assert related == group | {(n[0], n[4]), (n[4], n[0]), (n[3], n[4]), (n[4], n[3])}


@pytest.mark.parametrize("more", [[], [(0, "<urn:x:1>", "<urn:x:k>", '"2"')], [(0, "<urn:x:1>", "<urn:x:same>", "<urn:x:5>")]])
def test_pairs_that_agree_in_a_key(spark, monkeypatch, more):
    """halves are joined in all that they share, once; where no subject has two keys the pairs aren't shuffled."""
    from quadloom.queries import HEAD, Engine, Profile

    rows = [(0, f"<urn:x:{i}>", f"<urn:x:{p}>", f'"{i % n}"') for i in range(24) for p, n in (("k", 4), ("l", 2))] + [(1, "<urn:x:0>", "<urn:x:k>", '"0"'), (1, "<urn:x:0>", "<urn:x:l>", '"0"')] + more
    facts = stored(spark.createDataFrame(rows, "msg_id long, s string, p string, o string"), "facts")
    names = rounds_of(monkeypatch)
    rule = "{ ?a x:k ?u; x:l ?v. ?b x:k ?u; x:l ?v. ?a log:notEqualTo ?b } => { ?a x:same ?b }."
    got = [tuple(r) for r in Engine(spark).load("", [Profile(HEAD + rule)]).infer(facts).select("msg_id", "s", "o").collect()]
    values = {}
    for m, s, p, o in rows:
        values.setdefault((m, s), {}).setdefault(p, set()).add(o)
    agree = lambda a, b: all(values[a].get(p, set()) & values[b].get(p, set()) for p in ("<urn:x:k>", "<urn:x:l>"))
    want = {(a[0], a[1], b[1]) for a in values for b in values if a[0] == b[0] and a != b and agree(a, b)}
    assert sorted(got) == sorted(want - {(m, s, o) for m, s, p, o in more if p == "<urn:x:same>"})
    assert ("delta" in names) == bool(more)


def stored_names(monkeypatch):
    names = []
    monkeypatch.setattr(closures, "stored", lambda df, name: names.append(name) or stored(df, name))
    return names


def test_chains_are_stored_as_runs(spark, monkeypatch):
    """a chain of n nodes has n * n / 2 pairs; what is stored is a run for each node, and its component takes no rounds."""
    monkeypatch.setattr(closures, "ONE_TASK", 0)
    names = stored_names(monkeypatch)
    chain = [(0, f"<urn:x:{i}>", f"<urn:x:{i + 1}>") for i in range(120)]
    random.Random(1).shuffle(chain)
    for with_edges in (True, False):
        blocks, large = closures.closed_blocks(stored(spark.createDataFrame(chain, "msg_id long, a string, b string"), "paths"), with_edges)
        assert large is None and blocks.selectExpr("sum(size(at))").first()[0] == 119 + with_edges
        assert sorted(tuple(r) for r in closures.expanded(blocks).collect()) == sorted(brute(chain) - (set() if with_edges else set(chain)))
    assert "part-move" not in names


def test_components_by_rounds_and_by_one_task(spark, monkeypatch):
    """rounds contract what is more than one task labels; the labels are the same groups."""
    monkeypatch.setattr(closures, "LABELLED", 40)
    names = stored_names(monkeypatch)
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 230)] + [(300, 300), (301, 302), (302, 301)]
    got = {}
    for r in closures.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.part, set()).add(r.node)
    assert names.count("part-move") >= 1
    assert sorted(map(sorted, got.values())) == [list(range(101)), list(range(200, 230)), [301, 302]]


def test_several_paths_read_the_facts_once(spark):
    """the same pairs as one by one, and the facts, here counted, are made once for all of them."""
    made = spark.sparkContext.accumulator(0)
    edges = graph()

    def count(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    step, other = Path("predicate", P), Path("predicate", "<urn:x:none>")
    back = Path("inverse", parts=(step,))
    paths = [Path("+", parts=(step,)), Path("?", parts=(step,)), Path("*", parts=(step,)), Path("sequence", parts=(back, back)), Path("+", parts=(Path("alternative", parts=(step, other)),)), step]
    facts = spark.createDataFrame([(m, a, P, b) for m, a, b in edges], "msg_id long, s string, p string, o string")
    got = [sorted(tuple(r) for r in df.collect()) for df in evaluate_all(paths, facts.mapInArrow(count, facts.schema))]
    assert made.value == len(edges)
    assert got == [sorted(tuple(r) for r in evaluate(p, facts).collect()) for p in paths] and got[0] == sorted(brute(edges))


def test_groups_are_stored_as_runs(spark, monkeypatch):
    """a symmetric group of n terms has n * n pairs; stored are at most two runs a term where its edges are left out, else one."""
    monkeypatch.setattr(closures, "ONE_TASK", 0)
    star = [(0, *pair) for i in range(1, 40) for pair in ((f"<urn:x:{i}>", "<urn:x:0>"), ("<urn:x:0>", f"<urn:x:{i}>"))]
    for with_edges, most in ((True, 40), (False, 80)):
        blocks, _ = closures.closed_blocks(stored(spark.createDataFrame(star, "msg_id long, a string, b string"), "paths"), with_edges)
        assert blocks.selectExpr("sum(size(at))").first()[0] <= most
        assert sorted(tuple(r) for r in closures.expanded(blocks).collect()) == sorted(brute(star) - (set() if with_edges else set(star)))


def test_pairs_of_a_run_are_made_by_themselves(spark):
    """generated code holds what it makes of one row: that is a run here and not a whole block, whose slices aren't made thrice."""
    star = [(0, *pair) for i in range(1, 9) for pair in ((f"<urn:x:{i}>", "<urn:x:0>"), ("<urn:x:0>", f"<urn:x:{i}>"))]
    blocks, _ = closures.closed_blocks(stored(spark.createDataFrame(star, "msg_id long, a string, b string"), "paths"))
    made = closures.expanded(blocks)
    plan = made._jdf.queryExecution().executedPlan().toString().split("\n")
    stage = {kind: re.search(r"\*\((\d+)\) Generate", line) for line in plan for kind in ("posexplode(", " explode(") if kind in line}
    assert len(stage) == 2 and len({m and m[1] for m in stage.values()}) == 2 and "\n".join(plan).count("slice(") == 1
    assert sorted(tuple(r) for r in made.collect()) == sorted(brute(star))


@pytest.mark.parametrize("wanted", [["closeMatch", "related"], ["broaderTransitive", "mappingRelation"], ["nothing"]])
def test_only_what_the_wanted_predicates_need(spark, monkeypatch, wanted):
    """the same statements as among all, and closures that none of them needs aren't made."""
    from quadloom.queries import HEAD, Engine

    skos = "<http://www.w3.org/2004/02/skos/core#{}>".format
    rows = [(0, f"<urn:x:{i}>", skos(p), f"<urn:x:{i // 2}>") for i in range(1, 7) for p in ("exactMatch", "broadMatch", "relatedMatch")]
    facts = stored(spark.createDataFrame(rows, "msg_id long, s string, p string, o string"), "facts")
    engine, wanted = Engine(spark).load(HEAD, ["skos"]), [skos(p) for p in wanted]
    every = sorted(tuple(r) for r in engine.infer(facts).collect() if r.p in wanted)
    names = rounds_of(monkeypatch)
    assert sorted(tuple(r) for r in engine.infer(facts, predicates=wanted).collect()) == every
    assert bool(every) == (wanted != [skos("nothing")]) and names.count("paths") == {skos("closeMatch"): 1, skos("nothing"): 0}.get(wanted[0], 3)
