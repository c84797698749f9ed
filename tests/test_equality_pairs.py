"""Pairs of equal terms are left to the end where no rule reads them: the same statements, and no pair in a round."""

import pytest

from quadloom import engine as E
from quadloom.operators import equality
from quadloom.plans.storage import stored
from quadloom.queries import HEAD
from quadloom.vocab import SAME_AS, TYPE

KEYED = "x:Part owl:hasKey (x:k x:l)."
NAMED = "x:k a owl:InverseFunctionalProperty. x:l a owl:FunctionalProperty."


@pytest.mark.parametrize("ontology,finding", [(KEYED, "F6"), (NAMED, "F9")])
def test_pairs_at_the_end(spark, monkeypatch, ontology, finding):
    rows = [(m, f"<urn:x:{i}>", p, o) for m, n in ((0, 9), (1, 2)) for i in range(n) for p, o in ((TYPE, "<urn:x:Part>"), ("<urn:x:k>", f'"{i % 3}"'), ("<urn:x:l>", f"<urn:x:o{i % 2}>"))]
    # A property among equals, and a key that only substitution completes.
    rows += [(0, "<urn:x:0>", "<urn:x:q>", "<urn:x:3>"), (0, "<urn:x:new>", TYPE, "<urn:x:Part>"), (0, "<urn:x:new>", "<urn:x:k>", '"0"'), (0, "<urn:x:new>", "<urn:x:l>", "<urn:x:o1>"), (0, "<urn:x:old>", "<urn:x:k>", '"1"')]
    facts = stored(spark.createDataFrame(rows, "msg_id long, s string, p string, o string"), "facts")
    take, run, rounds = equality.taken_over, E.fixpoint, []

    def watched(f, variants, lists=None, extra=None, **more):
        seen = lambda d, k: rounds.append(d.where(E.F.col("p") == SAME_AS).count()) or extra(d, k)
        return run(f, variants, lists, extra=seen, **more)

    monkeypatch.setattr(E, "fixpoint", watched)
    got = [tuple(r) for r in E.Engine(spark).load(HEAD + ontology, ["owl2rl"]).infer(facts).collect()]
    assert rounds and not any(rounds), finding
    monkeypatch.setattr(E, "fixpoint", run)
    monkeypatch.setattr(equality, "taken_over", lambda variants, put_off=False: (variants, None))
    want = [tuple(r) for r in E.Engine(spark).load(HEAD + ontology, ["owl2rl"]).infer(facts).collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got) and any(r[2] == SAME_AS for r in got)
    assert take(E.Engine(spark).load(HEAD + ontology, ["owl2rl"]).compile({("<urn:x:k>", None), ("<urn:x:l>", None), (TYPE, "<urn:x:Part>")}), False)[1].put_off is False


@pytest.mark.parametrize("one", [200_000, 0])
def test_classes_of_few_terms_take_no_rounds(spark, monkeypatch, one):
    """one task finds the classes of what it can hold, the same as rounds do; messages stay apart, and order is by bytes."""
    monkeypatch.setattr(equality, "ONE_TASK", one)
    names = []
    monkeypatch.setattr(equality, "stored", lambda df, name: names.append(name) or stored(df, name))
    edges = [(0, f"<urn:{i}>", f"<urn:{i + 1}>") for i in range(10, 40)] + [(0, "<urn:x>", "<urn:x>"), (0, "<urn:\U0001f600>", "<urn:\ufb01>"), (1, "<urn:39>", "<urn:12>"), (1, "<urn:b>", "<urn:12>"), (1, "<urn:b>", "<urn:a>")]
    got = {(r.msg_id, r.node): r.rep for r in equality.classes(spark.createDataFrame(edges, "msg_id long, a string, b string")).collect()}
    want = {(0, f"<urn:{i}>"): "<urn:10>" for i in range(10, 41)} | {(0, "<urn:x>"): "<urn:x>", (0, "<urn:\U0001f600>"): "<urn:\ufb01>", (0, "<urn:\ufb01>"): "<urn:\ufb01>"}
    assert got == want | {(1, f"<urn:{x}>"): "<urn:12>" for x in ("12", "39", "a", "b")}
    assert bool(names) == (not one)
