"""Registered queries read every row of their tables: held against plain Python over the whole tables."""

import os
from collections import defaultdict

import pytest

from quadloom import queries as Q

SF = "/root/testdata/sf0.001"
SAME = "<http://www.w3.org/2002/07/owl#sameAs>"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def pairs(groups, name):
    return sorted((f"<urn:t:{name}/{a}>", f"<urn:t:{name}/{b}>") for g in groups.values() for a in g for b in g if a != b)


def test_same_as_functional_over_all_nations(spark):
    seats = defaultdict(list)
    for r in table(spark, "nation"):
        seats[r.n_regionkey].append(r.n_nationkey)
    got = Q.same_as_functional(spark, SF).collect()
    assert sorted((r.s, r.o) for r in got) == pairs(seats, "nation")


def test_same_as_inverse_functional_over_all_parts(spark):
    names = defaultdict(list)
    for r in table(spark, "part"):
        names[r.p_name].append(r.p_partkey)
    got = Q.same_as_inverse_functional(spark, SF).collect()
    assert sorted((r.s, r.o) for r in got) == pairs(names, "part")


def test_large_groups_of_equal_terms(spark):
    """Joins would make 400 ** 3 rows of one group; the classes of two groups meet through an asserted pair and a chain."""
    facts = [(0, f"<urn:x:{i}>", "<urn:x:code>", f'"{i // 400}"') for i in range(800)] + [(0, "<urn:x:7>", SAME, "<urn:x:c0>"), (0, "<urn:x:7>", "<urn:x:q>", '"z"')]
    facts += [(0, f"<urn:x:c{i}>", SAME, f"<urn:x:c{i + 1}>") for i in range(20)] + [(0, "<urn:x:c20>", SAME, "<urn:x:799>"), (1, "<urn:x:c20>", SAME, "<urn:x:799>")]
    engine = Q.Engine(spark).load(Q.HEAD + "x:code a owl:InverseFunctionalProperty.", ["owl2rl"])
    out = engine.infer(spark.createDataFrame(facts, "msg_id long, s string, p string, o string"))
    assert {r.p: r["count"] for r in out.where("msg_id = 0").groupBy("p").count().collect()} == {SAME: 821 * 820 - 22, "<urn:x:q>": 820, "<urn:x:code>": 821 * 2 - 800}
    assert [(r.s, r.o) for r in out.where("msg_id = 1").collect()] == [("<urn:x:799>", "<urn:x:c20>")]


def chains(spark):
    users = defaultdict(list)
    for r in table(spark, "events"):
        users[r.user_id].append(r.event_id)
    return [[f"<urn:t:events/{e}>" for e in sorted(c)] for c in users.values()]


def test_successors_over_all_events(spark):
    steps = sorted((a, b) for c in chains(spark) for a, b in zip(c, c[1:], strict=False))
    later = sorted((a, b) for c in chains(spark) for i, a in enumerate(c) for b in c[i + 2 :])
    ends = sorted((a, a) for c in chains(spark) if len(c) > 1 for a in c)
    assert sorted((r.a, r.b) for r in Q.path_alternative_inverse(spark, SF).collect()) == steps
    assert sorted((r.s, r.o) for r in Q.transitive_closure(spark, SF).collect()) == later
    assert sorted((r.a, r.b) for r in Q.path_star(spark, SF).collect()) == sorted(steps + later + ends)


def test_units_of_all_events(spark):
    events = {f"<urn:t:events/{r.event_id}>": r.event_id for r in table(spark, "events")}
    speed = {s: round(((n % 500) + 0.5) * (0.2777777777777778, 0.44704, 1)[n % 3], 6) for s, n in events.items()}
    assert {r.s: r.value for r in Q.unit_linear(spark, SF).collect()} == pytest.approx(speed, abs=2e-6)
    for query in (Q.unit_affine, Q.unit_log):
        assert sorted(r.s for r in query(spark, SF).collect()) == sorted(events)
    assert sorted(r.s for r in Q.unit_reverse_log(spark, SF).collect()) == sorted(s for s, n in events.items() if n % 1000)
    assert Q.measured(spark, SF, Q.F.lit("1 kg"), Q.CDT.length).count() == len(events)
    lengths = {f"<urn:t:events/{r.event_id}>" for r in table(spark, "events") if r.event_type not in ("view", "click")}
    assert {r.s for r in Q.unit_incompatible(spark, SF).collect()} == lengths
