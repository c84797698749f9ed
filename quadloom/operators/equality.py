"""Equality as classes: a representative of each group of equal terms instead of joins of owl:sameAs with itself.

eq-sym, eq-trans, prp-fp and prp-ifp as joins make a row for each triple of equal terms. Here each group of a functional
property gives a star around its least term, the stars and what is asserted are contracted to classes, and the pairs of
a class are expanded once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closures import squares
from quadloom.plans.compile import Variant
from quadloom.plans.fixpoint import agreeing, twin
from quadloom.plans.rules import Atom, Formula, Var
from quadloom.plans.storage import stored
from quadloom.terms import is_iri
from quadloom.vocab import LOG, OWL


#: Edges whose classes one task finds; more of them are contracted in rounds.
ONE_TASK = 200_000


def _merger():
    """A function for mapInArrow over one partition of (msg_id, a, b): (msg_id, node, rep). Nested, so that executors needn't have this package."""

    def merge(batches):
        import pyarrow as pa

        above = {}

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for msg, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, y = (top(above.setdefault((msg, t), (msg, t))) for t in (a, b))
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        for i in range(0, len(nodes), 1 << 14):
            some = nodes[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string()), pa.array([top(x)[1] for x in some], pa.string())], ["msg_id", "node", "rep"])

    return merge


def classes(edges: DataFrame) -> DataFrame:
    """edges (msg_id, a, b) -> (msg_id, node, rep), the least term of the node's class; messages never mix.

    Each round sends every node to the least of its closed neighbourhood, in the first by term (a star is done then), later
    by a hash that is another in each round, so that chains shrink by a constant share per round too. What one task can
    hold takes no rounds.
    """
    if edges.count() <= ONE_TASK:
        return edges.select("msg_id", "a", "b").repartition(1).mapInArrow(_merger(), "msg_id long, node string, rep string")
    node = lambda c: F.struct(F.col("msg_id").alias("m"), F.col(c).alias("t"))
    start = stored(edges.select(node("a").alias("a"), node("b").alias("b")).distinct(), "same-edges")
    root = start.select(F.col("a").alias("node")).unionByName(start.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    now, rounds = start.where("a <> b"), 0
    while not now.isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c, n=rounds: F.struct((F.xxhash64(F.col(c), F.lit(n)) if n else F.lit(0).cast("long")).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        move = stored(least.select(F.col("a").alias("from"), F.least(F.col("m"), key("a"))["n"].alias("to")), "same-move")
        ends = now.join(move.select(F.col("from").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("from").alias("b"), F.col("to").alias("tb")), "b")
        now = stored(ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "same-edges")
        root = stored(root.join(move, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "same-roots")
        rounds += 1
    least = root.groupBy("root").agg(F.min("node").alias("rep"))
    return root.join(least, "root").select(F.col("node.m").alias("msg_id"), F.col("node.t").alias("node"), F.col("rep.t").alias("rep"))


class Equality:
    """Candidates of a fixpoint's rounds: the pairs of all classes, when a round has brought something new to them."""

    def __init__(self, functional: set[str], inverse: set[str], twins: list[Variant] = (), put_off: bool = False):
        """twins: rules by which what agrees in patterns of its own is the same. put_off: no rule reads the pairs, so they
        are added by final(), and classes are substituted here: a term by all of its class, in each position."""
        self.functional, self.inverse, self.twins, self.put_off = sorted(functional), sorted(inverse), list(twins), put_off
        self.classes: DataFrame | None = None

    def _edges(self, delta: DataFrame, known: DataFrame) -> DataFrame:
        out = delta.where(F.col("p") == OWL.sameAs).select("msg_id", F.col("s").alias("a"), F.col("o").alias("b"))
        for names, one, many in ((self.functional, "s", "o"), (self.inverse, "o", "s")):
            if names:
                group = ["msg_id", "p", one]
                met = known.where(F.col("p").isin(names))
                if delta is not known:
                    met = met.join(delta.where(F.col("p").isin(names)).select(*group).distinct(), group, "left_semi")
                reps = met.groupBy(*group).agg(F.min(many).alias("b"))
                out = out.unionByName(met.join(reps, group).select("msg_id", F.col(many).alias("a"), "b"))
        for v in self.twins:
            atoms, shared = twin(v)
            if delta is not known and delta.where(F.col("p").isin([a.p for a in atoms])).isEmpty():
                continue
            half, group = stored(agreeing(known, atoms, shared), "halves"), ["msg_id", *(f"v_{n}" for n in shared)]
            out = out.unionByName(half.join(half.groupBy(*group).agg(F.min("node").alias("b")), group).select("msg_id", F.col("node").alias("a"), "b"))
        return out.distinct()

    def _substituted(self, facts: DataFrame) -> list[DataFrame]:
        """eq-rep-s, eq-rep-p and eq-rep-o by way of the representative: each fact of a class once, then for each of its members."""
        out, others = [], facts.where(F.col("p") != OWL.sameAs)
        for c in "spo":
            rest = [x for x in "spo" if x != c]
            met = others.join(self.classes.select("msg_id", F.col("node").alias(c), "rep"), ["msg_id", c]).select("msg_id", "rep", *rest).distinct()
            out.append(met.join(self.classes.select("msg_id", "rep", F.col("node").alias(c)), ["msg_id", "rep"]).where(is_iri(F.col("p"))).select("msg_id", "s", "p", "o"))
        return out

    def final(self, known: DataFrame) -> list[DataFrame]:
        """All pairs of all classes, without those that are known."""
        if self.classes is None or not self.put_off:
            return []
        pairs = squares(self.classes, ["msg_id", "rep"]).select("msg_id", F.col("a").alias("s"), F.lit(OWL.sameAs).alias("p"), F.col("b").alias("o"))
        said = known.where(F.col("p") == OWL.sameAs).select("msg_id", "s", "p", "o")
        return [pairs if said.isEmpty() else pairs.join(said, ["msg_id", "s", "p", "o"], "left_anti")]

    def __call__(self, delta: DataFrame, known: DataFrame) -> list[DataFrame]:
        if self.classes is None:
            edges = stored(self._edges(known, known), "same-edges")
        else:
            at = lambda c: self.classes.select("msg_id", F.col("node").alias(c), F.col("rep").alias(f"r_{c}"))
            met = self._edges(delta, known).join(at("a"), ["msg_id", "a"], "left").join(at("b"), ["msg_id", "b"], "left")
            edges = stored(met.where("r_a is null or r_b is null or r_a <> r_b").select("msg_id", "a", "b"), "same-edges")
        if edges.isEmpty():
            return self._substituted(delta) if self.put_off and self.classes is not None else []
        if self.classes is not None:
            edges = edges.unionByName(self.classes.select("msg_id", F.col("node").alias("a"), F.col("rep").alias("b")))
        self.classes = stored(classes(edges), "same-classes")
        if self.put_off:
            return self._substituted(known)
        ends = [self.classes.select("msg_id", "rep", F.col("node").alias(c)) for c in "so"]
        return [ends[0].join(ends[1], ["msg_id", "rep"]).select("msg_id", "s", F.lit(OWL.sameAs).alias("p"), "o")]


def taken_over(variants: list[Variant], put_off: bool = False) -> tuple[list[Variant], Equality | None]:
    """The variants that remain as rules, and what replaces the others.

    Substitution into sameAs itself is left out: the pairs of a class are complete. Variants that the background answers
    in part, and properties that the data declares, remain: the pairs they give are edges. put_off: pairs may be left to
    final(), where no rule but substitution reads them.
    """
    rest, found, twins, closing = [], {"prp-fp": set(), "prp-ifp": set()}, [], False
    for v in variants:
        if v.name in ("eq-sym", "eq-trans") and not v.builtins and not v.static_vars and all(a.p == OWL.sameAs and isinstance(a.s, Var) and isinstance(a.o, Var) for a in v.data):
            closing = True
        elif v.name in found and len(v.data) == 2 and not v.builtins and v.data[0].p == v.data[1].p and isinstance(v.data[0].p, str) and all(isinstance(t, Var) for a in v.data for t in (a.s, a.o)) and not v.static_vars:
            found[v.name].add(v.data[0].p)
        elif v.name in found and len(v.data) == 2 and not v.builtins and v.data[0].p == v.data[1].p and isinstance(v.data[0].p, Var) and v.static_vars == [v.data[0].p.name]:
            found[v.name] |= {row[0] for row in v.static}
        elif len(v.head) == 1 and v.head[0].p == OWL.sameAs and twin(v) and all(a.p != OWL.sameAs for a in v.data):
            twins.append(v)
        else:
            rest.append(v)
    if not closing:
        return variants, None
    whole = lambda v: v.name in ("eq-rep-s", "eq-rep-o") and len(v.data) == 2 and not v.static_vars and isinstance(v.data[1].p, Var)
    substitutes = lambda v: v.name in ("eq-rep-s", "eq-rep-p", "eq-rep-o") and len(v.data) == 2 and not v.static_vars and not v.builtins and v.data[0].p == OWL.sameAs and all(isinstance(t, Var) for t in (*v.data[0].terms[::2], *v.data[1].terms))
    others = [v for v in rest if not substitutes(v)]
    if put_off and len(rest) - len(others) == 3 and not any(_reads_same(v) for v in others):
        return others, Equality(found["prp-fp"], found["prp-ifp"], twins, True)
    rest = [replace(v, builtins=[*v.builtins, Atom(v.data[1].p, LOG.notEqualTo, OWL.sameAs)]) if whole(v) else v for v in rest]
    return rest, Equality(found["prp-fp"], found["prp-ifp"], twins)


def _reads_same(v: Variant) -> bool:
    for a in [*v.data, *(a for b in v.builtins if isinstance(b.o, Formula) for a in b.o.atoms)]:
        if a.p == OWL.sameAs or isinstance(a.p, Var) and (a.p.name not in v.static_vars or any(r[v.static_vars.index(a.p.name)] == OWL.sameAs for r in v.static)):
            return True
    return False


__all__ = ["Equality", "classes", "taken_over"]
