"""Least model with the time of each fact: the earliest message at which it can be known.

A derived fact's time is the least, over its derivations, of the latest premise. With it a whole log of ordered messages
is one job: message k sees all that is known at k, and what it adds are the facts of time k. Positive rules only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.compile import RuleFault, Variant
from quadloom.plans.fixpoint import apply_mappings, instantiate, mapping_rows, solutions
from quadloom.plans.storage import stored

COLUMNS = ["s", "p", "o", "t"]


def _as_statements(df: DataFrame) -> DataFrame:
    """The time rides in msg_id of single-pattern rules; joins carry it apart."""
    return df.select(F.col("t").alias("msg_id"), "s", "p", "o")


def _joined(v: Variant, sources: list[DataFrame], every: DataFrame, lists: list[DataFrame] | None) -> DataFrame:
    """Solutions over facts of any time: a pattern's time is bound like a variable of its own, and the latest counts."""
    from quadloom.plans.rules import Atom

    frames, data = [], []
    for i, (atom, source) in enumerate(zip(v.data, sources, strict=True)):
        frames.append(source.select(F.lit(0).cast("long").alias("msg_id"), "s", "p", "o", F.col("t").alias(f"t_{i}")))
        data.append(Atom(*atom.terms))
    made = solutions(Variant(v.name, data, v.builtins, v.head, v.static_vars, v.static), frames, every.select(F.lit(0).cast("long").alias("msg_id"), "s", "p", "o"), lists, keep=[f"t_{i}" for i in range(len(data))])
    times = [F.col(f"t_{i}") for i in range(len(data))]
    return made.withColumn("msg_id", F.greatest(*times) if len(times) > 1 else times[0])


def timed_fixpoint(facts: DataFrame, variants: list[Variant], lists: list[DataFrame] | None = None, max_rounds: int = 100) -> DataFrame:
    """facts (s, p, o, t) -> all facts with their times; a fact whose time falls enters the next round again."""
    if any(v.negative for v in variants):
        raise RuleFault("rules with negation depend on the order of messages and can't be timed")
    tables = mapping_rows(v for v in variants if v.simple)
    joins = [v for v in variants if not v.simple]
    least = lambda df: df.groupBy("s", "p", "o").agg(F.min("t").alias("t"))
    known = stored(least(facts.select(*COLUMNS)), "timed")
    delta = known
    for _ in range(max_rounds):
        found = apply_mappings(_as_statements(delta), tables)
        for v in joins:
            for i in range(len(v.data)):
                found.append(instantiate(_joined(v, [delta if i == k else known for k in range(len(v.data))], known, lists), v.head))
        if not found:
            return known
        made = least(reduce(DataFrame.unionByName, found).select("s", "p", "o", F.col("msg_id").alias("t")))
        before = known.select("s", "p", "o", F.col("t").alias("was"))
        delta = stored(made.join(before, ["s", "p", "o"], "left").where(F.col("was").isNull() | (F.col("t") < F.col("was"))).select(*COLUMNS), "timed-delta")
        if delta.isEmpty():
            return known
        known = stored(least(known.unionByName(delta)), "timed")
    raise RuntimeError(f"did not converge in {max_rounds} rounds")
