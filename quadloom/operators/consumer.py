"""Fields that a consumer's shapes select from facts: each field is a branch of its own, and the branches are a union.

Fields aren't joined with one another, so records with several values of several fields don't multiply.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.emit import valid_statements
from quadloom.operators.paths import Path, evaluate, read_path
from quadloom.operators.shape_plan import ShapeGraph, compile_shapes
from quadloom.plans.local import Index, Triple
from quadloom.terms import split_literal
from quadloom.vocab import SH, TYPE

#: Constraints that only a check of the finished graph could apply.
ADVISORY = {"uniqueLang", "qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "qualifiedValueShapesDisjoint"}
CHILDREN = ("or_", "and_", "xone")


class ProjectionFault(ValueError):
    """A shape that selects nothing that could be constructed."""


@dataclass(frozen=True)
class Branch:
    """From the roots of a selector along steps; the triples of the last field, or the type of the node reached."""

    selector: tuple[str, str]
    before: tuple[tuple[str, bool], ...]
    steps: tuple[tuple[str, bool], ...] = ()
    types: bool = False


@dataclass
class Projection:
    branches: list[Branch] = field(default_factory=list)
    constants: list[tuple[tuple[str, str], str]] = field(default_factory=list)  # (selector, class of its roots)
    typed: list[tuple[tuple[str, str], str]] = field(default_factory=list)  # (selector, sh:class)
    mappings: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def compile_projection(shapes: Iterable[Triple]) -> Projection:
    index = Index(shapes)
    plan: ShapeGraph = compile_shapes(index.all)
    out = Projection()
    get = lambda s, p: sorted(o for _, _, o in index.by_ps.get((SH[p.rstrip("_")], s), ()))
    active = lambda s: not any(split_literal(o)[0] in ("true", "1") for o in get(s, "deactivated") if split_literal(o))

    def warn(text: str) -> None:
        if text not in out.warnings:
            out.warnings.append(text)

    def children(s: str) -> list[str]:
        lists = [x for k in CHILDREN for head in get(s, k) for x in _items(index, head)]
        return [*get(s, "node"), *get(s, "qualifiedValueShape"), *lists]

    for s, p, _ in sorted(index.all):
        if p.startswith(f"<{SH}") and p[len(SH) + 1 : -1] in ADVISORY and active(s):
            warn(f"{p} needs the complete graph and isn't checked")
    referenced = {o for k in ("property", "node", "not", "qualifiedValueShape") for _, _, o in index.by_p.get(SH[k], ())}
    referenced |= {x for k in CHILDREN for _, _, head in index.by_p.get(SH[k.rstrip("_")], ()) for x in _items(index, head)}
    targeted = [s for s in plan.shapes if s.target_classes or s.target_nodes or s.subjects_of or s.objects_of]
    defined = {t[0] for t in index.all}
    roots = [s for s in (targeted or [s for s in plan.shapes if s.id not in referenced]) if active(s.id)]
    if not roots:
        raise ProjectionFault("there is no active shape with a target or a path")

    def project(shape: str, selector: tuple[str, str], before: tuple, above: frozenset) -> None:
        if not active(shape):
            return
        if shape not in defined:
            raise ProjectionFault(f"shape {shape} is not defined")
        if shape in above:
            warn(f"the recursive shape {shape} is followed once")
            return
        below = above | {shape}
        own_path = get(shape, "path")
        for f in [*get(shape, "property"), *([shape] if own_path else [])]:
            if not active(f):
                continue
            path = next((read_path(p, index) for p in get(f, "path")), None)
            if path is None:
                raise ProjectionFault(f"property shape {f} has no path that can be read")
            steps = path.steps()
            if steps is None:
                raise ProjectionFault(f"{path.text}: alternatives and repetition can't be constructed")
            out.branches.append(Branch(selector, before, tuple(steps)))
            required = any(int(split_literal(o)[0]) > 0 for o in get(f, "minCount")) or bool(get(f, "hasValue"))
            mapping = {"shape": shape, "path": path.text, "required": required}
            if mapping not in out.mappings:
                out.mappings.append(mapping)
            if get(f, "class") or get(f, "node") or any(get(f, k) for k in CHILDREN):
                out.branches.append(Branch(selector, (*before, *steps), (), True))
            for child in children(f):
                project(child, selector, (*before, *steps), below)
        if not own_path:
            for child in children(shape):
                project(child, selector, before, below)

    for s in roots:
        selectors = [("class", c) for c in s.target_classes] + [("node", n) for n in s.target_nodes] + [("subjects", p) for p in s.subjects_of] + [("objects", p) for p in s.objects_of]
        if not selectors:
            selectors = [("path", repr(x.path.to_json())) for x in s.properties]
        for selector in selectors:
            if selector[0] == "class":
                out.constants.append((selector, selector[1]))
            out.typed += [(selector, c) for c in s.classes]
            project(s.id, selector, (), frozenset())
    return out


def _items(index: Index, head: str) -> list[str]:
    items = index.items(head)
    if items is None:
        raise ProjectionFault(f"list {head} is cyclic or malformed")
    return items


def _roots(selector: tuple[str, str], facts: DataFrame) -> DataFrame:
    kind, term = selector
    if kind == "class":
        out = facts.where((F.col("p") == TYPE) & (F.col("o") == term)).select("msg_id", F.col("s").alias("root"))
    elif kind == "node":
        out = facts.select("msg_id", F.lit(term).alias("root"))
    elif kind == "path":
        import ast

        out = evaluate(Path.from_json(ast.literal_eval(term)), facts).select("msg_id", F.col("a").alias("root"))
    else:
        out = facts.where(F.col("p") == term).select("msg_id", F.col("s" if kind == "subjects" else "o").alias("root"))
    return out.distinct()


def _step(nodes: DataFrame, step: tuple[str, bool], facts: DataFrame) -> DataFrame:
    """nodes (msg_id, node, ...) -> with `next`, one step on; inverse steps go from object to subject."""
    predicate, inverse = step
    a, b = ("o", "s") if inverse else ("s", "o")
    edges = facts.where(F.col("p") == predicate).select("msg_id", F.col(a).alias("node"), F.col(b).alias("next"))
    return nodes.join(edges, ["msg_id", "node"])


def project(facts: DataFrame, projection: Projection) -> DataFrame:
    """The statements that the projection selects."""
    out: list[DataFrame] = []
    for b in projection.branches:
        nodes = _roots(b.selector, facts).withColumnRenamed("root", "node")
        for step in b.before:
            nodes = _step(nodes, step, facts).select("msg_id", F.col("next").alias("node")).distinct()
        if b.types:
            out.append(facts.where(F.col("p") == TYPE).join(nodes.withColumnRenamed("node", "s"), ["msg_id", "s"], "left_semi").select("msg_id", "s", "p", "o"))
            continue
        # All steps must be there: the triples of a sequence are made from whole matches.
        met, made = nodes.withColumn("n0", F.col("node")), []
        for i, step in enumerate(b.steps):
            met = _step(met, step, facts).drop("node").withColumn(f"n{i + 1}", F.col("next")).withColumnRenamed("next", "node")
            x, y = (F.col(f"n{i + 1}"), F.col(f"n{i}")) if step[1] else (F.col(f"n{i}"), F.col(f"n{i + 1}"))
            made.append(F.struct(x.alias("s"), F.lit(step[0]).alias("p"), y.alias("o")))
        out.append(met.select("msg_id", F.explode(F.array(*made)).alias("t")).select("msg_id", "t.s", "t.p", "t.o"))
    for selector, c in projection.constants:
        out.append(_roots(selector, facts).select("msg_id", F.col("root").alias("s"), F.lit(TYPE).alias("p"), F.lit(c).alias("o")))
    for selector, c in projection.typed:
        typed = facts.where((F.col("p") == TYPE) & (F.col("o") == c))
        out.append(typed.join(_roots(selector, facts).withColumnRenamed("root", "s"), ["msg_id", "s"], "left_semi").select("msg_id", "s", "p", "o"))
    return valid_statements(reduce(DataFrame.unionByName, out)).distinct()
