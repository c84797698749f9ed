"""Property paths: read from shapes on the driver, evaluated as joins, unions and closures over statements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closures import closed, closed_pairs
from quadloom.plans.local import Index
from quadloom.plans.storage import stored
from quadloom.vocab import SH

KINDS = {SH.zeroOrMorePath: "*", SH.oneOrMorePath: "+", SH.zeroOrOnePath: "?"}


@dataclass(frozen=True)
class Path:
    """kind: predicate, inverse, sequence, alternative, *, + or ?."""

    kind: str
    predicate: str = ""
    parts: tuple[Path, ...] = ()

    @property
    def text(self) -> str:
        if self.kind == "predicate":
            return self.predicate
        inner = [p.text for p in self.parts]
        if self.kind == "inverse":
            return f"^{inner[0]}"
        return "/".join(inner) if self.kind == "sequence" else "(" + "|".join(inner) + ")" if self.kind == "alternative" else f"({inner[0]}){self.kind}"

    @property
    def predicates(self) -> list[str]:
        return [self.predicate] if self.kind == "predicate" else [x for p in self.parts for x in p.predicates]

    @property
    def depth(self) -> int:
        return 1 if self.kind == "predicate" else sum(p.depth for p in self.parts) if self.kind == "sequence" else max(p.depth for p in self.parts)

    @property
    def kinds(self) -> set[str]:
        return {self.kind}.union(*(p.kinds for p in self.parts))

    def steps(self) -> list[tuple[str, bool]] | None:
        """(predicate, inverse) of a path without alternatives and repetition, else None."""
        if self.kind == "predicate":
            return [(self.predicate, False)]
        inner = [p.steps() for p in self.parts]
        if any(x is None for x in inner) or self.kind not in ("inverse", "sequence"):
            return None
        return [(p, not inv) for p, inv in reversed(inner[0])] if self.kind == "inverse" else [x for part in inner for x in part]

    def to_json(self) -> list:
        return [self.kind, self.predicate, [p.to_json() for p in self.parts]]

    @staticmethod
    def from_json(data: list) -> Path:
        return Path(data[0], data[1], tuple(Path.from_json(x) for x in data[2]))


def read_path(term: str, index: Index) -> Path | None:
    """The path that a shape's term stands for; None if it is malformed."""
    if term[0] == "<":
        return Path("predicate", term)
    items = index.items(term)
    if items:
        parts = [read_path(x, index) for x in items]
        return None if None in parts else Path("sequence", parts=tuple(parts)) if len(parts) > 1 else parts[0]
    for p, kind in {SH.inversePath: "inverse", SH.alternativePath: "alternative", **KINDS}.items():
        for _, _, o in sorted(index.by_ps.get((p, term), ())):
            if kind == "alternative":
                parts = [read_path(x, index) for x in index.items(o) or ()]
                return Path("alternative", parts=tuple(parts)) if parts and None not in parts else None
            inner = read_path(o, index)
            return Path(kind, parts=(inner,)) if inner else None
    return None


def evaluate_all(paths: list[Path], facts: DataFrame) -> list[DataFrame]:
    """evaluate() of each: facts are made once, and so are the pairs of each predicate and the nodes."""
    facts = stored(facts.select("msg_id", "s", "p", "o"), "facts")
    steps = {p: stored(evaluate(Path("predicate", p), facts), "steps") for p in sorted({p for path in paths for p in path.predicates})}
    nodes = stored(_nodes(facts), "nodes") if any(path.kinds & {"*", "?"} for path in paths) else None
    return [evaluate(path, facts, steps, nodes) for path in paths]


def evaluate(path: Path, facts: DataFrame, steps: dict[str, DataFrame] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (msg_id, a, b) that the path connects. Repetition includes each node itself where the path allows.

    steps: the pairs of predicates, where they are stored already; nodes: each with itself, likewise."""
    if path.kind == "predicate":
        if steps and path.predicate in steps:
            return steps[path.predicate]
        return facts.where(F.col("p") == path.predicate).select("msg_id", F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    parts = [evaluate(p, facts, steps, nodes) for p in path.parts]
    if path.kind == "inverse":
        return parts[0].select("msg_id", F.col("b").alias("a"), F.col("a").alias("b"))
    if path.kind == "alternative":
        return reduce(DataFrame.unionByName, parts).distinct()
    if path.kind == "sequence":
        out = parts[0]
        for step in parts[1:]:
            out = out.withColumnRenamed("b", "m").join(step.withColumnRenamed("a", "m"), ["msg_id", "m"]).select("msg_id", "a", "b").distinct()
        return out
    if path.kind in "*+" and steps and path.parts[0].kind == "predicate":  # distinct and stored
        out = closed_pairs(parts[0])
    else:
        out = transitive_closure(parts[0]) if path.kind in "*+" else parts[0]
    return out if path.kind == "+" else out.where("a <> b").unionByName(_nodes(facts) if nodes is None else nodes)  # distinct: both are, and only one has a = b


def _nodes(facts: DataFrame) -> DataFrame:
    both = facts.select("msg_id", F.explode(F.array("s", "o")).alias("a")).distinct()
    return both.select("msg_id", "a", F.col("a").alias("b"))


def transitive_closure(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(msg_id, a, b) closed under composition, each pair once: by component, and by doubling where one is large."""
    return closed(pairs, max_rounds=max_rounds)
