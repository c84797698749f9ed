"""Shapes as trusted contracts: what a message may hold prunes the input, what a consumer takes projects the output."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.paths import Path, read_path
from quadloom.plans.fixpoint import small
from quadloom.plans.local import Index, Triple
from quadloom.plans.storage import stored
from quadloom.terms import split_literal
from quadloom.vocab import SH, TYPE

VERSION = 1


@dataclass
class PropertyPlan:
    id: str
    path: Path
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    cls: str | None = None
    node_kind: str | None = None
    has_values: list[str] = field(default_factory=list)
    in_values: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)

    @property
    def scalar(self) -> bool:
        return self.max_count == 1

    @property
    def required(self) -> bool:
        return (self.min_count or 0) > 0


@dataclass
class ShapePlan:
    id: str
    closed: bool = False
    classes: list[str] = field(default_factory=list)
    target_classes: list[str] = field(default_factory=list)
    target_nodes: list[str] = field(default_factory=list)
    subjects_of: list[str] = field(default_factory=list)
    objects_of: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    properties: list[PropertyPlan] = field(default_factory=list)

    @property
    def relevant(self) -> set[str]:
        out = {p for x in self.properties for p in x.path.predicates} | set(self.subjects_of) | set(self.objects_of)
        return out | ({TYPE} if self.classes or self.target_classes else set())

    @property
    def allowed(self) -> set[str]:
        return self.relevant | (set(self.ignored) if self.closed else set())


@dataclass
class ShapeGraph:
    shapes: list[ShapePlan]

    @property
    def relevant(self) -> set[str]:
        return set().union(*(s.relevant for s in self.shapes)) if self.shapes else set()

    def summary(self) -> str:
        paths = sorted({p.path.text for s in self.shapes for p in s.properties})
        scalar = sorted({p.path.text for s in self.shapes for p in s.properties if p.scalar})
        return f"{len(self.shapes)} shape(s); paths: {', '.join(paths) or 'none'}; scalar paths: {', '.join(scalar) or 'none'}"

    def join_hints(self) -> list[tuple[str, int]]:
        """Predicates by the number of steps of the shortest path that has them, for diagnostics: Spark orders joins itself."""
        steps: dict[str, int] = {}
        for path in (x.path for s in self.shapes for x in s.properties):
            for p in path.predicates:
                steps[p] = min(steps.get(p, path.depth), path.depth)
        return sorted(steps.items(), key=lambda x: (x[1], x[0]))

    def to_json(self) -> dict:
        """Compact: what can be derived from the rest isn't written."""
        prop = lambda x: {"i": x.id, "p": x.path.to_json(), "n": x.min_count, "m": x.max_count, "d": x.datatype, "c": x.cls, "k": x.node_kind, "h": x.has_values, "o": x.in_values, "u": x.units}
        return {"version": VERSION, "shapes": [{"i": s.id, "x": s.closed, "c": s.classes, "tc": s.target_classes, "tn": s.target_nodes, "ts": s.subjects_of, "to": s.objects_of, "g": s.ignored, "p": [prop(x) for x in s.properties]} for s in self.shapes]}

    @staticmethod
    def from_json(data: dict) -> ShapeGraph:
        if data.get("version") != VERSION:
            raise ValueError(f"shape plan version {data.get('version')!r} is not supported")
        prop = lambda x: PropertyPlan(x["i"], Path.from_json(x["p"]), x["n"], x["m"], x["d"], x["c"], x["k"], x["h"], x["o"], x["u"])
        return ShapeGraph([ShapePlan(s["i"], s["x"], s["c"], s["tc"], s["tn"], s["ts"], s["to"], s["g"], [prop(x) for x in s["p"]]) for s in data["shapes"]])


def compile_shapes(triples: Iterable[Triple]) -> ShapeGraph:
    index = Index(triples)
    get = lambda s, p: sorted(o for _, _, o in index.by_ps.get((p, s), ()))
    number = lambda s, p: next((int(split_literal(o)[0]) for o in get(s, p)), None)
    items = lambda s, p: [x for head in get(s, p) for x in index.items(head) or ()]
    marks = {SH.property, SH.targetClass, SH.targetNode, SH.targetSubjectsOf, SH.targetObjectsOf, SH.path, SH["class"], SH.closed}
    inner = {o for _, _, o in index.by_p.get(SH.property, ())}
    shapes = []
    for s in sorted({t[0] for p in marks for t in index.by_p.get(p, ())} | {t[0] for t in index.by_po.get((TYPE, SH.NodeShape), ())}):
        if s in inner and not any(get(s, t) for t in (SH.targetClass, SH.targetNode, SH.targetSubjectsOf, SH.targetObjectsOf)):
            continue
        plan = ShapePlan(s, any(split_literal(x)[0] in ("true", "1") for x in get(s, SH.closed)), get(s, SH["class"]), get(s, SH.targetClass), get(s, SH.targetNode), get(s, SH.targetSubjectsOf), get(s, SH.targetObjectsOf), items(s, SH.ignoredProperties))
        for x in [*get(s, SH.property), *([s] if get(s, SH.path) else [])]:
            path = next((read_path(p, index) for p in get(x, SH.path)), None)
            if path is not None:
                units = [u for o in get(x, SH.unit) for u in (index.items(o) or [o])]
                plan.properties.append(PropertyPlan(x, path, number(x, SH.minCount), number(x, SH.maxCount), next(iter(get(x, SH.datatype)), None), next(iter(get(x, SH["class"])), None), next(iter(get(x, SH.nodeKind)), None), get(x, SH.hasValue), items(x, SH.in_), units))
        if plan.properties or plan.target_classes or plan.target_nodes or plan.subjects_of or plan.objects_of:
            shapes.append(plan)
    return ShapeGraph(shapes)


def active_shapes(facts: DataFrame, graph: ShapeGraph) -> DataFrame:
    """(msg_id, shape): shapes whose target or one of whose predicates occurs in the message; all of them where none does."""
    spark = facts.sparkSession
    rows = []
    for s in graph.shapes:
        rows += [("node", n, s.id) for n in s.target_nodes] + [("class", c, s.id) for c in s.target_classes]
        rows += [("predicate", p, s.id) for p in {*s.subjects_of, *s.objects_of, *(s.relevant - {TYPE})}]
    signs = F.array(
        F.struct(F.lit("node").alias("kind"), F.col("s").alias("term")),
        F.struct(F.lit("node").alias("kind"), F.col("o").alias("term")),
        F.struct(F.lit("predicate").alias("kind"), F.col("p").alias("term")),
        F.struct(F.when(F.col("p") == TYPE, F.lit("class")).alias("kind"), F.col("o").alias("term")),
    )
    seen = facts.select("msg_id", F.explode(signs).alias("x")).select("msg_id", "x.kind", "x.term")
    hit = seen.join(small(spark, rows, ["kind", "term", "shape"]), ["kind", "term"]).select("msg_id", "shape").distinct()
    hit = stored(hit, "active-shapes")
    every = small(spark, [(s.id,) for s in graph.shapes], ["shape"])
    rest = facts.select("msg_id").distinct().join(hit.select("msg_id").distinct(), "msg_id", "left_anti").crossJoin(every)
    return hit.unionByName(rest.select("msg_id", "shape"))


def prune_input(facts: DataFrame, graph: ShapeGraph) -> tuple[DataFrame, dict]:
    """Statements that the contract lets through, and what was decided.

    If any active shape of a message is closed, only predicates that its closed active shapes allow stay: predicates of
    active open shapes go too. Messages without an active closed shape keep everything.
    """
    spark = facts.sparkSession
    closed = [s for s in graph.shapes if s.closed]
    info = {"enabled": True, "shapes": [s.id for s in graph.shapes], "hints": graph.join_hints()}
    if not closed:
        return facts, info
    if len(closed) == len(graph.shapes) == 1:  # the message needn't be looked at
        return facts.where(F.col("p").isin(sorted(closed[0].allowed))), info
    active = active_shapes(facts, graph)
    strict = active.where(F.col("shape").isin([s.id for s in closed]))
    allowed = strict.join(small(spark, [(s.id, p) for s in closed for p in sorted(s.allowed)], ["shape", "p"]), "shape").select("msg_id", "p").distinct()
    bound = strict.select("msg_id").distinct()
    return facts.join(bound, "msg_id", "left_anti").unionByName(facts.join(allowed, ["msg_id", "p"], "left_semi").select(*facts.columns)), info


def project_output(df: DataFrame, graph: ShapeGraph) -> DataFrame:
    """Statements that the output shapes mention: their predicates, and of constrained ones only the objects listed."""
    free, limited = set(), {}
    for s in graph.shapes:
        if s.classes:
            limited.setdefault(TYPE, set()).update(s.classes)
        for x in s.properties:
            values = [*x.has_values, *x.in_values]
            for p in x.path.predicates:
                if x.path.kind == "predicate" and values:
                    limited.setdefault(p, set()).update(values)
                else:
                    free.add(p)
    if not free and not limited:
        free = graph.relevant
    if not free and not limited:
        return df
    keep = F.col("p").isin(sorted(free)) if free else F.lit(False)
    rows = [(p, o) for p, objects in limited.items() if p not in free for o in sorted(objects)]
    for p in sorted({p for p, _ in rows}):
        keep = keep | ((F.col("p") == p) & F.col("o").isin([o for q, o in rows if q == p]))
    return df.where(keep)


def compact_records(facts: DataFrame, graph: ShapeGraph) -> DataFrame:
    """One row per message, shape and focus of a target class: scalar slots hold a value, repeated ones a list."""
    spark = facts.sparkSession
    targets = small(spark, [(c, s.id) for s in graph.shapes for c in s.target_classes], ["o", "shape"])
    focus = facts.where(F.col("p") == TYPE).join(targets, "o").select("msg_id", "shape", F.col("s").alias("focus"))
    slots = small(spark, [(s.id, x.path.predicate, x.path.text, str(x.scalar)) for s in graph.shapes for x in s.properties if x.path.kind == "predicate"], ["shape", "p", "slot", "scalar"])
    met = focus.join(slots, "shape").join(facts.withColumnRenamed("s", "focus"), ["msg_id", "focus", "p"], "left")
    values = met.groupBy("msg_id", "shape", "focus", "slot", "scalar").agg(F.array_sort(F.collect_set("o")).alias("v"))
    values = values.withColumn("v", F.when(F.col("scalar") == "True", F.slice("v", 1, 1)).otherwise(F.col("v")))
    return values.groupBy("msg_id", "shape", "focus").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "v")))).alias("slots"))
