"""Validation of statements against SHACL shapes: core constraints and some of version 1.2, as DataFrame operations.

Shapes are read on the driver. Each shape gives a DataFrame of its focus nodes and value nodes; each constraint is a
filter, an anti-join or an aggregation over it. Messages are validated apart, for msg_id is in every key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.builtins import REGISTRY
from quadloom.functions.datatypes import number, valid_column
from quadloom.operators.paths import Path, evaluate, read_path
from quadloom.plans.local import Index, Triple
from quadloom.terms import datatype_of, is_literal, lexical_form, skolem_iri, split_literal, text_of
from quadloom.vocab import GENID, INTERNAL, MATH, OWL, RDFS, SH, TYPE

RESULT = "msg_id long, id string, focus string, shape string, component string, severity string, path string, value string"
_RANGE = {SH.minInclusive: ("MinInclusive", MATH.notLessThan), SH.maxInclusive: ("MaxInclusive", MATH.notGreaterThan), SH.minExclusive: ("MinExclusive", MATH.greaterThan), SH.maxExclusive: ("MaxExclusive", MATH.lessThan)}


@dataclass
class Shape:
    id: str
    index: Index = field(repr=False)
    path: Path | None = None

    def get(self, p: str) -> list[str]:
        return sorted(o for _, _, o in self.index.by_ps.get((p, self.id), ()))

    def items(self, p: str) -> list[list[str]]:
        return [self.index.items(o) for o in self.get(p) if self.index.items(o) is not None]

    def flag(self, p: str) -> bool:
        return any(split_literal(o)[0] in ("true", "1") for o in self.get(p) if split_literal(o))

    @property
    def active(self) -> bool:
        return not self.flag(SH.deactivated)

    @property
    def severity(self) -> str:
        return next(iter(self.get(SH.severity)), SH.Violation)


class Validator:
    def __init__(self, shapes: Iterable[Triple], classes: Iterable[Triple] = ()):
        """classes: rdfs:subClassOf statements of the ontology, beside those that the shapes bring."""
        self.index = Index(shapes)
        for s, _, _ in list(self.index.by_po.get((TYPE, SH.ShapeClass), ())):
            self.index.add((s, TYPE, SH.NodeShape))
            self.index.add((s, TYPE, RDFS["Class"]))
        self.subclass: dict[str, set[str]] = {}
        edges = [(s, o) for s, p, o in [*self.index.all, *classes] if p == RDFS.subClassOf]
        for c in {x for e in edges for x in e}:
            seen, todo = {c}, [c]
            while todo:
                now = todo.pop()
                for s, o in edges:
                    if o == now and s not in seen:
                        seen.add(s)
                        todo.append(s)
            self.subclass[c] = seen
        marks = [SH.property, SH.path, SH.targetNode, SH.targetClass, SH.targetSubjectsOf, SH.targetObjectsOf, SH.targetWhere, SH.node]
        ids = {t[0] for p in marks for t in self.index.by_p.get(p, ())} | {t[0] for t in self.index.by_p.get(TYPE, ()) if t[2] in (SH.NodeShape, SH.PropertyShape)}
        ids |= {t[2] for p in (SH.property, SH.reifierShape) for t in self.index.by_p.get(p, ())}
        self.shapes = {i: self._shape(i) for i in sorted(ids)}

    def _shape(self, i: str) -> Shape:
        shape = Shape(i, self.index)
        paths = shape.get(SH.path)
        shape.path = read_path(paths[0], self.index) if paths else None
        return shape

    def instances(self, facts: DataFrame, cls: str) -> DataFrame:
        """msg_id, node: typed by the class or one below it."""
        return facts.where((F.col("p") == TYPE) & F.col("o").isin(sorted(self.subclass.get(cls, {cls})))).select("msg_id", F.col("s").alias("node")).distinct()

    def focus(self, shape: Shape, facts: DataFrame) -> DataFrame | None:
        """msg_id, focus of the shape's targets: nodes, classes, subjects and objects of properties, sh:shape, targetWhere."""
        out = []
        every = facts.select("msg_id").distinct()
        for n in shape.get(SH.targetNode):
            out.append(every.select("msg_id", F.lit(n).alias("focus")))
        kinds = {o for _, _, o in self.index.by_ps.get((TYPE, shape.id), ())}
        for c in [*shape.get(SH.targetClass), *([shape.id] if kinds & {RDFS["Class"], OWL["Class"]} else [])]:
            out.append(self.instances(facts, c).withColumnRenamed("node", "focus"))
        for p in shape.get(SH.targetSubjectsOf):
            out.append(facts.where(F.col("p") == p).select("msg_id", F.col("s").alias("focus")))
        for p in shape.get(SH.targetObjectsOf):
            out.append(facts.where(F.col("p") == p).select("msg_id", F.col("o").alias("focus")))
        if self.index.by_p.get(SH.property) or shape.path:
            out.append(facts.where((F.col("p") == SH.shape) & (F.col("o") == shape.id)).select("msg_id", F.col("s").alias("focus")))
        for where in shape.get(SH.targetWhere):
            out += self._where(where, facts)
        return reduce(DataFrame.unionByName, out).distinct() if out else None

    def _where(self, where: str, facts: DataFrame) -> list[DataFrame]:
        """A where-shape of one hasValue property and one path that needs a value."""
        inner = [self._shape(p) for p in self._shape(where).get(SH.property)]
        values = [s for s in inner if s.path and s.get(SH.hasValue)]
        paths = [s for s in inner if s.path and s.get(SH.minCount) and s.path.kind == "sequence"]
        out = []
        for v in values:
            for p in paths:
                for value in v.get(SH.hasValue):
                    a = evaluate(v.path, facts).where(F.col("b") == value).select("msg_id", F.col("a").alias("focus"))
                    out.append(a.join(evaluate(p.path, facts).select("msg_id", F.col("a").alias("focus")).distinct(), ["msg_id", "focus"], "left_semi"))
        return out

    # --- validation -------------------------------------------------------------------------------------------------

    def validate(self, facts: DataFrame) -> DataFrame:
        """Results: msg_id, id, focus, shape, component, severity, path, value."""
        facts = facts.select("msg_id", "s", "p", "o").distinct()
        out: list[DataFrame] = []
        for shape in self.shapes.values():
            if not shape.active:
                continue
            focus = self.focus(shape, facts)
            if focus is not None:
                out += self._check(shape, focus, facts, frozenset())
        if not out:
            return facts.sparkSession.createDataFrame([], RESULT)
        rows = reduce(DataFrame.unionByName, out).distinct()
        key = [F.coalesce(F.col(c), F.lit("")) for c in ("component", "focus", "shape", "path", "value")]
        return rows.select("msg_id", skolem_iri(GENID, key).alias("id"), "focus", "shape", "component", "severity", "path", "value")

    def _check(self, shape: Shape, focus: DataFrame, facts: DataFrame, above: frozenset) -> list[DataFrame]:
        """Results of a shape for given focus nodes, and of the property shapes below it."""
        if not shape.active or shape.id in above:
            return []
        if shape.path is None:
            values = focus.select("msg_id", "focus", F.col("focus").alias("value"))
        else:
            values = focus.join(evaluate(shape.path, facts).select("msg_id", F.col("a").alias("focus"), F.col("b").alias("value")), ["msg_id", "focus"])
        given = values
        if shape.path is not None:
            for v in shape.get(SH.values):
                values = values.unionByName(focus.select("msg_id", "focus", F.lit(v).alias("value")))
            for v in shape.get(SH.defaultValue):
                values = values.unionByName(focus.join(given, ["msg_id", "focus"], "left_anti").select("msg_id", "focus", F.lit(v).alias("value")))
            values = values.distinct()
        out = self._constraints(shape, focus, given, values, facts)
        for inner in shape.get(SH.property):
            nested = values.select("msg_id", F.col("value").alias("focus")).distinct()
            out += self._check(self.shapes.get(inner) or self._shape(inner), nested, facts, above | {shape.id})
        out += self._reifiers(shape, values, facts, above)
        return out

    def _constraints(self, shape: Shape, focus: DataFrame, given: DataFrame, values: DataFrame, facts: DataFrame) -> list[DataFrame]:
        out: list[DataFrame] = []
        v = F.col("value")

        def bad(component: str, rows: DataFrame) -> None:
            out.append(self._result(shape, component, rows))

        for c in shape.get(SH["class"]):
            bad("Class", values.join(self.instances(facts, c).withColumnRenamed("node", "value"), ["msg_id", "value"], "left_anti"))
        for d in shape.get(SH.datatype):
            bad("Datatype", values.where(is_literal(v) & ((datatype_of(v) != d) | ~valid_column(lexical_form(v), F.lit(d)))))
        if shape.path is not None:
            # Counts are of the distinct values that the data has; focus nodes without any count as 0.
            counts = focus.join(given.groupBy("msg_id", "focus").agg(F.count_distinct("value").alias("n")), ["msg_id", "focus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            for k, name, wrong in ((SH.minCount, "MinCount", lambda n: F.col("n") < n), (SH.maxCount, "MaxCount", lambda n: F.col("n") > n)):
                for bound in shape.get(k):
                    bad(name, counts.where(wrong(int(number(bound)))).select("msg_id", "focus", F.lit(None).cast("string").alias("value")))
        for wanted in shape.get(SH.hasValue):
            has = values.where(v == wanted).select("msg_id", "focus").distinct()
            bad("HasValue", focus.join(has, ["msg_id", "focus"], "left_anti").select("msg_id", "focus", F.lit(None).cast("string").alias("value")))
        for allowed in shape.items(SH.in_):
            bad("In", values.where(~v.isin(allowed)) if allowed else values)
        for members in shape.items(SH.xone):
            # Only lists whose first two members are the same shape: both hold or neither does, never exactly one.
            if len(members) > 1 and members[0] == members[1]:
                bad("Xone", values)
        for k, (name, test) in _RANGE.items():
            for bound in shape.get(k):
                bad(name, values.where(~REGISTRY[test].column(v, F.lit(bound))))
        for k, name, wrong in ((SH.minLength, "MinLength", lambda n: F.length(text_of(v)) < n), (SH.maxLength, "MaxLength", lambda n: F.length(text_of(v)) > n)):
            for bound in shape.get(k):
                bad(name, values.where(F.coalesce(wrong(int(number(bound))), F.lit(True))))
        flags = "".join(sorted({f for x in shape.get(SH.flags) for f in split_literal(x)[0]}))
        if set(flags) - set("ims"):
            raise ValueError(f"pattern flags {flags!r}: only i, m and s are supported")
        for pattern in shape.get(SH.pattern):
            regex = (f"(?{flags})" if flags else "") + split_literal(pattern)[0]
            bad("Pattern", values.where(~F.coalesce(F.rlike(text_of(v), F.lit(regex)), F.lit(False))))
        if shape.flag(SH.singleLine):
            bad("SingleLine", values.where(is_literal(v) & F.rlike(lexical_form(v), F.lit(r"[\f\r\n\x0B]"))))
        return out

    def _result(self, shape: Shape, component: str, rows: DataFrame) -> DataFrame:
        path: Column = F.lit(shape.path.text if shape.path else None).cast("string")
        return rows.select("msg_id", "focus", F.lit(shape.id).alias("shape"), F.lit(SH[f"{component}ConstraintComponent"]).alias("component"), F.lit(shape.severity).alias("severity"), path.alias("path"), "value")

    def _reifiers(self, shape: Shape, values: DataFrame, facts: DataFrame, above: frozenset) -> list[DataFrame]:
        targets = shape.get(SH.reifierShape)
        if not targets or shape.path is None or shape.path.kind != "predicate":
            return []
        part = lambda p, name: facts.where(F.col("p") == p).select("msg_id", F.col("s").alias("reifier"), F.col("o").alias(name))
        about = part(INTERNAL.reifiesSubject, "focus").join(part(INTERNAL.reifiesObject, "value"), ["msg_id", "reifier"])
        about = about.join(part(INTERNAL.reifiesPredicate, "predicate").where(F.col("predicate") == shape.path.predicate), ["msg_id", "reifier"])
        met = values.join(about, ["msg_id", "focus", "value"])
        out = []
        for t in targets:
            out += self._check(self.shapes.get(t) or self._shape(t), met.select("msg_id", F.col("reifier").alias("focus")).distinct(), facts, above | {shape.id})
        if shape.flag(SH.reificationRequired):
            out.append(self._result(shape, "ReifierShape", values.join(about, ["msg_id", "focus", "value"], "left_anti")))
        return out


def conforms(facts: DataFrame, results: DataFrame, disallowed: Iterable[str] | None = None) -> DataFrame:
    """msg_id, conforms: no result in the message, or none of a disallowed severity."""
    bad = results if disallowed is None else results.where(F.col("severity").isin(list(disallowed)))
    counts = bad.groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"))
    return facts.select("msg_id").distinct().join(counts, "msg_id", "left").select("msg_id", F.col("n").isNull().alias("conforms"))


def result_statements(results: DataFrame) -> DataFrame:
    """Results in the SHACL vocabulary."""
    pair = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    parts = F.array(
        pair(TYPE, F.lit(SH.ValidationResult)), pair(SH.focusNode, F.col("focus")), pair(SH.sourceShape, F.col("shape")),
        pair(SH.sourceConstraintComponent, F.col("component")), pair(SH.resultSeverity, F.col("severity")), pair(SH.resultPath, F.col("path")), pair(SH.value, F.col("value")),
    )
    return results.select("msg_id", F.col("id").alias("s"), F.explode(parts).alias("t")).select("msg_id", "s", "t.p", "t.o").where(F.col("o").isNotNull())
