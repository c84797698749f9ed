"""The engine: compile a background and rule profiles once, then derive what follows from batches of messages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import emit, equality, literals, owl, quantities, shape_plan, skos
from quadloom.plans import sql
from quadloom.plans.compile import RuleFault, Variant, check, gives, inline_helpers, needed, specialise
from quadloom.plans.fixpoint import data_lists, fixpoint, small
from quadloom.plans.local import Index, Triple, closure
from quadloom.plans.rules import Atom, ListTerm, Rule, Var
from quadloom.plans.storage import stored
from quadloom.sources.rdf import lists_of, parse
from quadloom.terms import COLUMNS, STATEMENT
from quadloom.vocab import INC, LIST, OWL, REST, TYPE

PROFILES = ("owl2rl", "skos", "qudt")
#: Beyond so many different predicates and classes the data is taken to hold any.
MAX_NAMES = 10_000


class NotLoaded(RuntimeError):
    """infer() before load()."""


class Profile:
    """Rules of one's own: N3 text, and the facts that it brings."""

    def __init__(self, text: str, label: str = "custom", base: str = ""):
        doc = parse(text, base=base)
        self.label, self.text = label, text
        self.rules, self.remarks = inline_helpers(doc.forward, doc.backward)
        for r in self.rules:
            check(r)
        self.rules = [Rule(r.body, r.head, f"{label} {r.name}") for r in self.rules]
        self.facts = [q[:3] for q in doc.quads]


def as_triples(source) -> list[Triple]:
    """Text, triples, quads or a small DataFrame."""
    if source is None:
        return []
    if isinstance(source, str):
        return [q[:3] for q in parse(source).quads]
    if isinstance(source, DataFrame):
        return [(r.s, r.p, r.o) for r in source.select("s", "p", "o").collect()]
    if isinstance(source, dict):
        return as_triples(source["quads"] if "quads" in source else Path(source["path"]).read_text())
    out = [tuple(q[:3]) for q in source]
    if any(len(t) != 3 or not all(isinstance(x, str) for x in t) for t in out):
        raise TypeError("a vocabulary is text, a DataFrame or rows of three term keys")
    return out


class Engine:
    def __init__(self, spark: SparkSession, mode: str = "application", runtime: str | None = None, compiler: Callable[[dict], list[Variant]] | None = None):
        """runtime: folder of a saved one; compiler: replaces the compilation of rules to variants."""
        self.spark, self.mode, self.compiler = spark, mode, compiler
        self.loaded = False
        self.last_input: dict = {}
        if runtime:
            self.load_runtime(runtime)

    # --- load -------------------------------------------------------------------------------------------------------

    def load(self, vocabulary=None, profiles: Iterable[str | Profile] | None = None, shapes_in=None, shapes_out=None, select: bool = True) -> Engine:
        """vocabulary: the background; profiles: names of bundled ones or Profile objects (default: all bundled).

        select: drop rules that neither background nor data can reach. shapes_in, shapes_out: SHACL contracts that prune
        the input and project the output.
        """
        profiles = list(PROFILES if profiles is None else profiles)
        unknown = [p for p in profiles if isinstance(p, str) and p not in PROFILES]
        if unknown:
            raise ValueError(f"no bundled profile {unknown[0]!r}; there are {', '.join(PROFILES)}")
        self.profiles = profiles
        self.asserted = as_triples(vocabulary)
        custom = [p for p in profiles if isinstance(p, Profile)]
        rules = [r for p in custom for r in p.rules]
        facts = [*self.asserted, *(t for p in custom for t in p.facts)]
        if "skos" in profiles:
            rules += skos.rules()
            if "owl2rl" not in profiles:  # with it they would be schema that says the rules of this profile again
                facts += skos.axioms()
        if "owl2rl" in profiles:
            self.background = owl.schema_closure(facts, rules)
            made, errors, self.divisions = owl.list_rules(self.background)
            rules = [*owl.rules(), *made, *rules]
            self.contradictions = [*owl.contradictions(), *errors]
        else:
            self.background, _ = closure(facts, rules)
            self.contradictions, self.divisions = [], []
        self.rules = rules
        self.units = quantities.Units.from_background(self.background) if "qudt" in profiles else None
        self.shapes_in = shape_plan.compile_shapes(as_triples(shapes_in)) if shapes_in is not None else None
        self.shapes_out = shape_plan.compile_shapes(as_triples(shapes_out)) if shapes_out is not None else None
        self.select = select
        self.loaded = True
        return self

    def _need(self) -> None:
        if not self.loaded:
            raise NotLoaded("call load() first")

    @property
    def static_closure(self) -> list[Triple]:
        """What follows from the background alone, without what it asserts."""
        self._need()
        return sorted(self.background.all - set(self.asserted))

    def static_inconsistencies(self) -> list[tuple[str, tuple]]:
        from quadloom.plans.local import solve
        from quadloom.plans.rules import rename

        self._need()
        out = set()
        for rule, terms in self.contradictions:
            for b in solve(rule.body, self.background):
                out.add((rule.name, tuple(rename(t, b) for t in terms)))
        return sorted(out)

    def lists(self, facts: DataFrame | None = None, available=None) -> list[DataFrame]:
        """Lists of the background (head, item; a driver table, as the background is) and of the data (with msg_id)."""
        rows = [(h, x) for h, items in lists_of(self.background.all).items() for x in items]
        out = [small(self.spark, rows, ["head", "item"])] if rows else []
        uses = any(a.p == LIST.member for r in self.rules for a in r.body)
        if facts is not None and uses and (available is None or any(p == REST for p, _ in available)):
            out.append(data_lists(facts))
        return out

    def compile(self, available=None) -> list[Variant]:
        self._need()
        if self.compiler:
            return self.compiler({"rules": self.rules, "background": self.background, "available": available})
        return specialise(self.rules, self.background, available if self.select else None)

    def sql_program(self, facts: DataFrame | None = None) -> sql.Translation:
        """The rules that can run, as SQL over the background's closure as seeds; what has no translation is a warning.

        Rules that the background alone decides are dropped with `facts` given: only what their names can reach is kept.
        """
        self._need()
        reachable = None
        if facts is not None:
            reachable = {v.name for v in self.compile(self._available(facts))}
        program, notes = sql.Program(sorted(self.background.all)), []
        for r in self.rules:
            if reachable is not None and r.name not in reachable:
                continue
            try:
                program.rules.append(sql.rule_sql(r))
                program.names.append(r.name)
            except RuleFault as e:
                notes.append({"severity": "warning", "message": str(e)})
        return sql.Translation(program, notes)

    # --- infer ------------------------------------------------------------------------------------------------------

    def _available(self, facts: DataFrame) -> set | None:
        names = facts.select("p", F.when(F.col("p") == TYPE, F.col("o")).alias("c")).distinct().limit(MAX_NAMES + 1).collect()
        return None if len(names) > MAX_NAMES else {(r.p, r.c) for r in names}

    def _goals(self, available: set | None) -> list[tuple[Variant, tuple]]:
        """What contradicts, and the terms of the report."""
        # The terms ride in a head of their own, so that what the background binds in them is kept.
        wrapped = [Rule(rule.body, (Atom(TYPE, INC.rule, ListTerm(tuple(terms))),), rule.name) for rule, terms in self.contradictions]
        return [(v, v.head[0].o.items) for r in wrapped for v in specialise([r], self.background, available)]

    def _closure(self, facts: DataFrame, known_before: DataFrame | None = None, only_reports: bool = False, predicates: list[str] | None = None, **limits) -> tuple[DataFrame, DataFrame, set | None]:
        """(input, derived, available names) — derived holds internal statements too. only_reports: derived is what reports
        need; predicates: it is what statements of these need."""
        seen = facts if known_before is None else facts.unionByName(known_before)
        available = self._available(seen)
        variants = self.compile(available)
        members = [Atom(Var("x"), TYPE, m) for _, classes in self.divisions for m in classes]
        if predicates is not None:
            variants = needed(variants, [], [Atom(Var("x"), p, Var("y")) for p in predicates] + members)
        if only_reports:
            variants = needed(variants, self._goals(None if available is None else available.union({(TYPE, c) for c, _ in self.divisions}, *(gives(v) for v in variants))), members)
        put_off = known_before is None and limits.get("max_facts") is None and (OWL.sameAs, None) not in (available or {(OWL.sameAs, None)})
        variants, same = equality.taken_over(variants, put_off)
        lists = self.lists(seen, available)
        divisions = self.divisions

        def extra(delta: DataFrame, known: DataFrame) -> list[DataFrame]:
            return [divided(known, c, members, delta) for c, members in divisions] + (same(delta, known) if same else [])

        derived = fixpoint(facts, variants, lists, extra=extra if divisions or same else None, known_before=known_before, final=same.final if same else None, **limits)
        return facts, derived, available

    def infer(self, facts: DataFrame, mode: str | None = None, known_before: DataFrame | None = None, predicates: Iterable[str] | None = None, **limits) -> DataFrame:
        """New statements (msg_id, s, p, o) of each message: none that is asserted in it, none twice.

        predicates: all new statements of these predicates, and no others; only what they need is derived.
        """
        mode = mode or self.mode
        if predicates is None:
            return self._infer(facts, mode, known_before, False, **limits)[0]
        predicates = sorted(set(predicates))
        # What the other operators make is made of all statements.
        only = predicates if self.units is None and self.shapes_out is None and mode == "application" else None
        return self._infer(facts, mode, known_before, False, predicates=only, **limits)[0].where(F.col("p").isin(predicates))

    def infer_with_diagnostics(self, facts: DataFrame, mode: str | None = None, known_before: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame]:
        """(statements, reports): the statements include those of the reports, which no projection drops."""
        return self._infer(facts, mode or self.mode, known_before, True, **limits)

    def inconsistencies(self, facts: DataFrame, mode: str | None = None, known_before: DataFrame | None = None, **limits) -> DataFrame:
        """The reports of infer_with_diagnostics without its statements: only what reports need is derived."""
        mode = mode or self.mode
        only = self.units is None and mode == "application"  # what the other operators make is made of all statements
        return self._infer(facts, mode, known_before, True, only_reports=only, **limits)[1]

    def _infer(self, facts: DataFrame, mode: str, known_before: DataFrame | None, diagnostics: bool, **limits) -> tuple[DataFrame, DataFrame | None]:
        self._need()
        facts = facts.select(*COLUMNS)
        if self.shapes_in is not None:
            facts, self.last_input = shape_plan.prune_input(facts, self.shapes_in)
        given, derived, available = self._closure(facts, known_before, **limits)
        every = given.unionByName(derived)
        if known_before is not None:
            every = every.unionByName(known_before.select(*COLUMNS))
        added = []  # what the fixpoint gives is there once; these may give the same
        if self.units is not None and quantities.present(every, available):
            made = quantities.normalise(every, self.units)
            if made is not None:
                added.append(made.join(every, COLUMNS, "left_anti"))
        if mode == "conformance" and "owl2rl" in self.profiles:
            made = literals.typings(every).unionByName(literals.equalities(every)).unionByName(literals.differences(every))
            added.append(made.join(every, COLUMNS, "left_anti"))
        if added:
            derived = derived.unionByName(emit.unique(reduce(DataFrame.unionByName, added)))
        out = emit.emitted(derived, mode)
        if self.shapes_out is not None:
            out = shape_plan.project_output(out, self.shapes_out)
        found = None
        if diagnostics and self.contradictions:
            known = self._after(available, derived)
            found = stored(emit.reports(every, self._goals(known), self.lists(), mode), "reports")
            out = out.unionByName(emit.report_statements(found))
        elif diagnostics:
            found = self.spark.createDataFrame([], emit.REPORT)
        return out, found

    def _after(self, available, derived: DataFrame):
        more = self._available(derived)
        return None if available is None or more is None else available | more

    # --- runtimes ---------------------------------------------------------------------------------------------------

    def save_runtime(self, folder: str) -> None:
        """Background closure as Parquet, profiles and shapes as JSON beside it."""
        self._need()
        self.spark.createDataFrame(sorted(self.background.all), "s string, p string, o string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/background")
        meta = {"version": 1, "profiles": [p if isinstance(p, str) else {"label": p.label, "text": p.text} for p in self.profiles], "mode": self.mode, "select": self.select, "asserted": self.asserted,
                "shapes_in": self.shapes_in and self.shapes_in.to_json(), "shapes_out": self.shapes_out and self.shapes_out.to_json()}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/runtime")

    def load_runtime(self, folder: str) -> Engine:
        meta = json.loads("".join(r.value for r in self.spark.read.text(f"{folder}/runtime").collect()))
        if meta.get("version") != 1:
            raise ValueError(f"runtime version {meta.get('version')!r} is not supported")
        self.mode = meta["mode"]
        self.load([tuple(t) for t in meta["asserted"]], [p if isinstance(p, str) else Profile(p["text"], p["label"]) for p in meta["profiles"]], select=meta["select"])
        rows = self.spark.read.parquet(f"{folder}/background").collect()
        self.background = Index((r.s, r.p, r.o) for r in rows)
        self.shapes_in = shape_plan.ShapeGraph.from_json(meta["shapes_in"]) if meta["shapes_in"] else None
        self.shapes_out = shape_plan.ShapeGraph.from_json(meta["shapes_out"]) if meta["shapes_out"] else None
        return self


def divided(known: DataFrame, cls: str, members: list[str], delta: DataFrame | None = None) -> DataFrame:
    """Individuals typed by every one of many classes: relational division in one aggregation. delta: only those it types."""
    of_class = lambda df: df.where((F.col("p") == TYPE) & F.col("o").isin(members))
    typed = of_class(known)
    if delta is not None and delta is not known:
        typed = typed.join(of_class(delta).select("msg_id", "s").distinct(), ["msg_id", "s"], "left_semi")
    met = typed.groupBy("msg_id", "s").agg(F.count_distinct("o").alias("n"))
    return met.where(F.col("n") == len(set(members))).select("msg_id", "s", F.lit(TYPE).alias("p"), F.lit(cls).alias("o"))


def statements(spark: SparkSession, source, msg_id: int = 0) -> DataFrame:
    """Small inputs as a statement DataFrame: text (a message log gives a message id for each) or triples."""
    if isinstance(source, str):
        doc = parse(source)
        rows = [(m, *q[:3]) for m, quads in enumerate(doc.messages) for q in quads] if doc.messages is not None else [(msg_id, *q[:3]) for q in doc.quads]
    else:
        rows = [(msg_id, *t) for t in source]
    return spark.createDataFrame(sorted(set(rows)), STATEMENT)


__all__ = ["Engine", "NotLoaded", "Profile", "as_triples", "statements"]
