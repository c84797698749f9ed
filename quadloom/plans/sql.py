"""Rules as SQL: each rule becomes one SELECT over the view of facts; a controller runs them to their least model.

For programs that have to be read, stored or moved as text. `quadloom.plans.fixpoint` runs the same rules faster.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quadloom.functions.datatypes import INTEGERS, NUMERIC_KEYS, PATTERNS
from quadloom.plans.compile import RuleFault, check, inline_helpers
from quadloom.plans.local import schedule
from quadloom.plans.rules import Atom, Formula, ListTerm, Rule, Var, variables
from quadloom.plans.storage import stored
from quadloom.sources.rdf import SyntaxFault, parse
from quadloom.terms import COLUMNS, STATEMENT
from quadloom.vocab import DT, GENID, LIST, LOG, MATH, STRING, XSD

MAX_QUERY_CHARS = 80_000
_INTEGER_KEYS = sorted(XSD[n] for n in INTEGERS)


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lexical(x: str) -> str:
    return f"CASE WHEN startswith({x}, '\"') THEN substring({x}, 2, length({x}) - locate('\"', reverse({x})) - 1) END"


def datatype(x: str) -> str:
    return f"CASE WHEN startswith({x}, '\"') AND endswith({x}, '>') THEN substring({x}, length({x}) - locate('\"', reverse({x})) + 4) WHEN startswith({x}, '\"') THEN '<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>' END"


def text(x: str) -> str:
    return f"CASE WHEN startswith({x}, '<') THEN substring({x}, 2, length({x}) - 2) ELSE {lexical(x)} END"


def _one_of(x: str, keys: list[str]) -> str:
    return f"{x} IN ({', '.join(map(quote, keys))})"


def numeric(x: str) -> str:
    return f"CASE WHEN {_one_of(f'({datatype(x)})', NUMERIC_KEYS)} AND ({lexical(x)}) RLIKE {quote('^(?:' + PATTERNS['double'] + ')$')} THEN try_cast(({lexical(x)}) AS DOUBLE) END"


def _result(value: str, inputs: list[str]) -> str:
    whole = " AND ".join(_one_of(f"({datatype(x)})", _INTEGER_KEYS) for x in inputs)
    floating = " OR ".join(_one_of(f"({datatype(x)})", [XSD.double, XSD.float]) for x in inputs)
    return f"CASE WHEN ({whole}) AND ({value}) = floor({value}) THEN concat('\"', CAST(CAST(({value}) AS DECIMAL(38,0)) AS STRING), '\"^^{XSD.integer}') WHEN ({value}) IS NOT NULL THEN concat('\"', CAST(({value}) AS STRING), '\"^^', CASE WHEN {floating} THEN {quote(XSD.double)} ELSE {quote(XSD.decimal)} END) END"


def _string(value: str) -> str:
    return f"concat('\"', {value}, '\"^^{XSD.string}')"


_FOLD = {MATH.sum: " + ", MATH.product: " * "}
_ONE = {MATH.negation: "-({0})", MATH.absoluteValue: "abs({0})", MATH.floor: "CAST(floor({0}) AS DOUBLE)", MATH.ceiling: "CAST(ceil({0}) AS DOUBLE)"}
_TWO = {MATH.difference: "({0}) - ({1})", MATH.quotient: "try_divide({0}, {1})"}
_COMPARE = {MATH.greaterThan: ">", MATH.lessThan: "<", MATH.notGreaterThan: "<=", MATH.notLessThan: ">=", MATH.equalTo: "=", MATH.notEqualTo: "<>"}
_TEXT = {STRING.contains: "contains({0}, {1})", STRING.startsWith: "startswith({0}, {1})", STRING.endsWith: "endswith({0}, {1})", STRING.matches: "({0}) RLIKE ({1})", STRING.notMatches: "NOT (({0}) RLIKE ({1}))"}


def _function(p: str, args: list[str]) -> str:
    """SQL of a builtin that gives a value."""
    if p in _FOLD:
        return _result(_FOLD[p].join(f"({numeric(a)})" for a in args), args)
    if p in _ONE:
        return _result(_ONE[p].format(numeric(args[0])), args)
    if p in _TWO:
        return _result(_TWO[p].format(*map(numeric, args)), args)
    if p == MATH.rounded:
        return f"concat('\"', CAST(CAST(floor(({numeric(args[0])}) + 0.5D) AS DECIMAL(38,0)) AS STRING), '\"^^{XSD.integer}')"
    if p == LOG.dtlit:
        return f"CASE WHEN ({datatype(args[0])}) = {quote(XSD.string)} AND startswith({args[1]}, '<') THEN concat('\"', {lexical(args[0])}, '\"^^', {args[1]}) END"
    if p == LOG.skolem:
        blank = " OR ".join(f"startswith({a}, '_:')" for a in args)
        parts = ", ".join(f"CAST(length({a}) AS STRING), ':', {a}" for a in args)
        return f"CASE WHEN {blank} THEN raise_error('blank-node arguments of skolem') ELSE concat('<{GENID}', sha2(concat({parts}), 256), '>') END"
    if p == STRING.concatenation:
        return _string(f"concat({', '.join(map(text, args))})")
    if p == STRING.scrape:
        return f"CASE WHEN ({text(args[0])}) RLIKE ({text(args[1])}) THEN {_string(f'regexp_extract({text(args[0])}, {text(args[1])}, 1)')} END"
    if p == STRING.length:
        return f"concat('\"', CAST(length({text(args[0])}) AS STRING), '\"^^{XSD.integer}')"
    if p == DT.datatype:
        return datatype(args[0])
    if p == DT.lexicalForm:
        return _string(lexical(args[0]))
    raise RuleFault(f"builtin {p} has no translation")


@dataclass
class Program:
    seeds: list[tuple[str, str, str]] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    checks: list[str | None] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(data: str) -> Program:
        return Program(**json.loads(data))


@dataclass
class Translation:
    program: Program | None
    diagnostics: list[dict]


class _Body:
    def __init__(self) -> None:
        self.tables: list[str] = []
        self.where: list[str] = []
        self.laterals: list[str] = []
        self.bound: dict[str, str] = {}
        self.computed: set[str] = set()

    def value(self, term) -> str | None:
        if isinstance(term, str):
            return quote(term)
        return self.bound.get(term.name) if isinstance(term, Var) else None

    def pattern(self, atom: Atom) -> None:
        t = f"t{len(self.tables)}"
        self.tables.append(t)
        if len(self.tables) > 1:
            self.where.append(f"{t}.msg_id = t0.msg_id")
        self.match(t, atom)

    def match(self, t: str, atom: Atom) -> None:
        for c, term in zip("spo", atom.terms, strict=True):
            known = self.value(term)
            if known is not None:
                self.where.append(f"{t}.{c} = {known}")
            elif isinstance(term, Var):
                self.bound[term.name] = f"{t}.{c}"
            else:
                raise RuleFault(f"{term!r} in a pattern")

    def builtin(self, atom: Atom) -> None:
        p = atom.p
        if p == LOG.memoize:
            return
        if p in (LOG.includes, LOG.notIncludes):
            inner = _Body()
            inner.bound = dict(self.bound)
            tables = []
            for i, a in enumerate(atom.o.atoms if isinstance(atom.o, Formula) else ()):
                t = f"n{len(self.where)}_{i}"
                tables.append(f"facts {t}")
                inner.where.append(f"{t}.msg_id = t0.msg_id")
                inner.match(t, a)
            self.where.append(f"{'NOT ' if p == LOG.notIncludes else ''}EXISTS (SELECT 1 FROM {', '.join(tables)} WHERE {' AND '.join(inner.where)})")
            return
        if p == LOG.equalTo:
            a, b = (atom.o, atom.s) if self.value(atom.s) is None else (atom.s, atom.o)
            if self.value(b) is None:
                self.bound[b.name] = self.value(a)
            else:
                self.where.append(f"{self.value(a)} = {self.value(b)}")
            return
        if p == LIST.member:
            raise RuleFault("list:member over data lists has no translation; unfold the list in the background")
        inputs = list(atom.s.items) if isinstance(atom.s, ListTerm) else [atom.s]
        test = p in _COMPARE or p in _TEXT or p == LOG.notEqualTo
        inputs += [atom.o] if test else []
        args = [self.value(x) for x in inputs]
        bind = lambda made: made
        if self.computed & variables(atom):
            # Computed values are bound to names, else filters that are pushed down would repeat them over and over.
            given, args = args, [f"v.a{i}" for i in range(len(args))]
            bind = lambda made: f"transform(array(struct({', '.join(f'{a} AS a{i}' for i, a in enumerate(given))})), v -> {made})[0]"
        if p in _COMPARE:
            self.where.append(bind(f"({numeric(args[0])}) {_COMPARE[p]} ({numeric(args[1])})"))
        elif p in _TEXT:
            self.where.append(bind(_TEXT[p].format(text(args[0]), text(args[1]))))
        elif p == LOG.notEqualTo:
            self.where.append(f"{self.value(inputs[0])} <> {self.value(inputs[1])}")
        else:
            made = bind(f"({_function(p, args)})")
            known = self.value(atom.o)
            if known is not None:
                self.where.append(f"{made} = {known}")
                return
            # A value of its own: later expressions name it instead of repeating it.
            name = f"b{len(self.laterals)}"
            self.laterals.append(f"LATERAL (SELECT {made} AS v) {name}")
            self.bound[atom.o.name] = f"{name}.v"
            self.computed |= variables(atom.o)
            self.where.append(f"{name}.v IS NOT NULL")


def rule_sql(rule: Rule) -> str:
    """SELECT msg_id, s, p, o of a rule's head; `facts` is the view of statements."""
    body = _Body()
    from quadloom.functions.builtins import is_builtin

    for atom in schedule(rule.body, set()):
        if is_builtin(atom.p):
            body.builtin(atom)
        else:
            body.pattern(atom)
    if not body.tables:
        raise RuleFault(f"{rule.name}: a rule needs a pattern over facts")
    heads = ", ".join(f"named_struct('s', {body.value(a.s)}, 'p', {body.value(a.p)}, 'o', {body.value(a.o)})" for a in rule.head)
    where = f" WHERE {' AND '.join(body.where)}" if body.where else ""
    tables = ", ".join([*(f"facts {t}" for t in body.tables), *body.laterals])
    out = f"SELECT DISTINCT msg_id, t.s, t.p, t.o FROM (SELECT t0.msg_id, explode(array({heads})) AS t FROM {tables}{where})"
    if len(out) > MAX_QUERY_CHARS:
        raise RuleFault(f"{rule.name}: the query has more than {MAX_QUERY_CHARS} characters")
    return out


def translate(source: str, base: str = "") -> Translation:
    """N3 text to a program. With any error the program is None; what is unused is a warning."""
    notes: list[dict] = []
    try:
        doc = parse(source, base=base)
        if any(q[3] for q in doc.quads):
            raise RuleFault("named graphs have no translation")
        rules, remarks = inline_helpers(doc.forward, doc.backward)
        notes += [{"severity": "warning", "message": r} for r in remarks]
        program = Program(sorted({q[:3] for q in doc.quads if q[1] != LOG.memoize}))
        for r in rules:
            check(r)
            program.rules.append(rule_sql(r))
            program.names.append(r.name)
        return Translation(program, notes)
    except (RuleFault, SyntaxFault, ValueError) as e:
        return Translation(None, [*notes, {"severity": "error", "message": str(e)}])


def execute(spark: SparkSession, program: Program, facts: DataFrame, max_rounds: int = 100, max_facts: int = 100_000) -> dict:
    """closure, derived and rounds. Limits are errors, never partial results; seeds belong to every message, not to the output."""
    known = facts.select(*COLUMNS)
    if program.seeds:
        seeds = spark.createDataFrame(program.seeds, "s string, p string, o string")
        known = known.unionByName(known.select("msg_id").distinct().crossJoin(seeds).select(*COLUMNS))
    known = stored(known.distinct(), "sql-facts")
    derived: list[DataFrame] = []
    rounds = 0
    while True:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"did not converge in {max_rounds} rounds")
        known.createOrReplaceTempView("facts")
        made = [spark.sql(q) for q in program.rules]
        if not made:
            break
        new = stored(reduce(DataFrame.unionByName, made).distinct().join(known, COLUMNS, "left_anti"), "sql-new")
        if new.isEmpty():
            break
        derived.append(new)
        known = known.unionByName(new)
        if known.count() > max_facts:
            raise RuntimeError(f"closure exceeded {max_facts} facts")
    out = reduce(DataFrame.unionByName, derived) if derived else spark.createDataFrame([], STATEMENT)
    return {"closure": known, "derived": out, "rounds": rounds}
