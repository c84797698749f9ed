"""Runs compiled rules over a statement DataFrame to their least model, semi-naively.

Each round joins the facts that were new in the last one (delta) with all that is known, drops what is known and writes
the rest to the shared folder: the written table is the next delta, so lineage and plans don't grow with the rounds, and
a lost executor costs one task. Message ids are part of every join, so messages never mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.builtins import REGISTRY
from quadloom.plans.compile import RuleFault, Variant
from quadloom.plans.rules import Atom, Formula, ListTerm, Var, rename, variables
from quadloom.plans.storage import stored
from quadloom.terms import COLUMNS, is_iri, is_literal, let
from quadloom.vocab import FIRST, LIST, LOG, NIL, REST

MAX_BROADCAST_ROWS = 100_000


def small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table made on the driver; broadcast, for its rows are counted: compile refuses backgrounds beyond the bound."""
    table = pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})
    df = spark.createDataFrame(table)  # from Arrow: a local relation, without a Python worker
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def _col(term, row: dict[str, Column] | None = None) -> Column:
    if isinstance(term, Var):
        return F.col(f"v_{term.name}")
    if isinstance(term, str):
        return F.lit(term)
    raise RuleFault(f"{term!r} has no column")


def data_lists(facts: DataFrame) -> DataFrame:
    """msg_id, head, item of the lists in the data. Lists that don't end in rdf:nil (cyclic or broken) have no items."""
    from quadloom.operators.paths import transitive_closure

    rest = facts.where((F.col("p") == REST)).select("msg_id", F.col("s").alias("a"), F.col("o").alias("b"))
    reach = stored(transitive_closure(rest), "lists")
    whole = reach.where(F.col("b") == NIL).select("msg_id", F.col("a").alias("head"))
    cells = reach.select("msg_id", F.col("a").alias("head"), F.col("b").alias("cell")).unionByName(whole.withColumn("cell", F.col("head")))
    first = facts.where(F.col("p") == FIRST).select("msg_id", F.col("s").alias("cell"), F.col("o").alias("item"))
    return stored(cells.join(whole, ["msg_id", "head"], "left_semi").join(first, ["msg_id", "cell"]).select("msg_id", "head", "item").distinct(), "lists")


def scan(facts: DataFrame, atom: Atom, keep: list[str] | None = None) -> DataFrame:
    """Statements that match the pattern: msg_id and a column for each variable. Constants become pushed filters."""
    conditions, columns = [], {}
    for c, term in zip("spo", atom.terms, strict=True):
        if isinstance(term, str):
            conditions.append(F.col(c) == term)
        elif isinstance(term, Var):
            if term.name in columns:
                conditions.append(F.col(c) == columns[term.name])
            else:
                columns[term.name] = F.col(c)
        else:
            raise RuleFault(f"{term!r} in a pattern over data; lists are matched in the background only")
    if conditions:
        facts = facts.where(reduce(lambda a, b: a & b, conditions))
    return facts.select("msg_id", *(c for c in keep or [] if c in facts.columns), *(c.alias(f"v_{n}") for n, c in columns.items()))


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def _builtin(df: DataFrame, atom: Atom, facts: DataFrame, lists: list[DataFrame] | None, computed: set[str]) -> DataFrame:
    """computed: variables that builtins made so far; what is computed from them is computed once."""
    has = lambda t: isinstance(t, str) or isinstance(t, Var) and f"v_{t.name}" in df.columns
    if atom.p in (LOG.includes, LOG.notIncludes):
        if not isinstance(atom.o, Formula):
            raise RuleFault(f"{atom!r}: a formula is expected")
        found = None
        for a in atom.o.atoms:
            found = _join(found, scan(facts, a))
        shared = [c for c in found.columns if c in df.columns]
        return df.join(found.select(*shared).distinct(), shared, "left_semi" if atom.p == LOG.includes else "left_anti")
    if atom.p == LOG.equalTo:
        a, b = (atom.o, atom.s) if not has(atom.s) else (atom.s, atom.o)
        return df.where(_col(a) == _col(b)) if has(b) else df.withColumn(f"v_{b.name}", _col(a))
    if atom.p == LIST.member:
        if isinstance(atom.s, ListTerm):
            met = df.withColumn("_item", F.explode(F.array(*map(_col, atom.s.items))))
        else:
            own = [t.withColumnRenamed("head", "_head").withColumnRenamed("item", "_item") for t in lists or ()]
            parts = [df.join(t, (_col(atom.s) == F.col("_head")), "inner") if "msg_id" not in t.columns else df.join(t.withColumnRenamed("msg_id", "_msg"), (_col(atom.s) == F.col("_head")) & (F.col("msg_id") == F.col("_msg"))).drop("_msg") for t in own]
            met = reduce(DataFrame.unionByName, parts) if parts else df.where("false").withColumn("_head", F.lit(None).cast("string")).withColumn("_item", F.lit(None).cast("string"))
            met = met.drop("_head")
        return (met.where(F.col("_item") == _col(atom.o)) if has(atom.o) else met.withColumn(f"v_{atom.o.name}", F.col("_item"))).drop("_item")
    known = REGISTRY[atom.p]
    args = [_col(x) for x in atom.s.items] if isinstance(atom.s, ListTerm) else [_col(atom.s)]
    if known.kind == "test":
        args.append(_col(atom.o))
    made = computed & variables(atom)
    value = let(args, known.column) if made else known.column(*args)
    if known.kind == "test":
        return df.where(value)
    computed |= variables(atom.o)
    if has(atom.o):
        return df.where(value == _col(atom.o))
    return df.withColumn(f"v_{atom.o.name}", value).where(F.col(f"v_{atom.o.name}").isNotNull())


def solutions(v: Variant, sources: list[DataFrame], facts: DataFrame, lists: list[DataFrame] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Solutions of a variant whose i-th data pattern reads sources[i]; negation reads facts. keep: more columns of sources."""
    spark = facts.sparkSession
    static = None
    if v.static_vars:
        if v.table is None:  # made once, read in each round
            v.table = small(spark, v.static, [f"v_{n}" for n in v.static_vars])
        static = v.table
    df, pending, computed = None, list(v.builtins), set()
    # Patterns of one subject are joined with each other first: two stars meet in all that they share, not pattern by pattern.
    stars: dict = {}
    for i, a in enumerate(v.data):
        stars.setdefault(a.s if isinstance(a.s, Var) else i, []).append(i)
    todo = list(stars.values())
    while todo:
        at = next((x for x in todo if df is None or any(variables(v.data[i]) & {c[2:] for c in df.columns} for i in x)), todo[0])
        todo.remove(at)
        df = _join(df, reduce(_join, [scan(sources[i], v.data[i], keep) for i in at]))
        if static is not None and (set(static.columns) & set(df.columns) or not todo):
            df, static = _join(df, static), None
        # A test is applied as soon as its variables are there, so that later joins see fewer rows.
        for b in list(pending):
            if b.p not in (LOG.includes, LOG.notIncludes) and (b.p not in REGISTRY or REGISTRY[b.p].kind == "test") and variables(b) <= {c[2:] for c in df.columns} and b.p != LIST.member:
                df = _builtin(df, b, facts, lists, computed)
                pending.remove(b)
    for b in pending:
        df = _builtin(df, b, facts, lists, computed)
    return df


def instantiate(df: DataFrame, head: Iterable[Atom]) -> DataFrame:
    """A row for each head pattern; what isn't a statement (a literal as predicate, an unbound term) is dropped."""
    triples = F.array(*(F.struct(*(_col(t).alias(c) for c, t in zip("spo", a.terms, strict=True))) for a in head))
    out = df.select("msg_id", F.explode(triples).alias("t")).select("msg_id", "t.s", "t.p", "t.o")
    return out.where(F.col("s").isNotNull() & F.col("o").isNotNull() & is_iri(F.col("p")))


def mapping_rows(variants: Iterable[Variant]) -> dict[tuple[str, ...], list[tuple]]:
    """Simple variants as rows, by the positions that must match: (keys..., repeated, head s, p, o).

    A head term '$s', '$p' or '$o' stands for that column of the statement; repeated names two columns that must be equal.
    """
    out: dict[tuple[str, ...], set[tuple]] = {}
    for v in variants:
        for row in v.static if v.static_vars else [()]:
            got = dict(zip(v.static_vars, row, strict=True))
            atom = rename(v.data[0], got)
            where = {t.name: c for c, t in reversed(list(zip("spo", atom.terms, strict=True))) if isinstance(t, Var)}
            names = [t.name for t in atom.terms if isinstance(t, Var)]
            repeated = "".join(c for c, t in zip("spo", atom.terms, strict=True) if isinstance(t, Var) and names.count(t.name) > 1)
            keys = tuple(c for c, t in zip("spo", atom.terms, strict=True) if isinstance(t, str))
            for h in v.head:
                h = rename(h, got)
                terms = tuple(t if isinstance(t, str) else f"${where[t.name]}" for t in h.terms)
                if terms == tuple(t if isinstance(t, str) else f"${where[t.name]}" for t in atom.terms):
                    continue  # the statement itself
                out.setdefault(keys, set()).add((*(t for t in atom.terms if isinstance(t, str)), repeated, *terms))
    return {k: sorted(rows) for k, rows in out.items()}


def close_mappings(tables: dict[tuple[str, ...], list[tuple]], most: int = 100_000) -> tuple[dict[tuple[str, ...], list[tuple]], bool]:
    """Adds what two mappings give one after the other, until nothing is new; False if that isn't finished.

    Over closed tables one application is enough: what it gives needn't be looked up again.
    """
    rows = [({c: k for c, k in zip(keys, r, strict=False)}, r[-3:]) for keys, table in tables.items() for r in table if not r[len(keys)]]
    if len(rows) < sum(map(len, tables.values())):
        return tables, False  # patterns with a repeated variable aren't composed
    freeze = lambda pattern, head: (tuple(sorted(pattern.items())), head)
    seen, todo = {freeze(*r) for r in rows}, list(rows)
    by_p: dict[str | None, list] = {}
    for r in rows:
        by_p.setdefault(r[0].get("p"), []).append(r)
    steps = 0
    while todo:
        pattern, head = todo.pop()
        terms = dict(zip("spo", head, strict=True))
        after = by_p.get(None, []) + (by_p.get(terms["p"], []) if terms["p"][0] != "$" else [x for p, xs in by_p.items() if p is not None for x in xs])
        for second, out in list(after):
            steps += 1
            joined = dict(pattern)
            for c, wanted in second.items():
                have = terms[c]
                if have[0] == "$":
                    have = joined.setdefault(have[1], wanted)
                if have != wanted:
                    break
            else:
                made = tuple(terms[t[1]] if t[0] == "$" else t for t in out)
                made = tuple(joined.get(t[1], t) if t[0] == "$" else t for t in made)
                same = tuple(joined.get(c, f"${c}") for c in "spo")
                if made == same or freeze(joined, made) in seen:
                    continue
                seen.add(freeze(joined, made))
                todo.append((joined, made))
                by_p.setdefault(joined.get("p"), []).append((joined, made))
        if len(seen) > most or steps > 20 * most:
            return tables, False
    closed: dict[tuple[str, ...], list[tuple]] = {}
    for pattern, head in seen:
        keys = tuple(c for c in "spo" if c in dict(pattern))
        closed.setdefault(keys, []).append((*(dict(pattern)[c] for c in keys), "", *head))
    return {k: sorted(v) for k, v in closed.items()}, True


def apply_mappings(delta: DataFrame, tables: dict[tuple[str, ...], list[tuple]]) -> list[DataFrame]:
    """One scan and one broadcast lookup for each kind of key, however many rules stand behind it."""
    out = []
    for keys, rows in tables.items():
        table = small(delta.sparkSession, rows, [*(f"k_{c}" for c in keys), "repeated", "h_s", "h_p", "h_o"])
        met = delta.join(table, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"k_{c}") for c in keys])) if keys else delta.crossJoin(table)
        same = reduce(lambda a, b: a & b, [(F.col("repeated") != pair) | (F.col(pair[0]) == F.col(pair[-1])) for pair in ("so", "sp", "po")]) & ((F.col("repeated") != "spo") | ((F.col("s") == F.col("p")) & (F.col("p") == F.col("o"))))
        met = met.where(same) if any(r[len(keys)] for r in rows) else met
        pick = lambda h: F.when(F.col(h) == "$s", F.col("s")).when(F.col(h) == "$p", F.col("p")).when(F.col(h) == "$o", F.col("o")).otherwise(F.col(h))
        made = met.select("msg_id", *(pick(f"h_{c}").alias(c) for c in "spo"))
        out.append(made.where(is_iri(F.col("p"))))
    return out


def fixpoint(facts: DataFrame, variants: list[Variant], lists: list[DataFrame] | None = None, max_rounds: int = 100, max_facts: int | None = None, extra: Callable[[DataFrame, DataFrame], list[DataFrame]] | None = None, known_before: DataFrame | None = None, final: Callable[[DataFrame], list[DataFrame]] | None = None) -> DataFrame:
    """facts (msg_id, s, p, o) -> the new statements. Exceeding a limit is an error, never a partial result.

    extra(delta, known): more candidates per round (operators that aren't joins); final(known): new statements that no rule
    reads, each once, added at the end. Variants with negation run once the
    others have reached their fixpoint; if they add facts, the others go on.
    """
    spark = facts.sparkSession
    simple = [v for v in variants if v.simple]
    joins = [v for v in variants if not v.simple and not v.negative]
    negative = [v for v in variants if v.negative]
    tables, closed = close_mappings(mapping_rows(simple))
    known = [stored(facts.select(*COLUMNS).distinct(), "facts")]
    late = None
    if closed and extra is None and known_before is None and max_facts is None:
        joins, late = put_off(joins, negative, tables)
        if late is None:
            joins, late = put_off_twins(known[0], joins, simple, negative, lists)
    if known_before is not None:
        known.append(known_before.select(*COLUMNS))
    new: list[DataFrame] = []
    # Facts that mappings must be applied to: with closed tables, those that no mapping gave.
    delta = unmapped = known[0]
    rounds = total = 0
    only_mappings = closed and not joins and not extra

    def everything() -> DataFrame:
        return reduce(DataFrame.unionByName, known)

    def candidates() -> list[DataFrame]:
        all_facts = everything()
        out = [df.withColumn("joined", F.lit(0)) for df in apply_mappings(unmapped, tables)]
        # In the first round all is new, and one choice of the pattern that reads what is new gives every solution.
        once = delta is known[0] and known_before is None
        made = [instantiate(solutions(v, [delta if i == k else all_facts for k in range(len(v.data))], all_facts, lists), v.head) for v in joins for i in range(1 if once else len(v.data))]
        made += extra(delta, all_facts) if extra else []
        return out + [df.withColumn("joined", F.lit(1)) for df in made]

    def negatives() -> list[DataFrame]:
        every = everything()
        return [instantiate(solutions(v, [every] * len(v.data), every, lists), v.head).withColumn("joined", F.lit(1)) for v in negative]

    settled = False
    while True:
        found = negatives() if settled else candidates()
        n = 0
        if found:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"did not converge in {max_rounds} rounds")
            fresh = reduce(DataFrame.unionByName, found).groupBy(*COLUMNS).agg(F.min("joined").alias("joined")).join(everything(), COLUMNS, "left_anti")
            fresh = stored(fresh, "delta")
            n = fresh.count()
            total += n
            if max_facts is not None and total > max_facts:
                raise RuntimeError(f"closure exceeded {max_facts} facts")
        if n:
            delta = fresh.select(*COLUMNS)
            unmapped = fresh.where("joined = 1").select(*COLUMNS) if closed else delta
            known.append(delta)
            new.append(delta)
        if n and not (only_mappings and not settled):
            settled = False
        elif settled or not negative:
            break
        else:
            settled = True
    for add in (late, final):
        if add:
            new += add(everything())
    if not new:
        return spark.createDataFrame([], "msg_id long, s string, p string, o string")
    return reduce(DataFrame.unionByName, new)


def twin(v: Variant) -> tuple[list[Atom], list[str]] | None:
    """Patterns of ?x, and what they share with ?y, of a rule that says one thing of all ?x and ?y that agree in patterns of their own."""
    if v.static_vars or len(v.head) != 1 or len(v.data) < 2:
        return None
    h = v.head[0]
    if not (isinstance(h.s, Var) and isinstance(h.o, Var) and h.s != h.o and isinstance(h.p, str) and h.p[0] == "<"):
        return None
    if any(b.p != LOG.notEqualTo or {b.s, b.o} != {h.s, h.o} for b in v.builtins):
        return None
    of = lambda x: [a for a in v.data if a.s == x]
    mine, other = of(h.s), of(h.o)
    if len(mine) + len(other) != len(v.data) or any(not isinstance(a.p, str) or a.o in (h.s, h.o) for a in v.data) or {(a.p, a.o) for a in mine} != {(a.p, a.o) for a in other}:
        return None
    shared = sorted({a.o.name for a in mine if isinstance(a.o, Var)})
    return (mine, shared) if shared else None


def agreeing(facts: DataFrame, atoms: list[Atom], shared: list[str]) -> DataFrame:
    """msg_id, node and v_... of what is shared: the solutions of one half of a twin."""
    return reduce(_join, [scan(facts, a) for a in atoms]).select("msg_id", F.col(f"v_{atoms[0].s.name}").alias("node"), *(f"v_{n}" for n in shared)).distinct()


def put_off_twins(facts: DataFrame, joins: list[Variant], simple: list[Variant], negative: list[Variant], lists) -> tuple[list[Variant], Callable[[DataFrame], list[DataFrame]] | None]:
    """The same for a twin whose statements nothing else makes or reads, where each subject has one tuple of what is shared."""
    if len(joins) != 1 or simple or negative or twin(joins[0]) is None:
        return joins, None
    v, (atoms, shared), h = joins[0], twin(joins[0]), joins[0].head[0]
    if h.p in {a.p for a in v.data} or not facts.where(F.col("p") == h.p).isEmpty():
        return joins, None
    half = stored(agreeing(facts, atoms, shared), "halves")
    if half.count() != half.select("msg_id", "node").distinct().count():
        return joins, None

    def late(_: DataFrame) -> list[DataFrame]:
        from quadloom.operators.closures import squares

        pairs = squares(half, ["msg_id", *(f"v_{n}" for n in shared)])
        pairs = pairs.where("a <> b") if v.builtins else pairs
        return [pairs.select("msg_id", F.col("a").alias("s"), F.lit(h.p).alias("p"), F.col("b").alias("o"))]

    return [], late


def _transitive(v: Variant) -> set[str]:
    """Predicates for which the variant says that they are transitive, and nothing else."""
    if len(v.data) != 2 or v.builtins or len(v.head) != 1:
        return set()
    (a, b), h = v.data, v.head[0]
    if not (a.p == b.p == h.p and a.o == b.s and a.s == h.s and b.o == h.o and all(isinstance(x, Var) for x in (a.s, a.o, b.o)) and len({a.s, a.o, b.o}) == 3):
        return set()
    if isinstance(a.p, str):
        return set() if v.static_vars else {a.p}
    return {row[0] for row in v.static} if v.static_vars == [a.p.name] else set()


def put_off(joins: list[Variant], negative: list[Variant], tables: dict[tuple[str, ...], list[tuple]]) -> tuple[list[Variant], Callable[[DataFrame], list[DataFrame]] | None]:
    """-> (the joins that remain, what adds the closures of transitive predicates once the rest has reached its fixpoint).

    That is the whole of it where no join reads what they give: then only mappings do, and on closed tables those that
    keep both ends repeat the closure under another predicate, and those that keep one end give what the edges gave.
    """
    whole = {}
    for v in joins:
        for p in _transitive(v):
            whole.setdefault(p, []).append(v)
    images: dict[str, set[tuple[str, bool]]] = {}
    symmetric = set()
    for keys, rows in tables.items():
        for row in rows:
            pattern, (h_s, h_p, h_o) = dict(zip(keys, row, strict=False)), row[-3:]
            p = pattern.get("p")
            if p is not None and p not in whole:
                continue
            if len(pattern) != 1 or p is None or h_p in ("$s", "$o"):
                return joins, None
            if {h_s, h_o} != {"$s", "$o"}:
                continue
            if h_p in ("$p", p):
                symmetric.add(p)
            elif h_p not in whole:
                images.setdefault(h_p, set()).add((p, h_s == "$o"))
    given = whole.keys() | images.keys()
    done = [v for vs in whole.values() for v in vs]
    rest = [v for v in joins if not any(v is x for x in done)]
    for v in [*rest, *negative]:
        atoms = [*v.data, *(a for b in v.builtins if isinstance(b.o, Formula) for a in b.o.atoms)]
        for a in atoms:
            at = v.static_vars.index(a.p.name) if isinstance(a.p, Var) and a.p.name in v.static_vars else None
            names = {a.p} if isinstance(a.p, str) else {r[at] for r in v.static} if at is not None else given
            if names & given:
                return joins, None
    if not whole:
        return joins, None

    def late(known: DataFrame) -> list[DataFrame]:
        from quadloom.operators.closures import closed_pairs

        pairs = lambda p: known.where(F.col("p") == p).select("msg_id", F.col("s").alias("a"), F.col("o").alias("b"))
        said = lambda df, p, turned=False: df.select("msg_id", F.col("b" if turned else "a").alias("s"), F.lit(p).alias("p"), F.col("a" if turned else "b").alias("o"))
        edges = {p: stored(pairs(p), "paths") for p in sorted(whole)}
        found = {p: closed_pairs(e, with_edges=False) for p, e in edges.items() if not e.isEmpty()}
        out = [said(df, p) for p, df in found.items()]
        for q, sources in sorted(images.items()):
            sources = sorted({(p, turned and p not in symmetric) for p, turned in sources if p in found})
            if not sources:
                continue
            made = reduce(DataFrame.unionByName, [said(found[p], q, turned) for p, turned in sources])
            held = known.where(F.col("p") == q).select(*COLUMNS)
            if len(sources) == 1:  # distinct as they are; of the known ones, those that edges gave aren't among them
                held = held.join(said(edges[sources[0][0]], q, sources[0][1]), COLUMNS, "left_anti")
            else:
                made = made.distinct()
            out.append(made if held.isEmpty() else made.join(held, COLUMNS, "left_anti"))
        return out

    return rest, late


def visible(df: DataFrame) -> DataFrame:
    """Statements whose subject is no literal."""
    return df.where(~is_literal(F.col("s")))
