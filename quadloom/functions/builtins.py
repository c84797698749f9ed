"""N3 builtins by predicate: which arguments must be bound, and what they give, in Python and as Catalyst expressions.

A builtin that fails, or whose argument has the wrong kind, removes the solution: Python returns None, columns are null.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms as T
from quadloom.functions import datatypes as D
from quadloom.vocab import DT, GENID, INTERNAL, LIST, LOG, MATH, STRING, XSD


@dataclass(frozen=True)
class Builtin:
    """kind 'function': object from subject's arguments; 'test': true or false of both sides."""

    kind: str
    local: Callable
    column: Callable
    many: bool = False  # the subject is a list of arguments


REGISTRY: dict[str, Builtin] = {}
#: Builtins that the engine handles itself, because they aren't functions of their arguments.
SPECIAL = {LOG.includes, LOG.notIncludes, LOG.equalTo, LIST.member, LOG.memoize, LOG.implies, LOG.isImpliedBy, LOG.collectAllIn}
NAMESPACES = tuple(f"<{n}" for n in (LOG, MATH, STRING, LIST, DT)) + ("<http://www.w3.org/2000/10/swap/time#", "<http://www.w3.org/2000/10/swap/crypto#", "<http://www.w3.org/2000/10/swap/os#")


def register(predicate: str, kind: str, local: Callable, column: Callable, many: bool = False) -> None:
    """Adds a builtin, or replaces one: predicate is a key."""
    REGISTRY[predicate] = Builtin(kind, local, column, many)


def is_builtin(predicate) -> bool:
    return isinstance(predicate, str) and (predicate in REGISTRY or predicate in SPECIAL or predicate.startswith(NAMESPACES))


def _arithmetic(name: str, local: Callable, column: Callable, many: bool = True) -> None:
    def run(*keys):
        values = [D.number(k) for k in keys]
        if not values or any(v is None for v in values):
            return None
        try:
            x = local(values)
        except (ZeroDivisionError, OverflowError, ValueError):
            return None
        return None if x is None else D.number_literal(x, list(keys))

    register(MATH[name], "function", run, lambda *cs: D.number_column(column([D.numeric_value(c) for c in cs]), list(cs)), many)


_arithmetic("sum", sum, lambda v: reduce(lambda a, b: a + b, v))
_arithmetic("product", math.prod, lambda v: reduce(lambda a, b: a * b, v))
_arithmetic("difference", lambda v: v[0] - v[1], lambda v: v[0] - v[1])
_arithmetic("quotient", lambda v: v[0] / v[1], lambda v: F.try_divide(v[0], v[1]))
_arithmetic("exponentiation", lambda v: float(v[0]) ** v[1] if v[0] > 0 or float(v[1]).is_integer() else None, lambda v: F.pow(v[0], v[1]))
#: The exponent, where it is what is asked for: log of the second to the base of the first.
register(INTERNAL.exponentOf, "function", lambda b, r: _exponent(b, r), lambda b, r: D.number_column(F.when((D.numeric_value(b) > 0) & (D.numeric_value(b) != 1) & (D.numeric_value(r) > 0), F.ln(D.numeric_value(r)) / F.ln(D.numeric_value(b))), [b, r]), many=True)


def _exponent(b: str, r: str) -> str | None:
    x, y = D.number(b), D.number(r)
    return None if x is None or y is None or x <= 0 or x == 1 or y <= 0 else D.number_literal(math.log(y) / math.log(x), [b, r])


_arithmetic("negation", lambda v: -v[0], lambda v: -v[0], many=False)
_arithmetic("absoluteValue", lambda v: abs(v[0]), lambda v: F.abs(v[0]), many=False)
_arithmetic("floor", lambda v: math.floor(v[0]), lambda v: F.floor(v[0]).cast("double"), many=False)
_arithmetic("ceiling", lambda v: math.ceil(v[0]), lambda v: F.ceil(v[0]).cast("double"), many=False)
register(MATH.rounded, "function", lambda k: None if D.number(k) is None else f'"{math.floor(D.number(k) + 0.5)}"^^{XSD.integer}', lambda c: T.make_literal(F.floor(D.numeric_value(c) + 0.5).cast("decimal(38,0)").cast("string"), XSD.integer))


def _comparable(key: str):
    n = D.number(key)
    if n is not None:
        return "n", float(n)
    parts = T.split_literal(key) if key[:1] == '"' else None
    return ("t", parts[0]) if parts and D.short(parts[1]) in ("dateTime", "dateTimeStamp", "date") else None


def _comparison(name: str, test: Callable) -> None:
    def run(a, b):
        x, y = _comparable(a), _comparable(b)
        return bool(test(x[1], y[1])) if x and y and x[0] == y[0] else None

    def column(a: Column, b: Column) -> Column:
        times = lambda c: F.when(T.datatype_of(c).isin(XSD.dateTime, XSD.dateTimeStamp, XSD.date), F.try_to_timestamp(T.lexical_form(c)))
        return F.coalesce(test(D.numeric_value(a), D.numeric_value(b)), test(times(a), times(b)), F.lit(False))

    register(MATH[name], "test", run, column)


for _name, _test in {"greaterThan": lambda a, b: a > b, "lessThan": lambda a, b: a < b, "notGreaterThan": lambda a, b: a <= b, "notLessThan": lambda a, b: a >= b, "equalTo": lambda a, b: a == b, "notEqualTo": lambda a, b: a != b}.items():
    _comparison(_name, _test)

register(LOG.notEqualTo, "test", lambda a, b: a != b, lambda a, b: a != b)


def _dtlit(lexical, datatype):
    parts = T.split_literal(lexical) if lexical[:1] == '"' else None
    return T.literal(parts[0], datatype) if parts and parts[1] == XSD.string and datatype[:1] == "<" else None


register(LOG.dtlit, "function", _dtlit, lambda a, b: F.when((T.datatype_of(a) == XSD.string) & T.is_iri(b), T.make_literal(T.lexical_form(a), b)), many=True)


def _skolem(*keys):
    if any(k.startswith("_:") for k in keys):
        return None
    return f"<{GENID}{hashlib.sha256(''.join(f'{len(k)}:{k}' for k in keys).encode()).hexdigest()}>"


def _skolem_column(*cs: Column) -> Column:
    named = reduce(lambda a, b: a & b, [~T.is_blank(c) for c in cs])
    return F.when(named, T.skolem_iri(GENID, list(cs)))


register(LOG.skolem, "function", _skolem, _skolem_column, many=True)


def _string(name: str, test: Callable, column: Callable) -> None:
    def run(a, b):
        x, y = _text(a), _text(b)
        return None if x is None or y is None else bool(test(x, y))

    register(STRING[name], "test", run, lambda a, b: F.coalesce(column(T.text_of(a), T.text_of(b)), F.lit(False)))


def _text(key: str) -> str | None:
    return key[1:-1] if key[:1] == "<" else T.split_literal(key)[0] if key[:1] == '"' else None


def _concat(*keys):
    texts = [_text(k) for k in keys]
    return None if any(t is None for t in texts) else T.literal("".join(texts))


register(STRING.concatenation, "function", _concat, lambda *cs: T.make_literal(F.concat(*map(T.text_of, cs)), XSD.string), many=True)
_string("contains", lambda a, b: b in a, lambda a, b: a.contains(b))
_string("startsWith", lambda a, b: a.startswith(b), lambda a, b: a.startswith(b))
_string("endsWith", lambda a, b: a.endswith(b), lambda a, b: a.endswith(b))
_string("matches", lambda a, b: re.search(b, a), lambda a, b: F.rlike(a, b))
_string("notMatches", lambda a, b: not re.search(b, a), lambda a, b: ~F.rlike(a, b))


def _scrape(text, pattern):
    x, y = _text(text), _text(pattern)
    m = re.search(y, x) if x is not None and y is not None else None
    return T.literal(m[1]) if m and m.re.groups and m[1] is not None else None


register(STRING.scrape, "function", _scrape, lambda a, b: F.when(F.rlike(T.text_of(a), T.text_of(b)), T.make_literal(F.call_function("regexp_extract", T.text_of(a), T.text_of(b), F.lit(1)), XSD.string)), many=True)
register(STRING.length, "function", lambda a: None if _text(a) is None else f'"{len(_text(a))}"^^{XSD.integer}', lambda a: T.make_literal(F.length(T.text_of(a)).cast("string"), XSD.integer))
register(DT.datatype, "function", lambda a: T.split_literal(a)[1] if a[:1] == '"' else None, T.datatype_of)
register(DT.lexicalForm, "function", lambda a: T.literal(T.split_literal(a)[0]) if a[:1] == '"' else None, lambda a: T.make_literal(T.lexical_form(a), XSD.string))
register(DT.language, "function", lambda a: T.literal(T.split_literal(a)[2]) if a[:1] == '"' and T.split_literal(a)[2] else None, lambda a: T.make_literal(T.language_of(a), XSD.string))
register(DT.sameValueAs, "test", lambda a, b: D.value(a) is not None and D.value(a) == D.value(b), lambda a, b: F.coalesce(D.value_key(a) == D.value_key(b), F.lit(False)))
register(DT.differentValueFrom, "test", lambda a, b: None not in (D.value(a), D.value(b)) and D.value(a) != D.value(b), lambda a, b: F.coalesce(D.value_key(a) != D.value_key(b), F.lit(False)))
register(DT.validForDatatype, "test", lambda a, b: a[:1] == '"' and D.valid(T.split_literal(a)[0], b), lambda a, b: F.coalesce(T.is_literal(a) & D.valid_column(T.lexical_form(a), b), F.lit(False)))
register(DT.invalidForDatatype, "test", lambda a, b: a[:1] == '"' and not D.valid(T.split_literal(a)[0], b), lambda a, b: F.coalesce(T.is_literal(a) & ~D.valid_column(T.lexical_form(a), b), F.lit(False)))
register(DT.canonicalLiteral, "function", lambda a: a if D.value(a) is not None else None, D.canonical)
register(LIST.length, "function", lambda *items: f'"{len(items)}"^^{XSD.integer}', lambda *cs: T.make_literal(F.lit(str(len(cs))), XSD.integer), many=True)
register(LIST.notMember, "test", lambda items, x: x not in items, lambda *cs: reduce(lambda a, b: a & b, [c != cs[-1] for c in cs[:-1]], F.lit(True)), many=True)
