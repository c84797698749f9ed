"""Term keys: every RDF term is one string, so equality of terms is equality of strings.

    <iri>    _:label    "lexical"^^<datatype>    "lexical"@lang

The lexical form stands unescaped between the first and the last quotation mark. Functions on Python strings come first,
the same on columns after them; the latter are Catalyst expressions, so filters on terms stay in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.vocab import XSD

STATEMENT = "msg_id long, s string, p string, o string"
COLUMNS = ["msg_id", "s", "p", "o"]
_LITERAL = re.compile(r'^"(.*)"(?:\^\^<([^<>"]*)>|@([A-Za-z0-9-]+))$', re.S)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lexical: str, datatype: str = XSD.string, lang: str | None = None) -> str:
    """datatype is a key, e.g. '<http://...#string>'."""
    return f'"{lexical}"@{lang.lower()}' if lang else f'"{lexical}"^^{datatype}'


def kind(key: str) -> str:
    return {"<": "iri", "_": "blank", '"': "literal"}[key[0]]


def split_literal(key: str) -> tuple[str, str, str | None] | None:
    """(lexical, datatype key, language) of a literal, None for other terms."""
    m = _LITERAL.match(key) if key[:1] == '"' else None
    if not m:
        return None
    return m[1], f"<{m[2]}>" if m[2] is not None else "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>", m[3]


def let(values: list[Column], body) -> Column:
    """body(*values) with each value computed once however often the body names it.

    Without it, a large expression over a large expression grows with the product of their sizes when filters are pushed
    through projections. For terms (strings) only.
    """
    return F.transform(F.array(F.array(*values)), lambda v: body(*(v[i] for i in range(len(values)))))[0]


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def _has_lang(c: Column) -> Column:
    return is_literal(c) & ~c.endswith(">")


def _last_quote(c: Column) -> Column:
    return F.length(c) - F.locate('"', F.reverse(c)) + 1


def lexical_form(c: Column) -> Column:
    """Null for terms that aren't literals."""
    return F.when(is_literal(c), F.substring(c, F.lit(2), _last_quote(c) - 2))


def datatype_of(c: Column) -> Column:
    lang = F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>")
    return F.when(is_literal(c), F.when(_has_lang(c), lang).otherwise(F.substring(c, _last_quote(c) + 3, F.length(c))))


def language_of(c: Column) -> Column:
    return F.when(_has_lang(c), F.substring(c, _last_quote(c) + 2, F.length(c)))


def text_of(c: Column) -> Column:
    """Lexical form of a literal, the IRI of an IRI; null for blank nodes."""
    return F.when(is_iri(c), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(lexical_form(c))


def make_literal(lexical: Column, datatype: Column | str) -> Column:
    return F.concat(F.lit('"'), lexical, F.lit('"^^'), F.lit(datatype) if isinstance(datatype, str) else datatype)


def skolem_iri(prefix: str, parts: list[Column], scope: str = "") -> Column:
    """An IRI that depends on the parts only: SHA-256 of their length-delimited concatenation."""
    pieces = [F.lit(f"{len(scope)}:{scope}")] if scope else []
    for p in parts:
        pieces += [F.length(p).cast("string"), F.lit(":"), p]
    return F.concat(F.lit(f"<{prefix}"), F.sha2(F.concat(*pieces).cast("binary"), 256), F.lit(">"))
