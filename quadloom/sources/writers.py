"""Turtle and TriG text of small results, with only the prefixes that are used; RDF/XML reader of ontologies."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable

from quadloom.plans.local import Triple
from quadloom.terms import literal, split_literal
from quadloom.vocab import FIRST, NIL, OWL, PREFIXES, RDF, REST, TYPE, XSD

_LOCAL = re.compile(r"[A-Za-z_][\w-]*(?:\.[\w-]+)*$|$")


class PrefixTable:
    """Longest declared namespace first, then known ones, then ns1, ns2... for namespaces used often enough."""

    def __init__(self, declared: dict[str, str] | None = None, least_uses: int = 2):
        self.declared, self.least_uses, self.used = dict(declared or {}), least_uses, {}
        self.counts: dict[str, int] = {}

    def count(self, iris: Iterable[str]) -> None:
        for x in iris:
            space = re.match(r"<(.*[/#])[^/#>]*>$", x)
            if space:
                self.counts[space[1]] = self.counts.get(space[1], 0) + 1

    def short(self, key: str) -> str:
        value = key[1:-1]
        for table in (self.declared, PREFIXES):
            for name, space in sorted(table.items(), key=lambda x: -len(x[1])):
                if value.startswith(space) and _LOCAL.match(value[len(space) :]) and self.used.get(name, space) == space:
                    self.used[name] = str(space)
                    return f"{name}:{value[len(space):]}"
        space = re.match(r"(.*[/#])([^/#]*)$", value)
        if space and self.counts.get(space[1], 0) >= self.least_uses and _LOCAL.match(space[2]):
            name = next((n for n, s in self.used.items() if s == space[1]), None) or next(f"ns{i}" for i in range(1, 1 << 30) if f"ns{i}" not in self.used and f"ns{i}" not in self.declared)
            self.used[name] = space[1]
            return f"{name}:{space[2]}"
        return key


def term_text(key: str, prefixes: PrefixTable | None = None) -> str:
    if key[0] == "<":
        return "a" if key == TYPE and prefixes else prefixes.short(key) if prefixes else key
    parts = split_literal(key)
    if not parts:
        return "_:" + re.sub(r"[^\w]", "_", key[2:])
    lexical, datatype, lang = parts
    body = '"' + lexical.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if lang:
        return f"{body}@{lang}"
    if datatype == XSD.string:
        return body
    return f"{body}^^{prefixes.short(datatype) if prefixes else datatype}"


def turtle(triples: Iterable[Triple], prefixes: dict[str, str] | None = None) -> str:
    """Grouped by subject and predicate."""
    rows = sorted(set(triples))
    table = PrefixTable(prefixes)
    table.count(x for t in rows for x in t if x[0] == "<")
    blocks, now = [], None
    for s, p, o in rows:
        if s != now:
            blocks.append([term_text(s, table) if s != TYPE else table.short(s), []])
            now = s
        blocks[-1][1].append((term_text(p, table), term_text(o, table) if o != TYPE else table.short(o)))
    body = "\n".join(f"{s} " + " ;\n    ".join(f"{p} {o}" for p, o in pairs) + " ." for s, pairs in blocks)
    head = "".join(f"@prefix {n}: <{v}> .\n" for n, v in sorted(table.used.items()))
    return f"{head}\n{body}\n" if head else f"{body}\n"


def trig_messages(messages: Iterable[Iterable[Triple]], prefixes: dict[str, str] | None = None) -> str:
    """A message log; empty messages stay."""
    parts = []
    for m in messages:
        rows = sorted(set(m))
        parts.append("".join(f"{term_text(s)} {term_text(p)} {term_text(o)} .\n" for s, p, o in rows))
    return 'VERSION "1.2-messages"\n' + "MESSAGE\n".join(parts)


def rdf_xml(text: str, base: str = "", fetch: Callable[[str], str] | None = None, _seen: set[str] | None = None) -> list[Triple]:
    """Triples of RDF/XML. fetch: how the document of an owl:imports is got; each is read once; without it imports stay."""
    from urllib.parse import urljoin

    out: list[Triple] = []
    count = [0]
    rdf, xml = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    name = lambda tag: "<" + tag[1:].replace("}", "", 1) + ">"

    def blank() -> str:
        count[0] += 1
        return f"_:x{len(_seen or ())}_{count[0]}"

    def node(e: ET.Element, here: str, lang: str | None) -> str:
        here, lang = e.get(f"{xml}base", here), e.get(f"{xml}lang", lang)
        about, node_id, ident = e.get(f"{rdf}about"), e.get(f"{rdf}nodeID"), e.get(f"{rdf}ID")
        s = f"<{urljoin(here, about)}>" if about is not None else f"_:{node_id}" if node_id else f"<{urljoin(here, '#' + ident)}>" if ident else blank()
        if e.tag != f"{rdf}Description":
            out.append((s, TYPE, name(e.tag)))
        for k, v in e.attrib.items():
            if not k.startswith((rdf, xml)) and k[0] == "{":
                out.append((s, name(k), literal(v, lang=lang)))
            elif k == f"{rdf}type":
                out.append((s, TYPE, f"<{urljoin(here, v)}>"))
        number = 0
        for child in e:
            p = name(child.tag)
            if child.tag == f"{rdf}li":
                number += 1
                p = RDF[f"_{number}"]
            out.append((s, p, value(child, here, lang)))
        return s

    def value(e: ET.Element, here: str, lang: str | None) -> str:
        here, lang = e.get(f"{xml}base", here), e.get(f"{xml}lang", lang)
        resource, node_id, kind = e.get(f"{rdf}resource"), e.get(f"{rdf}nodeID"), e.get(f"{rdf}parseType")
        if resource is not None:
            return f"<{urljoin(here, resource)}>"
        if node_id:
            return f"_:{node_id}"
        if kind == "Resource":
            s = blank()
            for child in e:
                out.append((s, name(child.tag), value(child, here, lang)))
            return s
        if kind == "Collection":
            head = NIL
            for child in reversed([node(c, here, lang) for c in e]):
                cell = blank()
                out.extend([(cell, FIRST, child), (cell, REST, head)])
                head = cell
            return head
        if len(e):
            return node(e[0], here, lang)
        datatype = e.get(f"{rdf}datatype")
        return literal(e.text or "", f"<{urljoin(here, datatype)}>" if datatype else XSD.string, None if datatype else lang)

    root = ET.fromstring(text)
    for e in root if root.tag == f"{rdf}RDF" else [root]:
        node(e, root.get(f"{xml}base", base), root.get(f"{xml}lang"))
    seen = _seen if _seen is not None else {base}
    for _, p, o in list(out):
        if p == OWL.imports and fetch and o[1:-1] not in seen:
            seen.add(o[1:-1])
            out += rdf_xml(fetch(o[1:-1]), o[1:-1], fetch, seen)
    return out
