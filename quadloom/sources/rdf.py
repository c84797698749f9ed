"""Reads Turtle, TriG, N-Triples, N-Quads, N3 rules and message logs on the driver: ontologies, rules and shapes are small.

Large inputs are line-oriented and read by `quadloom.sources.nquads`, on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from quadloom.plans.rules import Atom, Document, Formula, ListTerm, Rule, Var, variables
from quadloom.terms import literal
from quadloom.vocab import FIRST, INTERNAL, LOG, NIL, OWL, REST, TYPE, XSD

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\s]*>)
      | (?P<long>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
      | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<op>=>|<=|\^\^|\{\||\|\}|<<|>>|[.;,()\[\]{}=~!])
      | (?P<var>\?[A-Za-z_][\w-]*)
      | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
      | (?P<blank>_:[\w·](?:[\w·.-]*[\w·-])?)
      | (?P<name>(?:[^\W\d_][\w·.-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?#@%])(?:(?:[\w·.:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?#@%])*(?:[\w·:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?#@%]))?)?)
      | (?P<word>[A-Za-z][A-Za-z0-9_]*)""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_MESSAGES = re.compile(r"""@version\s+["']1\.2-messages["']|VERSION\s+["']1\.2-messages["']|@message\b|^\s*MESSAGE\b""", re.I | re.M)


class SyntaxFault(ValueError):
    """A text that can't be read, with its place."""


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x) or "\\" + x

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S) if "\\" in text else text


class _Reader:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None, messages: bool = False):
        self.text, self.base, self.prefixes, self.messages = text, base, dict(prefixes or {}), messages
        self.tokens = list(self._scan())
        self.at = self.count = self.message = 0
        self.doc = Document(messages=[[]] if messages else None, prefixes=self.prefixes)
        self.labels: dict[str, str] = {}
        self.sink: list[Atom] | None = None  # of the formula being read
        self.graph = ""

    def _scan(self) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise SyntaxFault(f"cannot read {self.text[at:at + 30]!r} in line {self.text.count(chr(10), 0, at) + 1}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], at
            at = m.end()
        yield "end", "", at

    # --- tokens ---
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][:2]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1][:2]

    def fail(self, wanted: str):
        kind, text, at = self.tokens[min(self.at, len(self.tokens) - 1)]
        raise SyntaxFault(f"{wanted} expected instead of {text or kind!r} in line {self.text.count(chr(10), 0, at) + 1}")

    def expect(self, text: str) -> None:
        if self.peek()[1] != text or self.peek()[0] != "op":
            self.fail(text)
        self.at += 1

    def has(self, text: str) -> bool:
        return self.peek() == ("op", text)

    # --- terms ---
    def fresh(self) -> str:
        self.count += 1
        return f"_:b{self.message}_{self.count}" if self.messages else f"_:b{self.count}"

    def label(self, name: str) -> str:
        if name not in self.labels:
            self.labels[name] = f"_:m{self.message}_{name[2:]}" if self.messages else name
        return self.labels[name]

    def resolve(self, ref: str) -> str:
        ref = _unescape(ref)
        return f"<{ref if re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', ref) or not self.base else urljoin(self.base, ref)}>"

    def name(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise SyntaxFault(f"prefix {prefix!r} is not declared")
        return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"

    def term(self):
        kind, text = self.take()
        if kind == "iri":
            return self.resolve(text[1:-1])
        if kind == "name":
            return self.name(text)
        if kind == "var":
            return Var(text[1:])
        if kind == "blank":
            return Var("_" + text[2:]) if self.sink is not None and self.in_rule else self.label(text)
        if kind in ("string", "long"):
            lex = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return literal(lex, lang=self.take()[1][1:])
            if self.has("^^"):
                self.take()
                return literal(lex, self.term())
            return literal(lex)
        if kind == "number":
            return literal(text, XSD.double if "e" in text.lower() else XSD.decimal if "." in text else XSD.integer)
        if kind == "word":
            if text in ("true", "false"):
                return literal(text, XSD.boolean)
            if text == "a":
                return TYPE
        if kind == "op":
            if text == "=":
                return OWL.sameAs
            if text == "(":
                items = []
                while not self.has(")"):
                    items.append(self.term())
                self.take()
                return ListTerm(tuple(items))
            if text == "[":
                node = Var(f"_anon{self.fresh()[2:]}") if self.sink is not None and self.in_rule else self.fresh()
                if not self.has("]"):
                    self.properties(node)
                self.expect("]")
                return node
            if text == "{":
                return self.formula()
        self.at -= 1
        self.fail("a term")

    in_rule = False

    def formula(self) -> Formula:
        held, self.sink = self.sink, []
        was, self.in_rule = self.in_rule, True
        while not self.has("}"):
            self.statement_body()
            if self.has("."):
                self.take()
            elif not self.has("}"):
                self.fail(". or }")
        self.take()
        atoms, self.sink, self.in_rule = self.sink, held, was
        return Formula(tuple(atoms))

    # --- statements ---
    def emit(self, s, p, o) -> None:
        if self.sink is not None:
            self.sink.append(Atom(s, p, o))
            return
        s, o = self.ground(s), self.ground(o)
        quad = (s, p, o, self.graph)
        self.doc.quads.append(quad)
        if self.messages:
            self.doc.messages[-1].append(quad)

    def ground(self, term) -> str:
        """Lists become cells; formulas and variables aren't data."""
        if isinstance(term, ListTerm):
            head = NIL
            for item in reversed(term.items):
                cell = self.fresh()
                self.emit(cell, FIRST, self.ground(item))
                self.emit(cell, REST, head)
                head = cell
            return head
        if not isinstance(term, str):
            raise SyntaxFault(f"{term!r} is no term of a fact")
        return term

    def properties(self, subject) -> None:
        while True:
            p = self.term()
            while True:
                o = self.term()
                self.emit(subject, p, o)
                self.annotations(subject, p, o)
                if not self.has(","):
                    break
                self.take()
            if not self.has(";"):
                return
            while self.has(";"):
                self.take()
            if self.peek()[1] in (".", "]", "}", "|}") or self.peek()[0] == "end":
                return

    def annotations(self, s, p, o) -> None:
        """RDF 1.2: a reifier (~ id) and its properties ({| ... |}) become triples about the reifier."""
        while self.has("~") or self.has("{|"):
            reifier = None
            if self.has("~"):
                self.take()
                reifier = self.term() if self.peek()[0] in ("iri", "name", "blank", "var") else None
            reifier = reifier or self.fresh()
            for part, value in ((INTERNAL.reifiesSubject, s), (INTERNAL.reifiesPredicate, p), (INTERNAL.reifiesObject, o)):
                self.emit(reifier, part, value)
            if self.has("{|"):
                self.take()
                self.properties(reifier)
                self.expect("|}")

    def statement_body(self) -> None:
        began = self.peek()
        subject = self.term()
        if began == ("op", "[") and self.peek()[1] in (".", "}"):
            return
        self.properties(subject)

    def directive(self) -> bool:
        kind, text = self.peek()
        word = text.lower().lstrip("@")
        if kind not in ("at", "word") or word not in ("prefix", "base", "version", "message", "graph"):
            return False
        self.take()
        if word == "prefix":
            prefix = self.take()[1].rpartition(":")[0]
            self.prefixes[prefix] = self.resolve(self.take()[1][1:-1])[1:-1]
        elif word == "base":
            self.base = self.take()[1][1:-1]
        elif word == "version":
            self.take()
        elif word == "message":
            if not self.messages:
                raise SyntaxFault("a message boundary in plain data")
            self.message += 1
            self.labels = {}
            self.doc.messages.append([])
        else:
            self.block(self.term())
            return True
        if kind == "at" and self.has("."):
            self.take()
        return True

    def block(self, graph: str) -> None:
        self.expect("{")
        held, self.graph = self.graph, graph
        while not self.has("}"):
            self.statement_body()
            if self.has("."):
                self.take()
        self.take()
        self.graph = held

    def read(self) -> Document:
        while self.peek()[0] != "end":
            if self.directive():
                continue
            if self.has("{"):
                self.formula_statement()
                continue
            if self.peek()[0] in ("iri", "name", "blank") and self.peek(1) == ("op", "{"):
                self.block(self.term())
                continue
            start = self.peek()
            subject = self.term()
            if start == ("op", "[") and self.has("."):
                self.take()
                continue
            if self.peek(2)[0] in ("iri", "name", "blank") and self.peek(3) == ("op", ".") and self.peek()[0] != "word" and self.peek(1)[0] in ("iri", "blank", "string", "name", "long"):
                # N-Quads: subject predicate object graph .
                p, o, self.graph = self.term(), self.term(), self.term()
                self.emit(subject, p, o)
                self.graph = ""
            elif self._nquad_literal():
                p, o = self.term(), self.term()
                self.graph = self.term() if not self.has(".") else ""
                self.emit(subject, p, o)
                self.graph = ""
            else:
                self.properties(subject)
            self.expect(".")
        return self.doc

    def _nquad_literal(self) -> bool:
        """subject predicate literal graph . where the literal has a datatype or language."""
        if self.peek(1)[0] not in ("string", "long"):
            return False
        k = 2 + (1 if self.peek(2)[0] == "at" else 2 if self.peek(2) == ("op", "^^") else 0)
        return self.peek(k)[0] in ("iri", "blank") and self.peek(k + 1) == ("op", ".")

    def formula_statement(self) -> None:
        self.take()
        left = self.formula()
        kind, text = self.peek()
        implied = {"=>": True, "<=": False}.get(text)
        if implied is None and kind in ("iri", "name"):
            p = self.term()
            implied = {LOG.implies: True, LOG.isImpliedBy: False}.get(p)
            if implied is None:
                self.fail("a rule")
        elif implied is not None:
            self.take()
        if implied is None:
            for atom in left.atoms:  # a default graph block
                self.emit(*(x if isinstance(x, str) else self.label("_:" + x.name.lstrip("_")) if isinstance(x, Var) else x for x in atom.terms))
            return
        if self.peek() == ("word", "true"):
            self.take()
            right = Formula(())
        else:
            right = self.term()
        if not isinstance(right, Formula):
            self.fail("a formula")
        if self.has("."):
            self.take()
        body, head = (left, right) if implied else (right, left)
        blank = {v for a in head.atoms for v in variables(a) if v.startswith("_")} - {v for a in body.atoms for v in variables(a)}
        if blank and implied:
            raise SyntaxFault("a blank node in a rule's head would be new in every round; use log:skolem")
        rule = Rule(body.atoms, head.atoms, f"rule {len(self.doc.forward) + len(self.doc.backward) + 1}")
        (self.doc.forward if implied else self.doc.backward).append(rule)


def parse(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> Document:
    """Any of the syntaxes; a text with message syntax is read as a message log, empty messages kept."""
    if _MESSAGES.search(text):
        return _Reader(text, base, prefixes, messages=True).read()
    return _Reader(text, base, prefixes).read()


def parse_triples(text: str, **options) -> list[tuple[str, str, str]]:
    return [q[:3] for q in parse(text, **options).quads]


def lists_of(triples) -> dict[str, list[str]]:
    """head -> items of every well-formed list; cyclic or malformed ones are left out."""
    first, rest, bad = {}, {}, set()
    for s, p, o in triples:
        if p in (FIRST, REST):
            table = first if p == FIRST else rest
            if table.setdefault(s, o) != o:
                bad.add(s)
    out = {NIL: []}
    for head in first:
        items, node, seen = [], head, set()
        while node != NIL and node in first and node in rest and node not in seen and node not in bad:
            seen.add(node)
            items.append(first[node])
            node = rest[node]
        if node == NIL:
            out[head] = items
    return out


__all__ = ["Document", "SyntaxFault", "lists_of", "parse", "parse_triples"]
