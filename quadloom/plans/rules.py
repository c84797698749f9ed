"""Rules as the engine sees them: atoms over variables, term keys, lists and quoted formulas."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    def __repr__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class ListTerm:
    items: tuple

    def __repr__(self) -> str:
        return "(" + " ".join(map(repr, self.items)) + ")"


@dataclass(frozen=True)
class Formula:
    atoms: tuple

    def __repr__(self) -> str:
        return "{" + " ".join(map(repr, self.atoms)) + "}"


Term = Var | ListTerm | Formula | str


@dataclass(frozen=True)
class Atom:
    s: Term
    p: Term
    o: Term

    def __repr__(self) -> str:
        return f"{self.s} {self.p} {self.o} ."

    @property
    def terms(self) -> tuple:
        return self.s, self.p, self.o


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    head: tuple[Atom, ...]
    name: str = ""


@dataclass
class Document:
    """What a text holds: quads by message (None: no messages), rules forward and backward, prefixes."""

    quads: list[tuple[str, str, str, str]] = field(default_factory=list)
    messages: list[list[tuple[str, str, str, str]]] | None = None
    forward: list[Rule] = field(default_factory=list)
    backward: list[Rule] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)


def variables(term) -> set[str]:
    if isinstance(term, Var):
        return {term.name}
    if isinstance(term, ListTerm):
        return set().union(*map(variables, term.items)) if term.items else set()
    if isinstance(term, Formula):
        return set().union(*(variables(a) for a in term.atoms)) if term.atoms else set()
    if isinstance(term, Atom):
        return set().union(*map(variables, term.terms))
    return set()


def rename(term, names):
    """names: a mapping of variables to terms, or a function of their names."""
    if isinstance(term, Var):
        return names(term.name) if callable(names) else names.get(term.name, term)
    if isinstance(term, ListTerm):
        return ListTerm(tuple(rename(x, names) for x in term.items))
    if isinstance(term, Formula):
        return Formula(tuple(rename(a, names) for a in term.atoms))
    if isinstance(term, Atom):
        return Atom(*(rename(x, names) for x in term.terms))
    return term
