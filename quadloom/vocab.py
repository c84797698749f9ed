"""Namespaces and our own constants."""

from __future__ import annotations


class Namespace(str):
    """Namespace('http://x#').name is the key '<http://x#name>'; ns['a b'] for any local name."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return f"<{self}{name.rstrip('_')}>"

    def __getitem__(self, name) -> str:  # type: ignore[override]
        return f"<{self}{name}>"


RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Namespace("http://www.w3.org/2000/01/rdf-schema#")
OWL = Namespace("http://www.w3.org/2002/07/owl#")
XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
SKOS = Namespace("http://www.w3.org/2004/02/skos/core#")
SH = Namespace("http://www.w3.org/ns/shacl#")
QUDT = Namespace("http://qudt.org/schema/qudt/")
UNIT = Namespace("http://qudt.org/vocab/unit/")
CDT = Namespace("https://w3id.org/cdt/")
LCDT = Namespace("http://w3id.org/lindt/custom_datatypes#")
LOG = Namespace("http://www.w3.org/2000/10/swap/log#")
MATH = Namespace("http://www.w3.org/2000/10/swap/math#")
STRING = Namespace("http://www.w3.org/2000/10/swap/string#")
LIST = Namespace("http://www.w3.org/2000/10/swap/list#")
#: Fixed value: the namespace of the datatype builtins that rules use.
DT = Namespace("https://eyereasoner.github.io/eyeling/datatype#")

#: Terms of our own.
OURS = "urn:quadloom:"
INC = Namespace(OURS + "inconsistency:")
NORM = Namespace(OURS + "quantity:")
INTERNAL = Namespace(OURS + "internal:")
GENID = OURS + "genid:"

TYPE = RDF.type_
FIRST, REST, NIL = RDF.first, RDF.rest, RDF.nil
SAME_AS, DIFFERENT_FROM = OWL.sameAs, OWL.differentFrom

PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS, "sh": SH, "qudt": QUDT, "unit": UNIT, "cdt": CDT, "lcdt": LCDT,
    "log": LOG, "math": MATH, "string": STRING, "list": LIST, "dt": DT, "inc": INC, "norm": NORM, "internal": INTERNAL,
}
