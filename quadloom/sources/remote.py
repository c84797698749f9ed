"""Graphs by address, with content negotiation. The opener is the caller's: this module opens no connection by itself."""

from __future__ import annotations

from collections.abc import Callable

from quadloom.plans.local import Triple
from quadloom.sources.rdf import parse_triples
from quadloom.sources.writers import rdf_xml

#: Media type -> syntax.
MEDIA = {"text/turtle": "rdf", "application/trig": "rdf", "application/n-triples": "rdf", "application/n-quads": "rdf", "text/n3": "rdf", "application/rdf+xml": "xml", "application/owl+xml": "xml", "text/xml": "xml", "application/xml": "xml"}
ENDINGS = {".ttl": "rdf", ".trig": "rdf", ".nt": "rdf", ".nq": "rdf", ".n3": "rdf", ".rdf": "xml", ".owl": "xml", ".xml": "xml"}
ACCEPT = "text/turtle, application/trig;q=0.9, application/n-quads;q=0.9, application/rdf+xml;q=0.8, */*;q=0.1"

Opener = Callable[[str, dict[str, str]], tuple[str, str]]


class UnknownMedia(ValueError):
    """A document in a syntax that isn't read here."""


def fetch(url: str, opener: Opener) -> list[Triple]:
    """opener(url, headers) -> (text, media type). The type decides, else the ending of the address."""
    text, media = opener(url, {"Accept": ACCEPT})
    kind = MEDIA.get(media.split(";")[0].strip().lower()) or next((k for e, k in ENDINGS.items() if url.split("?")[0].endswith(e)), None)
    if kind == "rdf":
        return parse_triples(text, base=url)
    if kind == "xml":
        return rdf_xml(text, url, lambda u: opener(u, {"Accept": ACCEPT})[0])
    raise UnknownMedia(f"{media or 'no media type'} of {url}")
