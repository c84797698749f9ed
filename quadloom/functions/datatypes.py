"""XSD datatypes: lattice, lexical validity, canonical forms, equality of values. Python and Catalyst forms of each."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.terms import datatype_of, is_literal, language_of, let, lexical_form, make_literal, split_literal
from quadloom.vocab import OWL, RDF, RDFS, XSD

#: Fixed values (XSD 1.1 part 2): derived datatype -> base.
DERIVED = {
    "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "nonNegativeInteger": "integer", "positiveInteger": "nonNegativeInteger",
    "long": "integer", "int": "long", "short": "int", "byte": "short",
    "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort",
    "integer": "decimal", "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NCName": "Name", "NMTOKEN": "token", "dateTimeStamp": "dateTime",
}
#: Bounds of the integer types.
BOUNDS = {
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65_535), "unsignedByte": (0, 255),
}
#: Lexical spaces.
PATTERNS = {
    "integer": r"[+-]?[0-9]+", "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", "double": r"([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)",
    "boolean": r"(true|false|0|1)", "hexBinary": r"([0-9A-Fa-f]{2})*", "base64Binary": r"([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "dateTime": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?",
    "dateTimeStamp": r".*(Z|[+-][0-9]{2}:[0-9]{2})", "normalizedString": r"[^\r\n\t]*", "token": r"([^\s]+( [^\s]+)*)?",
    "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*", "Name": r"[A-Za-z_:][A-Za-z0-9._:-]*", "NCName": r"[A-Za-z_][A-Za-z0-9._-]*", "NMTOKEN": r"[A-Za-z0-9._:-]+",
}
INTEGERS = {"integer", *BOUNDS}
NUMERIC = {"decimal", "float", "double", *INTEGERS}
DECLARED = sorted({*DERIVED, "decimal", "string", "boolean", "float", "double", "hexBinary", "base64Binary", "dateTime", "anyURI"})
NUMERIC_KEYS = sorted(XSD[n] for n in NUMERIC)


def short(datatype: str) -> str:
    return datatype[len(XSD) + 1 : -1] if datatype.startswith(f"<{XSD}") else ""


def ancestors(name: str) -> list[str]:
    out = [name]
    while out[-1] in DERIVED:
        out.append(DERIVED[out[-1]])
    return out


def subtypes() -> list[tuple[str, str]]:
    """(datatype, itself or one that holds its values) of all declared datatypes."""
    return [(XSD[n], XSD[a]) for n in DECLARED for a in ancestors(n)]


# --- Python ---------------------------------------------------------------------------------------------------------


def valid(lexical: str, datatype: str) -> bool:
    """Unknown datatypes have no invalid literals."""
    name = short(datatype)
    above = ancestors(name) if name else []
    patterns = [PATTERNS.get("double" if a == "float" else a) for a in above]
    if not all(re.fullmatch(x, lexical, re.S) for x in patterns if x):
        return False
    bounds = [BOUNDS[a] for a in above if a in BOUNDS]
    return all((low is None or int(lexical) >= low) and (high is None or int(lexical) <= high) for low, high in bounds)


def value(key: str):
    """A hashable stand-in for the literal's value: equal exactly when the values are; None if it has none we know."""
    parts = split_literal(key)
    if parts is None:
        return None
    lexical, datatype, lang = parts
    if lang:
        return "lang", lexical, lang
    name = short(datatype)
    if not name or not valid(lexical, datatype):
        return None if name else ("term", key)
    if name in INTEGERS or name == "decimal":
        return "decimal", str(Decimal(lexical).normalize() + 0)
    if name in ("float", "double"):
        return name, java_double(float(lexical.replace("INF", "inf")))
    if name == "boolean":
        return "boolean", lexical in ("true", "1")
    if name == "hexBinary":
        return "hex", lexical.upper()
    if name in ("dateTime", "dateTimeStamp"):
        return "dateTime", lexical
    if name in ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN"):
        return "string", lexical
    return "term", key


def java_double(x: float) -> str:
    """As the JVM prints a double: 1.0, 1.5E-7, NaN, Infinity."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(float(x)) if "e" not in repr(float(x)) else f"{Decimal(repr(float(x))):f}"
    sign, digits, exponent = Decimal(repr(float(x))).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    return f"{'-' if sign else ''}{text[0]}.{text[1:] or '0'}E{exponent + len(digits) - 1}"


def number(key: str) -> float | int | None:
    parts = split_literal(key) if key[:1] == '"' else None
    if not parts or short(parts[1]) not in NUMERIC or not valid(parts[0], parts[1]):
        return None
    return int(parts[0]) if short(parts[1]) in INTEGERS else float(parts[0].replace("INF", "inf"))


def number_literal(x: float | int, inputs: list[str]) -> str:
    """The result of arithmetic: an integer if all inputs are, a double if one is, else a decimal."""
    names = [short(split_literal(k)[1]) for k in inputs]
    if all(n in INTEGERS for n in names) and float(x).is_integer():
        return f'"{int(x)}"^^{XSD.integer}'
    return f'"{java_double(float(x))}"^^{XSD.double if any(n in ("double", "float") for n in names) else XSD.decimal}'


# --- columns --------------------------------------------------------------------------------------------------------


def numeric_value(c: Column) -> Column:
    """Double of a well-formed numeric literal, null for other terms."""
    lexical = lexical_form(c)
    known = datatype_of(c).isin(NUMERIC_KEYS)
    special = F.when(lexical == "INF", F.lit("Infinity")).when(lexical == "-INF", F.lit("-Infinity")).otherwise(lexical)
    return F.when(known & lexical.rlike(f"^(?:{PATTERNS['double']})$"), special.try_cast("double"))


def is_integer(c: Column) -> Column:
    return datatype_of(c).isin([XSD[n] for n in sorted(INTEGERS)])


def is_double(c: Column) -> Column:
    return datatype_of(c).isin(XSD.double, XSD.float)


def number_column(x: Column, inputs: list[Column]) -> Column:
    """number_literal for columns."""
    whole, floating = F.lit(True), F.lit(False)
    for c in inputs:
        whole, floating = whole & is_integer(c), floating | is_double(c)
    as_integer = make_literal(x.cast("decimal(38,0)").cast("string"), XSD.integer)
    typed = F.when(floating, F.lit(XSD.double)).otherwise(F.lit(XSD.decimal))
    return F.when(whole & (x == F.floor(x)), as_integer).otherwise(make_literal(x.cast("string"), typed))


def valid_column(lexical: Column, datatype: Column) -> Column:
    """Whether the lexical form belongs to the datatype; true for datatypes that aren't known."""
    return let([lexical, datatype], _valid)


def _valid(lexical: Column, datatype: Column) -> Column:
    out = F.lit(True)
    for name in DECLARED:
        ok = F.lit(True)
        for a in ancestors(name):
            pattern = PATTERNS.get("double" if a == "float" else a)
            if pattern:
                ok = ok & lexical.rlike(f"(?s)^(?:{pattern})\\z")
            low, high = BOUNDS.get(a, (None, None))
            n = lexical.try_cast("decimal(38,0)")
            if low is not None:
                ok = ok & F.coalesce(n >= F.lit(str(low)).cast("decimal(38,0)"), F.lit(False))
            if high is not None:
                ok = ok & F.coalesce(n <= F.lit(str(high)).cast("decimal(38,0)"), F.lit(False))
        out = F.when(datatype == XSD[name], ok).otherwise(out)
    return out


def value_key(c: Column) -> Column:
    """A string that two literals share exactly when their values are equal; null for ill-formed ones and other terms."""
    return let([c, lexical_form(c), datatype_of(c), language_of(c)], _value_key)


def _value_key(c: Column, lexical: Column, datatype: Column, language: Column) -> Column:
    family = lambda names: datatype.isin([XSD[n] for n in sorted(names)])
    trimmed = F.regexp_replace(F.regexp_replace(lexical, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    fraction = F.when(trimmed.contains("."), F.regexp_replace(F.regexp_replace(trimmed, r"0+$", ""), r"\.$", "")).otherwise(trimmed)
    decimal = F.regexp_replace(F.regexp_replace(fraction, r"^(-?)\.", "$10."), r"^-0$", "0")
    out = (
        F.when(language.isNotNull(), F.concat(F.lit("l"), language, F.lit(" "), lexical))
        .when(family(INTEGERS | {"decimal"}), F.concat(F.lit("n"), F.when(decimal == "", F.lit("0")).otherwise(decimal)))
        .when(datatype == XSD.double, F.concat(F.lit("d"), numeric_value(c).cast("string")))
        .when(datatype == XSD.float, F.concat(F.lit("f"), numeric_value(c).cast("float").cast("string")))
        .when(datatype == XSD.boolean, F.concat(F.lit("b"), lexical.isin("true", "1").cast("string")))
        .when(datatype == XSD.hexBinary, F.concat(F.lit("h"), F.upper(lexical)))
        .when(family({"dateTime", "dateTimeStamp"}), F.concat(F.lit("t"), F.coalesce(F.try_to_timestamp(lexical).cast("string"), lexical)))
        .when(family({"string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN"}), F.concat(F.lit("s"), lexical))
        .otherwise(F.concat(F.lit("x"), c))
    )
    return F.when(is_literal(c) & _valid(lexical, datatype), out)


def canonical(c: Column) -> Column:
    """The literal in canonical form: numbers without needless signs and zeros, booleans as words, hex in capitals."""
    return let([c, value_key(c), datatype_of(c)], _canonical)


def _canonical(c: Column, key: Column, datatype: Column) -> Column:
    body = F.substring(key, F.lit(2), F.length(key))
    decimal = F.when(datatype == XSD.decimal, F.when(body.contains("."), body).otherwise(F.concat(body, F.lit(".0")))).otherwise(body)
    return F.when(key.startswith("n"), make_literal(decimal, datatype)).when(key.startswith("b") | key.startswith("h"), make_literal(body, datatype)).when(key.startswith("d") | key.startswith("f"), make_literal(body, datatype)).when(key.isNotNull(), c)


AXIOMS = [(XSD[n], RDF.type_, RDFS.Datatype) for n in DECLARED] + [(OWL.Thing, RDF.type_, OWL["Class"]), (OWL.Nothing, RDF.type_, OWL["Class"])]
