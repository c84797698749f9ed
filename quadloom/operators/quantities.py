"""Quantities: literals like "36 km/h" and quantity nodes brought to one unit per kind; ratios to and from log scales.

One pass after the closure: results never feed the input, because statements of the output properties are no sources.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.datatypes import number, numeric_value
from quadloom.plans.fixpoint import MAX_BROADCAST_ROWS
from quadloom.plans.local import Index
from quadloom.terms import datatype_of, lexical_form, make_literal, skolem_iri, split_literal
from quadloom.vocab import CDT, GENID, LCDT, NORM, OWL, QUDT, SKOS, TYPE, UNIT, XSD

#: Kind of quantity -> canonical unit and its code.
PROFILES = {
    "acceleration": ("M-PER-SEC2", "m/s2"), "amountOfSubstance": ("MOL", "mol"), "angle": ("RAD", "rad"), "area": ("M2", "m2"), "catalyticActivity": ("KAT", "kat"),
    "dimensionless": ("UNITLESS", "1"), "electricCapacitance": ("FARAD", "F"), "electricCharge": ("C", "C"), "electricConductance": ("S", "S"), "electricConductivity": ("S-PER-M", "S.m-1"),
    "electricCurrent": ("A", "A"), "electricInductance": ("H", "H"), "electricPotential": ("V", "V"), "electricResistance": ("OHM", "Ohm"), "energy": ("J", "J"), "force": ("N", "N"),
    "frequency": ("HZ", "Hz"), "illuminance": ("LUX", "lx"), "length": ("M", "m"), "luminousFlux": ("LM", "lm"), "luminousIntensity": ("CD", "cd"), "magneticFlux": ("WB", "Wb"),
    "magneticFluxDensity": ("T", "T"), "mass": ("KiloGM", "kg"), "power": ("W", "W"), "pressure": ("PA", "Pa"), "radiationDoseAbsorbed": ("GRAY", "Gy"), "radiationDoseEffective": ("SV", "Sv"),
    "radioactivity": ("BQ", "Bq"), "solidAngle": ("SR", "sr"), "speed": ("M-PER-SEC", "m/s"), "temperature": ("K", "K"), "time": ("SEC", "s"), "volume": ("M3", "m3"),
}
#: Logarithmic unit -> base, multiplier of the exponent, convention.
LOGARITHMIC = {"B": (10.0, 1.0, "PowerRatio"), "DeciB": (10.0, 0.1, "PowerRatio"), "NP": (2.718281828459045, 1.0, "FieldRatio"), "OCT": (2.0, 1.0, "FrequencyRatio"), "DECADE": (10.0, 1.0, "FrequencyRatio"), "PH": (10.0, -1.0, "HydrogenIonActivity")}
#: Unit -> dimension, multiplier, offset, tokens. Used for units that the background doesn't describe.
UNITS = {
    "M": ("L", 1.0, 0.0, "m"), "CentiM": ("L", 0.01, 0.0, "cm"), "MilliM": ("L", 0.001, 0.0, "mm"), "KiloM": ("L", 1000.0, 0.0, "km"),
    "KiloGM": ("M", 1.0, 0.0, "kg"), "GM": ("M", 0.001, 0.0, "g"), "SEC": ("T", 1.0, 0.0, "s"), "MIN": ("T", 60.0, 0.0, "min"), "HR": ("T", 3600.0, 0.0, "h"),
    "M-PER-SEC": ("L/T", 1.0, 0.0, "m/s"), "KiloM-PER-HR": ("L/T", 0.2777777777777778, 0.0, "km/h km.h-1"), "MI-PER-HR": ("L/T", 0.44704, 0.0, "mi/h [mi_i].h-1"), "KN": ("L/T", 0.5144444444444445, 0.0, "kn [kn_i]"),
    "M-PER-SEC2": ("L/T2", 1.0, 0.0, "m/s2"), "M2": ("L2", 1.0, 0.0, "m2"), "CentiM2": ("L2", 0.0001, 0.0, "cm2"), "M3": ("L3", 1.0, 0.0, "m3"), "L": ("L3", 0.001, 0.0, "L"),
    "PA": ("M/LT2", 1.0, 0.0, "Pa"), "KiloPA": ("M/LT2", 1000.0, 0.0, "kPa"), "J": ("ML2/T2", 1.0, 0.0, "J"), "KiloJ": ("ML2/T2", 1000.0, 0.0, "kJ"), "W": ("ML2/T3", 1.0, 0.0, "W"), "KiloW": ("ML2/T3", 1000.0, 0.0, "kW"),
    "S-PER-M": ("conductivity", 1.0, 0.0, "S/m S.m-1"), "MicroS-PER-CentiM": ("conductivity", 0.0001, 0.0, "μS/cm uS.cm-1"),
    "K": ("temperature", 1.0, 0.0, "K"), "DEG_C": ("temperature", 1.0, 273.15, "°C Cel"), "DEG_F": ("temperature", 0.5555555555555556, 459.67, "°F [degF]"), "UNITLESS": ("1", 1.0, 0.0, "1"),
    "B": (None, None, None, "B"), "DeciB": (None, None, None, "dB"), "NP": (None, None, None, "Np"), "OCT": (None, None, None, "oct octave"), "DECADE": (None, None, None, "10*"), "PH": (None, None, None, "pH"),
}
OUTPUTS = [NORM.normalizedQuantity, NORM.normalizedUcumLiteral, NORM.normalizedCdtLiteral, NORM.normalizedLogarithmicQuantity, NORM.normalizedLogarithmicUcumLiteral, NORM.sourceLiteral, NORM.sourceQuantity]
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
UNIT_SCHEMA = "unit string, dimension string, multiplier double, offset double, base double, exponent double"


@dataclass
class Units:
    """rows of UNIT_SCHEMA, (token, unit) and (alias of a unit, unit), (property, profile): tables the size of a vocabulary."""

    rows: list[tuple]
    tokens: list[tuple[str, str]]
    aliases: list[tuple[str, str]]
    properties: list[tuple[str, str]]

    @staticmethod
    def from_background(index: Index) -> Units:
        get = lambda s, p: next((o for _, _, o in sorted(index.by_ps.get((p, s), ()))), None)
        value = lambda s, p: (lambda o: None if o is None else float(number(o)))(get(s, p))
        units: dict[str, tuple] = {UNIT[n]: (d, m, o) for n, (d, m, o, _) in UNITS.items()}
        tokens = {(t, UNIT[n]) for n, (_, _, _, text) in UNITS.items() for t in text.split()}
        described = {s for s, _, _ in index.by_p.get(QUDT.conversionMultiplier, ())}
        for s in described:
            units[s] = (get(s, QUDT.hasDimensionVector), value(s, QUDT.conversionMultiplier), value(s, QUDT.conversionOffset) or 0.0)
        # One vocabulary of dimensions: where the background names the dimension of a unit that we know, ours goes by that name.
        renamed = {UNITS[n][0]: units[UNIT[n]][0] for n in UNITS if UNIT[n] in described and UNITS[n][0]}
        units = {u: (renamed.get(d, d) if u not in described else d, m, o) for u, (d, m, o) in units.items()}
        logs = {UNIT[n] for n in LOGARITHMIC} | {s for s, _, _ in index.by_po.get((TYPE, QUDT.LogarithmicUnit), ())}
        for u in logs - set(units):
            units[u] = (None, None, None)
        for p in (QUDT.symbol, QUDT.expression, QUDT.ucumCode):
            tokens |= {(split_literal(o)[0], s) for s, _, o in index.by_p.get(p, ()) if split_literal(o)}
        aliases = {(u, u) for u in units}
        for p in (OWL.sameAs, SKOS.exactMatch):
            aliases |= {(s, o) for s, _, o in index.by_p.get(p, ()) if o in units and s != o}
        log = {UNIT[n]: (b, m) for n, (b, m, _) in LOGARITHMIC.items()}
        rows = [(u, *x, *log.get(u, (None, None))) for u, x in sorted(units.items(), key=lambda x: x[0])]
        resolved = {(t, target) for t, u in tokens for a, target in aliases if a == u}
        return Units(rows, sorted(resolved), sorted(aliases), sorted((s, o) for s, _, o in index.by_p.get(NORM.normalizationProfile, ())))


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    types = {"string": pa.string(), "double": pa.float64()}
    made = df.sparkSession.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], types[t]) for i, (n, t) in enumerate(fields)}))
    return F.broadcast(made) if len(rows) <= MAX_BROADCAST_ROWS else made


def parse_quantity(lexical: Column) -> tuple[Column, Column]:
    """(value, unit token) of "number unit"; null where the text isn't one."""
    fits = lexical.rlike(rf"(?s)^\s*{NUMBER}\s+(.+?)\s*$")
    value = F.regexp_extract(lexical, rf"^\s*({NUMBER})\s+", 1).try_cast("double")
    return F.when(fits, value), F.when(fits, F.regexp_extract(lexical, rf"(?s)^\s*{NUMBER}\s+(.+?)\s*$", 1))


def convert(value: Column, offset: Column, multiplier: Column, to_offset: Column, to_multiplier: Column) -> Column:
    """Affine conversion; the order of operations is part of the result."""
    return F.try_divide((value + offset) * multiplier, to_multiplier) - to_offset


def to_ratio(value: Column, base: Column, exponent: Column) -> Column:
    return F.pow(base, value * exponent)


def to_log(ratio: Column, base: Column, exponent: Column) -> Column:
    """Null for ratios that have no logarithm."""
    return F.when(ratio > 0, F.log(ratio) / F.log(base) / exponent)


def sources(facts: DataFrame, units: Units) -> DataFrame:
    """Quantities of the statements: msg_id, focus, property, source, is_node, datatype, value and the columns of the unit."""
    usable = facts.where(~F.col("p").isin(OUTPUTS))
    datatype = datatype_of(F.col("o"))
    value, token = parse_quantity(lexical_form(F.col("o")))
    literals = usable.where(F.col("o").startswith('"') & (datatype.startswith(f"<{CDT}") | datatype.startswith(f"<{LCDT}")))
    literals = literals.select("msg_id", F.col("s").alias("focus"), F.col("p").alias("property"), F.col("o").alias("source"), F.lit(False).alias("is_node"), datatype.alias("datatype"), value.alias("value"), token.alias("token"))
    literals = literals.join(_table(facts, units.tokens, "token string, unit string"), "token").drop("token")
    numbers = facts.where(F.col("p") == QUDT.numericValue).select("msg_id", F.col("s").alias("source"), numeric_value(F.col("o")).alias("value"))
    named = facts.where(F.col("p") == QUDT.unit).select("msg_id", F.col("s").alias("source"), F.col("o").alias("alias"))
    named = named.join(_table(facts, units.aliases, "alias string, unit string"), "alias").drop("alias")
    nodes = usable.select("msg_id", F.col("s").alias("focus"), F.col("p").alias("property"), F.col("o").alias("source")).join(numbers, ["msg_id", "source"]).join(named, ["msg_id", "source"])
    nodes = nodes.select("msg_id", "focus", "property", "source", F.lit(True).alias("is_node"), F.lit(None).cast("string").alias("datatype"), "value", "unit")
    met = literals.unionByName(nodes).where(F.col("value").isNotNull())
    return met.join(_table(facts, units.rows, UNIT_SCHEMA), "unit")


def present(facts: DataFrame, available: set | None) -> bool:
    """Whether there is anything to normalise; looks for one literal only where no quantity node can be."""
    if available is None or any(p in (QUDT.numericValue, NORM.targetLogarithmicUnit) for p, _ in available):
        return True
    return not facts.where(F.col("o").startswith('"') & (F.col("o").contains(f"^^<{CDT}") | F.col("o").contains(f"^^<{LCDT}"))).isEmpty()


def targets(units: Units) -> list[tuple]:
    """(profile, target, code, dimension, multiplier, offset) of the profiles whose unit is known."""
    known = {r[0]: r for r in units.rows}
    return [(name, UNIT[u], code, *known[UNIT[u]][1:4]) for name, (u, code) in PROFILES.items() if UNIT[u] in known]


def normalise(facts: DataFrame, units: Units) -> DataFrame | None:
    """Statements of all normalised quantities.

    A literal of a specific datatype goes to the unit of its kind if the dimensions agree; a generic one, or a quantity
    node, to that of the profile of its property, else of its dimension. Logarithmic ones become ratios; a ratio whose
    focus names a target logarithmic unit becomes a value on that scale. What can't be read or converted gives nothing.
    """
    found = sources(facts, units)
    goal = _table(facts, targets(units), "profile string, target string, code string, t_dimension string, t_multiplier double, t_offset double")
    specific = F.regexp_extract("datatype", r"[/#]([^/#>]+)>$", 1)
    generic = F.col("datatype").isin(CDT.ucum, LCDT.ucum)
    # A local name of the datatype that differs from the profile's (time is also called duration) has no profile.
    explicit = _table(facts, [(p, o[1:-1].rpartition(":")[2].removesuffix("Profile")) for p, o in units.properties], "property string, wanted string")
    wanted = F.when(F.col("datatype").isNotNull() & ~generic, specific).when(F.col("is_node"), F.concat(F.lower(F.substring("wanted", 1, 1)), F.expr("substring(wanted, 2)")))
    linear = found.where(F.col("multiplier").isNotNull()).join(explicit, "property", "left").withColumn("kind", wanted)
    met = linear.join(goal, F.col("dimension") == F.col("t_dimension")).where(F.col("kind").isNull() | (F.col("kind") == F.col("profile")))
    value = convert(F.col("value"), F.col("offset"), F.col("multiplier"), F.col("t_offset"), F.col("t_multiplier"))
    made = met.withColumn("result", value)
    ratios = found.where(F.col("base").isNotNull() & (F.col("is_node") | generic | (specific == "dimensionless")))
    ratios = ratios.withColumn("result", to_ratio(F.col("value"), F.col("base"), F.col("exponent"))).withColumn("target", F.lit(UNIT.UNITLESS)).withColumn("code", F.lit("1")).withColumn("profile", F.lit("dimensionless"))
    keep = ["msg_id", "focus", "property", "source", "is_node", "result", "target", "code", "profile"]
    out = _statements(made.select(*keep).unionByName(ratios.select(*keep)), "normalized")
    asked = facts.where(F.col("p") == NORM.targetLogarithmicUnit).select("msg_id", F.col("s").alias("focus"), F.col("o").alias("alias"))
    codes = {}
    for token, u in units.tokens:
        codes.setdefault(u, token)
    logs = [(a, u, codes.get(u, ""), r[4], r[5]) for a, u in units.aliases for r in units.rows if r[0] == u and r[4] is not None]
    asked = asked.join(_table(facts, logs, "alias string, target string, code string, t_base double, t_exponent double"), "alias")
    plain = found.where((F.col("unit") == UNIT.UNITLESS) & (F.col("is_node") | generic | (specific == "dimensionless")))
    scaled = plain.join(asked, ["msg_id", "focus"]).withColumn("result", to_log(F.col("value"), F.col("t_base"), F.col("t_exponent"))).withColumn("profile", F.lit(None).cast("string"))
    return out.unionByName(_statements(scaled.select(*keep), "normalizedLogarithmic"))


def _statements(rows: DataFrame, prefix: str) -> DataFrame:
    link = NORM[f"{prefix}Quantity"]
    node = skolem_iri(GENID, [F.lit(link), F.col("focus"), F.col("property"), F.col("source"), F.col("target")])
    text = F.concat(F.col("result").cast("string"), F.lit(" "), F.col("code"))
    t = lambda s, p, o: F.struct(s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), o.alias("o"))
    focus, q = F.col("focus"), F.col("q")
    parts = [
        t(focus, link, q), t(focus, NORM[f"{prefix}UcumLiteral"], make_literal(text, CDT.ucum)),
        t(q, TYPE, F.lit(QUDT.QuantityValue)), t(q, QUDT.numericValue, make_literal(F.col("result").cast("string"), XSD.double)), t(q, QUDT.unit, F.col("target")),
        t(q, NORM.sourceProperty, F.col("property")), t(q, F.when(F.col("is_node"), F.lit(NORM.sourceQuantity)).otherwise(F.lit(NORM.sourceLiteral)), F.col("source")),
    ]
    if prefix == "normalized":
        parts.append(t(focus, NORM.normalizedCdtLiteral, make_literal(text, F.concat(F.lit(f"<{CDT}"), F.col("profile"), F.lit(">")))))
    made = rows.where(F.col("result").isNotNull() & ~F.isnan("result")).withColumn("q", node)
    return made.select("msg_id", F.explode(F.array(*parts)).alias("t")).select("msg_id", "t.s", "t.p", "t.o").distinct()


def unit_facts(facts: DataFrame) -> DataFrame:
    """Of a unit vocabulary, the statements that conversions need."""
    wanted = [QUDT.hasDimensionVector, QUDT.conversionMultiplier, QUDT.conversionOffset, QUDT.symbol, QUDT.expression, QUDT.ucumCode]
    is_unit = F.col("s").startswith(f"<{UNIT}")
    return facts.where(is_unit & (F.col("p").isin(wanted) | ((F.col("p") == TYPE) & (F.col("o") == QUDT.LogarithmicUnit))))


