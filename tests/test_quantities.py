import math

import pytest

from quadloom.engine import Engine, statements
from quadloom.functions.datatypes import number
from quadloom.vocab import NORM, PREFIXES, QUDT, UNIT

HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + "@prefix : <urn:x:> .\n"
LINEAR = [("150 cm", "length", "M", 1.5), ("1500 g", "mass", "KiloGM", 1.5), ("2 min", "time", "SEC", 120), ("36 km/h", "speed", "M-PER-SEC", 10), ("25000 cm2", "area", "M2", 2.5), ("2 L", "volume", "M3", 0.002), ("101.325 kPa", "pressure", "PA", 101325),
          ("1.25 kJ", "energy", "J", 1250), ("2.5 kW", "power", "W", 2500), ("0 Cel", "temperature", "K", 273.15), ("32 [degF]", "temperature", "K", 273.15), ("10 mi/h", "ucum", "M-PER-SEC", 4.4704), ("3.23327E3 uS.cm-1", "ucum", "S-PER-M", 0.323327),
          ("-40 Cel", "temperature", "K", 233.15), (".5 cm", "length", "M", 0.005), ("  2.5 cm  ", "length", "M", 0.025), ("1 kn", "speed", "M-PER-SEC", 0.5144444444444445), ("2 B", "ucum", "UNITLESS", 100), ("20 dB", "ucum", "UNITLESS", 100),
          ("1 Np", "ucum", "UNITLESS", math.e), ("3 oct", "ucum", "UNITLESS", 8), ("2 10*", "ucum", "UNITLESS", 100), ("7 pH", "ucum", "UNITLESS", 1e-7)]
NOTHING = [("abc cm", "length"), ("1 furlongish", "length"), ("1", "length"), ("1 m", "time"), ("1 kg", "length"), ("1 kPa", "energy")]


@pytest.fixture(scope="module")
def made(spark):
    data = [f':l{i} :v "{t}"^^cdt:{d}.' for i, (t, d, _, _) in enumerate(LINEAR)] + [f':n{i} :v "{t}"^^cdt:{d}.' for i, (t, d) in enumerate(NOTHING)]
    data += [':old :v "2 kPa"^^lcdt:pressure.', ":q :v [ qudt:numericValue 10; qudt:unit unit:KN ].", ":local :v [ qudt:numericValue 3; qudt:unit :ownKnot ].", ':token :v "4 myknots"^^cdt:speed.',
             ":t :temperature [ qudt:numericValue 0; qudt:unit unit:DEG_C ].", ":bad :temperature [ qudt:numericValue 5; qudt:unit unit:SEC ].", ":none :v [ qudt:numericValue 12 ]."]
    for i, (ratio, unit) in enumerate([(100, "B"), (100, "DeciB"), (math.e, "NP"), (8, "OCT"), (100, "DECADE"), ("1e-7", "PH"), (0, "DeciB"), (-1, "OCT")]):
        data.append(f":r{i} :ratio [ qudt:numericValue {ratio}; qudt:unit unit:UNITLESS ]; norm:targetLogarithmicUnit unit:{unit}.")
    data.append(":wrong :ratio [ qudt:numericValue 1; qudt:unit unit:M ]; norm:targetLogarithmicUnit unit:DeciB.")
    background = HEAD + ':ownKnot skos:exactMatch unit:KN; qudt:symbol "myknots". :temperature norm:normalizationProfile norm:TemperatureProfile.'
    rows = [tuple(r)[1:] for r in Engine(spark).load(background).infer(statements(spark, HEAD + "\n".join(data))).collect()]

    def get(name, link=NORM.normalizedQuantity):
        q = [o for s, p, o in rows if s == f"<urn:x:{name}>" and p == link]
        return sorted((next(o for s, p, o in rows if s == x and p == QUDT.unit), number(next(o for s, p, o in rows if s == x and p == QUDT.numericValue))) for x in q)

    get.rows = rows
    return get


@pytest.mark.parametrize("i", range(len(LINEAR)))
def test_literals(made, i):
    _, _, unit, value = LINEAR[i]
    assert made(f"l{i}") == [(UNIT[unit], pytest.approx(value, rel=1e-9))]


@pytest.mark.parametrize("i", range(len(NOTHING)))
def test_no_result(made, i):
    assert made(f"n{i}") == []


def test_nodes_local_units_and_profiles(made):
    assert made("old") == [(UNIT.PA, 2000)] and made("q") == [(UNIT["M-PER-SEC"], pytest.approx(5.144444444444445))]
    assert made("local")[0][1] == pytest.approx(3 * 0.5144444444444445) and made("token")[0][1] == pytest.approx(4 * 0.5144444444444445)
    assert made("t") == [(UNIT.K, 273.15)] and made("bad") == [] and made("none") == []
    assert any(p == NORM.normalizedCdtLiteral and o.endswith("cdt/pressure>") for s, p, o in made.rows if s == "<urn:x:old>")


def test_ratios_to_scales(made):
    for i, value in enumerate([2, 20, 1, 3, 2, 7]):
        assert made(f"r{i}", NORM.normalizedLogarithmicQuantity)[0][1] == pytest.approx(value, rel=1e-8)
    for name in ("r6", "r7", "wrong"):
        assert made(name, NORM.normalizedLogarithmicQuantity) == []
