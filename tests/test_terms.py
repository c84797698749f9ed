import pytest
from pyspark.sql import functions as F

from quadloom import terms as T
from quadloom.functions import datatypes as D
from quadloom.functions.builtins import REGISTRY
from quadloom.vocab import DT, MATH, STRING, XSD

LITERALS = [T.literal(x, XSD[t]) for t, xs in {
    "integer": ["1", "+01", "-0", "abc", "", "170141183460469231731687303715884105727"], "decimal": ["1.0", "1", ".5", "00.50", "-0.0", "1.", "x"], "double": ["1", "1.0e0", "INF", "NaN", "1e400x"], "float": ["1.5"],
    "boolean": ["true", "1", "yes"], "byte": ["127", "128"], "unsignedInt": ["-1", "4294967295"], "positiveInteger": ["0", "1"], "hexBinary": ["0aFF", "0AFF", "0"], "base64Binary": ["YQ==", "YQ="],
    "string": ["a\nb", 'q"q', ""], "token": ["a b", " a"], "language": ["en-GB", "1"], "NCName": ["a:b", "ab"], "dateTime": ["2020-01-01T00:00:00Z", "2020-13-01T00:00:00Z"], "date": ["anything"],
}.items() for x in xs] + ['"a"@en', '"a"@nl', "<urn:x>", "_:b", '"1"^^<urn:own>']


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(LITERALS)], "i int, t string").cache()


def column(frame, expression):
    return [r.v for r in frame.select("i", expression.alias("v")).orderBy("i").collect()]


def test_parts_agree(frame):
    parts = [T.split_literal(x) if x[0] == '"' else None for x in LITERALS]
    assert column(frame, T.lexical_form(F.col("t"))) == [p and p[0] for p in parts]
    assert column(frame, T.datatype_of(F.col("t"))) == [p and p[1] for p in parts]
    assert column(frame, T.language_of(F.col("t"))) == [p and p[2] for p in parts]


def test_validity_agrees(frame):
    for d in ("integer", "byte", "string", "token", "dateTime", "double", "unsignedInt", "date"):
        got = column(frame, REGISTRY[DT.validForDatatype].column(F.col("t"), F.lit(XSD[d])))
        assert got == [bool(x[0] == '"' and D.valid(T.split_literal(x)[0], XSD[d])) for x in LITERALS], d


def test_equal_values_agree(frame):
    keys, values = column(frame, D.value_key(F.col("t"))), [D.value(x) for x in LITERALS]
    for i, a in enumerate(LITERALS):
        assert (keys[i] is None) == (values[i] is None), a
        for j in range(i):
            if None not in (values[i], values[j]):
                assert (keys[i] == keys[j]) == (values[i] == values[j]), (a, LITERALS[j])


ARITHMETIC = [("sum", [T.literal("1", XSD.integer), T.literal("2", XSD.integer)]), ("product", [T.literal("1.5", XSD.decimal), T.literal("2", XSD.integer)]), ("quotient", [T.literal("1", XSD.integer), T.literal("0", XSD.integer)]),
              ("quotient", [T.literal("7", XSD.integer), T.literal("2", XSD.integer)]), ("difference", [T.literal("1e0", XSD.double), T.literal("2", XSD.integer)]), ("sum", [T.literal("x", XSD.integer), T.literal("2", XSD.integer)]), ("exponentiation", [T.literal("2", XSD.integer), T.literal("10", XSD.integer)])]


@pytest.mark.parametrize("name,args", ARITHMETIC)
def test_arithmetic_agrees(spark, name, args):
    b = REGISTRY[MATH[name]]
    df = spark.createDataFrame([tuple(args)], "a string, b string")
    assert df.select(b.column(F.col("a"), F.col("b")).alias("v")).first().v == b.local(*args)


@pytest.mark.parametrize("text,want", [("-1.5", "-1"), ("1.5", "2"), ("-2.5", "-2"), ("2.4", "2")])
def test_rounding_goes_up_at_halves(spark, text, want):
    b, key = REGISTRY[MATH.rounded], T.literal(text, XSD.decimal)
    assert b.local(key) == f'"{want}"^^{XSD.integer}' == spark.createDataFrame([(key,)], "a string").select(b.column(F.col("a")).alias("v")).first().v


def test_string_builtins_agree(spark):
    a, e = T.literal("32 cm"), T.literal("^([0-9]+) ")
    df = spark.createDataFrame([(a, e)], "a string, e string")
    for p in (STRING.scrape, STRING.concatenation):
        assert df.select(REGISTRY[p].column(F.col("a"), F.col("e")).alias("v")).first().v == REGISTRY[p].local(a, e)
    for p in (STRING.matches, STRING.notMatches, STRING.contains, STRING.startsWith):
        assert df.select(REGISTRY[p].column(F.col("a"), F.col("e")).alias("v")).first().v == bool(REGISTRY[p].local(a, e))
