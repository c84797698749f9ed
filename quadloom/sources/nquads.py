"""N-Quads and N-Triples as DataFrames: lines are parsed by column expressions on the executors, files written in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.terms import is_literal, lexical_form, make_literal
from quadloom.vocab import XSD

_NODE = r"(<[^<>\"{}|^`\\\s]*>|_:[^\s<>\"]+)"
_LITERAL = r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^(<[^<>\s]*>)|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
LINE = rf"^\s*{_NODE}\s+(<[^<>\s]*>)\s+(?:{_NODE}|{_LITERAL})\s*(?:{_NODE}\s*)?\.\s*(?:#.*)?$"


def unescape(c: Column) -> Column:
    """The escapes of N-Quads; numeric ones of the basic plane and beyond by decoding their code points."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")):
        c = F.replace(c, F.lit("\\" + code), F.lit(char))
    pieces = F.split(c, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")
    code = lambda x, n: F.decode(F.unhex(F.lpad(F.substring(x, 3, n), 8, "0")), "UTF-32")
    plain = F.transform(pieces, lambda x: F.when(x.startswith("\\u"), F.concat(code(x, 4), F.substring(x, 7, 1 << 30))).when(x.startswith("\\U"), F.concat(code(x, 8), F.substring(x, 11, 1 << 30))).otherwise(x))
    return F.replace(F.when(F.contains(c, F.lit("\\")), F.array_join(plain, "")).otherwise(c), F.lit("\x00"), F.lit("\\"))


def escape(c: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def parse_lines(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """s, p, o, g of each line; blank lines and comments are dropped, lines that can't be read have a null s."""
    v = F.col(line)
    part = lambda i: F.regexp_extract(v, LINE, i)
    lexical = unescape(part(4))
    literal = F.when(part(6) != "", F.concat(F.lit('"'), lexical, F.lit('"@'), F.lower(part(6)))).otherwise(make_literal(lexical, F.when(part(5) != "", part(5)).otherwise(F.lit(XSD.string))))
    ok = v.rlike(LINE)
    rows = lines.where(~v.rlike(r"^\s*(#.*)?$"))
    return rows.select(*(keep or []), F.when(ok, part(1)).alias("s"), F.when(ok, part(2)).alias("p"), F.when(ok, F.when(part(3) != "", part(3)).otherwise(literal)).alias("o"), F.when(ok & (part(7) != ""), part(7)).alias("g"))


def read_nquads(spark: SparkSession, path: str, msg_id: int = 0, strict: bool = True) -> DataFrame:
    """Statements of line files: msg_id, s, p, o, g. strict: a line that can't be read is an error when it is reached."""
    rows = parse_lines(spark.read.text(path))
    if strict:
        rows = rows.withColumn("s", F.coalesce("s", F.raise_error(F.lit("a line is no N-Quads statement")).cast("string")))
    else:
        rows = rows.where(F.col("s").isNotNull())
    return rows.select(F.lit(msg_id).cast("long").alias("msg_id"), "s", "p", "o", "g")


def read_message_table(messages: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """A table of messages, each an N-Quads text: the scalable form of a message log. Blank labels are the message's own."""
    lines = messages.select(F.col(id_col).cast("long").alias("msg_id"), F.explode(F.split(F.col(text_col), r"\r?\n")).alias("value"))
    rows = parse_lines(lines, keep=["msg_id"]).where(F.col("s").isNotNull())
    own = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:m"), F.col("msg_id").cast("string"), F.lit("_"), F.substring(c, 3, 1 << 30))).otherwise(F.col(c))
    return rows.select("msg_id", own("s").alias("s"), "p", own("o").alias("o"), "g")


def line_of(g: str | None = None) -> Column:
    """A statement as a line."""
    o = F.col("o")
    text = F.when(is_literal(o), F.concat(F.lit('"'), escape(lexical_form(o)), F.lit('"'), F.expr("substring(o, length(o) - locate('\"', reverse(o)) + 2)"))).otherwise(o)
    graph = F.when(F.col(g).isNotNull(), F.concat(F.lit(" "), F.col(g))).otherwise(F.lit("")) if g else F.lit("")
    return F.concat(F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), text, graph, F.lit(" ."))


def write_nquads(df: DataFrame, path: str) -> None:
    df.select(line_of("g" if "g" in df.columns else None).alias("value")).write.text(path)


def message_texts(df: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """msg_id, text: one N-Quads text per message, empty messages (ids of `messages`) included."""
    texts = df.select("msg_id", line_of().alias("line")).groupBy("msg_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    if messages is None:
        return texts
    return messages.select("msg_id").distinct().join(texts, "msg_id", "left").select("msg_id", F.coalesce("text", F.lit("")).alias("text"))


def message_log(texts: DataFrame) -> str:
    """The message log of a small result."""
    rows = texts.orderBy("msg_id").collect()
    return 'VERSION "1.2-messages"\n' + "MESSAGE\n".join(r.text + "\n" if r.text else "" for r in rows)
