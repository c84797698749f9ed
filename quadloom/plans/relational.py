"""Relational tables as statements: row -> subject <urn:t:table/key>, column -> predicate, foreign key -> object key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.terms import make_literal
from quadloom.vocab import XSD

BASE = "urn:t:"
#: table -> (key columns, {column: datatype or referenced table}).
TABLES = {
    "region": (["r_regionkey"], {"r_name": "string"}),
    "nation": (["n_nationkey"], {"n_name": "string", "n_regionkey": "region"}),
    "customer": (["c_custkey"], {"c_name": "string", "c_nationkey": "nation", "c_mktsegment": "string"}),
    "supplier": (["s_suppkey"], {"s_name": "string", "s_nationkey": "nation"}),
    "part": (["p_partkey"], {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer"}),
    "orders": (["o_orderkey"], {"o_custkey": "customer", "o_orderstatus": "string", "o_orderpriority": "string"}),
    "events": (["event_id"], {"user_id": "user", "event_type": "string"}),
}


def iri(table: str, *keys: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}{table}/"), F.concat_ws("-", *(k.cast("string") for k in keys)), F.lit(">"))


def predicate(column: str) -> str:
    return f"<{BASE}{column}>"


def statements(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None, msg: Column | None = None) -> DataFrame:
    """One scan of the table, of the wanted columns only; null values give no statement."""
    keys, kinds = TABLES[table]
    wanted = list(kinds if columns is None else columns)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    objects = []
    for c in wanted:
        kind = kinds[c]
        text = F.col(c).cast("string")
        value = make_literal(text, XSD[kind]) if kind in ("string", "integer") else iri(kind, F.col(c))
        objects.append(F.struct(F.lit(predicate(c)).alias("p"), value.alias("o")))
    msg = F.lit(0).cast("long") if msg is None else msg.cast("long")
    out = rows.select(msg.alias("msg_id"), iri(table, *(F.col(k) for k in keys)).alias("s"), F.explode(F.array(*objects)).alias("t"))
    return out.select("msg_id", "s", "t.p", "t.o").where(F.col("o").isNotNull())


def several(spark: SparkSession, sf_dir: str, wanted: dict[str, list[str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [statements(spark, sf_dir, t, c) for t, c in wanted.items()])
