"""What literals entail by their values: types, equality, difference, canonical forms. Visible in conformance mode only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.datatypes import canonical, subtypes, valid_column, value_key
from quadloom.plans.fixpoint import small
from quadloom.terms import datatype_of, is_literal, language_of, lexical_form
from quadloom.vocab import DIFFERENT_FROM, INTERNAL, RDFS, SAME_AS, TYPE


def literals(facts: DataFrame) -> DataFrame:
    """Distinct literals of each message: msg_id, lit."""
    return facts.where(is_literal(F.col("o"))).select("msg_id", F.col("o").alias("lit")).distinct()


def typings(facts: DataFrame) -> DataFrame:
    """Well-formed literals are instances of their datatype, of all that hold its values, and of rdfs:Literal."""
    own = literals(facts).withColumn("d", datatype_of(F.col("lit")))
    good = own.where(language_of(F.col("lit")).isNotNull() | valid_column(lexical_form(F.col("lit")), F.col("d")))
    wider = small(facts.sparkSession, subtypes(), ["d", "c"])
    known = good.join(wider, "d").select("msg_id", "lit", "c")
    plain = good.select("msg_id", "lit", F.explode(F.array("d", F.lit(RDFS.Literal))).alias("c"))
    return known.unionByName(plain).distinct().select("msg_id", F.col("lit").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def equalities(facts: DataFrame) -> DataFrame:
    """Different literals of one value are the same; a join on the value, not a comparison of all pairs."""
    keyed = literals(facts).withColumn("k", value_key(F.col("lit"))).where("k is not null")
    pairs = keyed.alias("a").join(keyed.alias("b"), (F.col("a.msg_id") == F.col("b.msg_id")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.lit") != F.col("b.lit")))
    return pairs.select(F.col("a.msg_id").alias("msg_id"), F.col("a.lit").alias("s"), F.lit(SAME_AS).alias("p"), F.col("b.lit").alias("o"))


def differences(facts: DataFrame) -> DataFrame:
    """differentFrom for literals that are said to be the same although their values differ: the pairs that can matter.

    Over all pairs this would be quadratic and say nothing that isn't plain from the values.
    """
    said = facts.where((F.col("p") == SAME_AS) & is_literal(F.col("s")) & is_literal(F.col("o")))
    return said.where(value_key(F.col("s")) != value_key(F.col("o"))).select("msg_id", "s", F.lit(DIFFERENT_FROM).alias("p"), "o")


def canonical_forms(facts: DataFrame) -> DataFrame:
    """Internal statements that name each literal's canonical form."""
    form = canonical(F.col("lit"))
    return literals(facts).select("msg_id", F.col("lit").alias("s"), F.lit(INTERNAL.canonical).alias("p"), form.alias("o")).where("o is not null")


__all__ = ["canonical_forms", "differences", "equalities", "literals", "typings"]
