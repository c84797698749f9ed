"""What leaves the engine: filters on derived statements (all of them column expressions) and report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.plans.fixpoint import solutions
from quadloom.terms import is_blank, is_iri, is_literal, skolem_iri
from quadloom.vocab import GENID, INC, INTERNAL, NORM, SAME_AS, SH, TYPE

REPORT = "msg_id long, id string, rule string, terms array<string>"


def unique(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["msg_id", "s", "p", "o"])


def is_internal(c: Column) -> Column:
    return c.startswith(f"<{INTERNAL}")


def is_generated(c: Column) -> Column:
    """An IRI minted by a rule."""
    return c.startswith(f"<{GENID}")


def emitted(df: DataFrame, mode: str = "application") -> DataFrame:
    """Internal predicates and reflexive sameAs never leave. In application mode neither do minted nodes (except those of
    normalised quantities and validation results), types that are blank nodes, and literal subjects."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    keep = ~is_internal(p) & ~((p == SAME_AS) & (s == o))
    if mode == "application":
        public = p.startswith(f"<{NORM}") | p.startswith("<http://qudt.org/schema/qudt/") | p.startswith(f"<{SH}") | ((p == TYPE) & (o.startswith("<http://qudt.org/schema/qudt/") | o.startswith(f"<{SH}")))
        minted = is_generated(s) | is_generated(o)
        keep = keep & (~minted | public) & ~((p == TYPE) & is_blank(o)) & ~is_literal(s)
    elif mode != "conformance":
        raise ValueError(f"output mode {mode!r} is neither 'application' nor 'conformance'")
    return df.where(keep)


def reports(facts: DataFrame, contradictions: list[tuple], lists: list[DataFrame] | None = None, mode: str = "application", scope: str = "") -> DataFrame:
    """contradictions: (variant, terms). Rows msg_id, id, rule, terms; one per different evidence.

    The id depends on rule and terms (and the scope of a store), so a report is the same row however often it is found.
    In application mode evidence that names a minted node is hidden.
    """
    out = []
    for variant, terms in contradictions:
        df = solutions(variant, [facts] * len(variant.data), facts, lists)
        values = [F.lit(t) if isinstance(t, str) else F.col(f"v_{t.name}") for t in terms]
        rule = INC[variant.name.split()[0]]
        out.append(df.select("msg_id", F.lit(rule).alias("rule"), F.array(*values).alias("terms")))
    if not out:
        return facts.sparkSession.createDataFrame([], REPORT)
    rows = reduce(DataFrame.unionByName, out).distinct()
    if mode == "application":
        rows = rows.where(~F.exists("terms", is_generated))
    return rows.select("msg_id", skolem_iri(GENID, [F.col("rule"), F.concat_ws("\x1f", "terms")], scope).alias("id"), "rule", "terms")


def report_statements(rows: DataFrame) -> DataFrame:
    """Reports as statements: type Inconsistency, rule, term1.. ; these are added after any output projection."""
    head = F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(INC.Inconsistency).alias("o")), F.struct(F.lit(INC.rule).alias("p"), F.col("rule").alias("o")))
    terms = F.transform("terms", lambda t, i: F.struct(F.concat(F.lit(f"<{INC}term"), (i + 1).cast("string"), F.lit(">")).alias("p"), t.alias("o")))
    return rows.select("msg_id", F.col("id").alias("s"), F.explode(F.concat(head, terms)).alias("t")).select("msg_id", "s", "t.p", "t.o")


def is_diagnostic(p: Column) -> Column:
    return p.startswith(f"<{INC}")


def grouped_reports(statements: DataFrame) -> DataFrame:
    """The inverse: report statements back to rows, terms in order."""
    rows = statements.where(is_diagnostic(F.col("p")) | ((F.col("p") == TYPE) & (F.col("o") == INC.Inconsistency)))
    number = F.regexp_extract("p", r"term(\d+)>$", 1).try_cast("int")
    return (
        rows.groupBy("msg_id", F.col("s").alias("id"))
        .agg(F.max(F.when(F.col("p") == INC.rule, F.col("o"))).alias("rule"), F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct(number.alias("n"), F.col("o").alias("t"))))).alias("x"))
        .select("msg_id", "id", "rule", F.transform("x", lambda e: e["t"]).alias("terms"))
    )


#: rule -> (sentence with {0}.. for the terms, evidence triples by term positions or constants).
_EXPLAINED = {
    "eq-diff1": ("{0} is said to be the same as and different from {1}", [(0, SAME_AS, 1)]),
    "eq-diff2": ("{1} and {2} are members of a list of different individuals, yet the same", [(1, SAME_AS, 2)]),
    "eq-diff3": ("{1} and {2} are members of a list of different individuals, yet the same", [(1, SAME_AS, 2)]),
    "prp-irp": ("{1} has the irreflexive property {0} with itself", [(1, 0, 1)]),
    "prp-asyp": ("the asymmetric property {0} holds between {1} and {2} both ways", [(1, 0, 2), (2, 0, 1)]),
    "prp-pdw": ("the disjoint properties {0} and {1} both hold between {2} and {3}", [(2, 0, 3), (2, 1, 3)]),
    "prp-adp": ("the disjoint properties {1} and {2} both hold between {3} and {4}", [(3, 1, 4), (3, 2, 4)]),
    "prp-npa1": ("{1} has the value {3} of {2}, which a negative assertion denies", [(1, 2, 3)]),
    "prp-npa2": ("{1} has the value {3} of {2}, which a negative assertion denies", [(1, 2, 3)]),
    "cls-nothing2": ("{0} is in the empty class", [(0, TYPE, "<http://www.w3.org/2002/07/owl#Nothing>")]),
    "cls-com": ("{2} is in a class and in its complement", [(2, TYPE, 0), (2, TYPE, 1)]),
    "cls-maxc1": ("{1} has a value of {2} although it may have none", [(1, TYPE, 0), (1, 2, 3)]),
    "cls-maxqc1": ("{1} has a value of {2} in {4} although it may have none", [(1, TYPE, 0), (1, 2, 3), (3, TYPE, 4)]),
    "cls-maxqc2": ("{1} has a value of {2} although it may have none", [(1, TYPE, 0), (1, 2, 3)]),
    "cls-maxqd1": ("{1} has a value of {2} of datatype {4} although it may have none", [(1, TYPE, 0), (1, 2, 3)]),
    "cax-dw": ("{2} is in the disjoint classes {0} and {1}", [(2, TYPE, 0), (2, TYPE, 1)]),
    "cax-adc": ("{3} is in the disjoint classes {1} and {2}", [(3, TYPE, 1), (3, TYPE, 2)]),
    "dt-not-type": ("{0} is no valid literal of {1}", []),
}


def explained(rows: DataFrame) -> DataFrame:
    """Reports with a sentence and the triples that show it."""
    said, shown = F.lit("a contradiction was derived"), F.array().cast("array<string>")
    term = lambda i: F.coalesce(F.try_element_at("terms", F.lit(i + 1)), F.lit("?"))
    for name, (sentence, triples) in _EXPLAINED.items():
        is_rule = F.col("rule") == INC[name]
        parts = []
        for k, piece in enumerate(sentence.replace("}", "{").split("{")):
            parts.append(term(int(piece)) if k % 2 else F.lit(piece))
        said = F.when(is_rule, F.concat(*parts)).otherwise(said)
        if triples:
            texts = [F.concat_ws(" ", *(term(x) if isinstance(x, int) else F.lit(x) for x in t), F.lit(".")) for t in triples]
            shown = F.when(is_rule, F.array(*texts)).otherwise(shown)
    return rows.withColumn("message", said).withColumn("evidence", shown)


def first_reports(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first reports with their sentences, by message, rule and terms: what a display shows."""
    return explained(rows.orderBy("msg_id", "rule", "terms", "id").limit(most))


def valid_statements(df: DataFrame) -> DataFrame:
    """Statements that RDF allows: subject an IRI or blank node, predicate an IRI, all terms there."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    return df.where(s.isNotNull() & o.isNotNull() & (is_iri(s) | is_blank(s)) & is_iri(p))


__all__ = ["emitted", "explained", "first_reports", "grouped_reports", "report_statements", "reports", "unique", "valid_statements"]
