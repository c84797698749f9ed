"""Streams of messages: stateless derivation per micro-batch, and a store against which messages reason in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadloom.engine import Engine
from quadloom.operators import emit, quantities, shape_plan
from quadloom.plans.rules import Atom, ListTerm, Rule
from quadloom.plans.compile import specialise
from quadloom.plans.storage import stored, work_folder
from quadloom.plans.timed import _joined, timed_fixpoint
from quadloom.terms import COLUMNS
from quadloom.vocab import INC, TYPE


class FactStore:
    """A named store of facts: Parquet parts under path/name, each with the time of its facts.

    clear: start empty. A part is written whole before the next message batch is read, so a run that was cut off can be
    repeated: parts are named by batch, and writing one again replaces it.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, clear: bool = False):
        self.spark, self.name, self.folder = spark, name, f"{path.rstrip('/')}/{name}"
        if clear:
            self.clear()

    @classmethod
    def temporary(cls, spark: SparkSession, name: str) -> FactStore:
        """A store of this session only, in its working folder."""
        return cls(spark, name, f"{work_folder(spark)}/quadloom/stores", clear=True)

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def clear(self) -> None:
        fs, where = self._fs()
        fs.delete(where, True)

    def facts(self) -> DataFrame:
        """s, p, o, t."""
        fs, where = self._fs()
        if not fs.exists(where):
            return self.spark.createDataFrame([], "s string, p string, o string, t long")
        return self.spark.read.schema("s string, p string, o string, t long").option("recursiveFileLookup", "true").parquet(self.folder)

    def write(self, facts: DataFrame, batch: str) -> None:
        facts.select("s", "p", "o", "t").write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")


def infer_with_store(engine: Engine, facts: DataFrame, store: FactStore, batch: str | None = None, diagnostics: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Messages in the order of msg_id against the store: each sees the store and all messages before it.

    Returns (statements that each message adds, reports). A fact that the store or an earlier message asserts or derives
    isn't emitted again; an empty message adds nothing. The whole batch is one fixpoint, not a loop over messages.
    """
    engine._need()
    facts = facts.select(*COLUMNS)
    if engine.shapes_in is not None:
        facts, _ = shape_plan.prune_input(facts, engine.shapes_in)
    before = stored(store.facts(), "store")  # read before this batch is added to it
    # What the store holds is older than any message.
    base = F.lit(-(1 << 62)).cast("long")
    timed = before.select("s", "p", "o", base.alias("t")).unionByName(facts.select("s", "p", "o", F.col("msg_id").alias("t")))
    timed = stored(timed, "timed-input")
    available = engine._available(timed)
    known = timed_fixpoint(timed, engine.compile(available), engine.lists())
    asserted = timed.groupBy("s", "p", "o").agg(F.min("t").alias("at"))
    new = known.join(asserted, ["s", "p", "o"], "left").where((F.col("t") > base) & (F.col("at").isNull() | (F.col("t") < F.col("at"))))
    derived = new.select(F.col("t").alias("msg_id"), "s", "p", "o")
    if engine.units is not None and quantities.present(timed, available):
        # Quantities are read where they stand: a message's own literals and nodes.
        made = quantities.normalise(known.select(F.col("t").alias("msg_id"), "s", "p", "o"), engine.units)
        derived = derived.unionByName(made.where(F.col("msg_id") > base))
    out = emit.emitted(emit.unique(derived), engine.mode)
    if engine.shapes_out is not None:
        out = shape_plan.project_output(out, engine.shapes_out)
    found = None
    if diagnostics:
        found = _timed_reports(engine, known, available, base, store.name)
        out = out.unionByName(emit.report_statements(found))
    out = stored(out, "store-output")
    if batch is None:
        last = facts.agg(F.max("msg_id")).first()[0]
        batch = str(last if last is not None else "empty")
    fresh = known.where(F.col("t") > base).join(before.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    store.write(fresh, batch)
    return out, found


def _timed_reports(engine: Engine, known: DataFrame, available, base, scope: str) -> DataFrame:
    more = engine._available(known)
    names = None if available is None or more is None else available | more
    wrapped = [Rule(rule.body, (Atom(TYPE, INC.rule, ListTerm(tuple(terms))),), rule.name) for rule, terms in engine.contradictions]
    parts = []
    for r in wrapped:
        for v in specialise([r], engine.background, names):
            met = _joined(v, [known] * len(v.data), known, engine.lists())
            terms = [F.lit(t) if isinstance(t, str) else F.col(f"v_{t.name}") for t in v.head[0].o.items]
            parts.append(met.select("msg_id", F.lit(INC[r.name.split()[0]]).alias("rule"), F.array(*terms).alias("terms")))
    if not parts:
        return engine.spark.createDataFrame([], emit.REPORT)
    rows = reduce(DataFrame.unionByName, parts).groupBy("rule", "terms").agg(F.min("msg_id").alias("msg_id")).where(F.col("msg_id") > base)
    if engine.mode == "application":
        rows = rows.where(~F.exists("terms", emit.is_generated))
    from quadloom.terms import skolem_iri
    from quadloom.vocab import GENID

    return stored(rows.select("msg_id", skolem_iri(GENID, [F.col("rule"), F.concat_ws("\x1f", "terms")], scope).alias("id"), "rule", "terms"), "reports")


def stream(engine: Engine, facts: DataFrame, output: str, checkpoint: str, store: FactStore | None = None, once: bool = True) -> StreamingQuery:
    """A streaming DataFrame of statements to derived statements under `output`, one folder per micro-batch.

    Without a store each message is derived alone (all of its statements must come in one micro-batch); with one, batches
    are processed in order and reason over all that came before. A batch that is repeated after a failure replaces its
    own output and its own part of the store.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = stored(batch.select(*COLUMNS), "stream-batch")
        made = engine.infer(rows) if store is None else infer_with_store(engine, rows, store, str(number))[0]
        made.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
