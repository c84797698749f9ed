"""What the operators of this subpackage share: shared storage, folds, samples, word hashes, grouped batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(found)
        _forget_at_exit(spark, found)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where).toString().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that it needn't be installed there."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(context, "_quadloom_shipped", False) or not root.is_dir():
        return
    bundle = Path(tempfile.mkdtemp(prefix="quadloom-code-")) / "quadloom_code.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(bundle))
    context._quadloom_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quadloom/{name}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage: written as Parquet to the shared folder and read again, so a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, stored; the tables that making it wrote to the shared folder are then deleted."""
    before = len(_written)
    out = stored(make(), name)
    for spark, path in _written[before:-1]:
        _delete(spark, path)
    _written[before:] = _written[-1:]
    return out


def spread_lookup(rows: DataFrame, column: str, table: DataFrame, key: str, count: str, total: int, most_hot: int = 1000) -> DataFrame:
    """Inner join of rows with a table by a key that is unique there; `count` says how many rows carry it.

    Keys of more than total / most_hot rows are fewer than most_hot: those are broadcast and their rows stay where they
    are. All other keys are shuffled. Rows whose key is null or not in the table go.
    """
    limit = max(1000, total // most_hot)
    met = F.col(column) == F.col(key)
    if total <= limit:  # no key can have more rows than there are
        return rows.join(table.drop(count), met).drop(key)
    hot, cold = table.where(F.col(count) > limit).drop(count), table.where(F.col(count) <= limit).drop(count)
    rare = rows.join(F.broadcast(hot.select(key)), met, "left_anti")
    return rows.join(F.broadcast(hot), met).unionByName(rare.join(cold, met)).drop(key)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_forget_all)
    _written.append((spark, path))


def _forget_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has ended: the cluster's own cleaning of its checkpoint folder is left
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def hash_share(*cols: Column) -> Column:
    """In [0, 1), the same on every run."""
    return F.pmod(F.xxhash64(*cols, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Training rows of documents with y and the share of each class among the training labels.

    Of each class about per_class rows at most, by a hash of the id. Held-out ids, null ids and labels other than 0 and 1
    are left out; an id that is labelled twice counts once, with the larger label. The sample's ids are broadcast: they
    are counted first, and beyond 4 x per_class rows (ids repeated on purpose) an ordinary join is used.
    """
    clean = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("y").alias("y"))
    )
    totals = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    total = sum(totals.values())
    if not total:
        return documents.select("doc_id", *(c for c in ("text", "n_chars") if c in documents.columns)).withColumn("y", F.lit(0)).where("false"), {}
    rate = F.when(F.col("y") == 1, min(1.0, per_class / totals.get(1, 1))).otherwise(min(1.0, per_class / totals.get(0, 1)))
    chosen = stored(clean.where(hash_share(F.col("_id")) < rate), "sample")
    if chosen.count() <= 4 * per_class:
        chosen = F.broadcast(chosen)
    keep = [c for c in ("doc_id", "text", "n_chars") if c in documents.columns]
    rows = documents.select(*keep).join(chosen, F.col("doc_id") == F.col("_id")).drop("_id")
    return rows, {y: n / total for y, n in totals.items()}


class WordCache(dict):
    """word -> number, computed once; emptied when it has grown to `most` words, so memory stays bounded."""

    def __init__(self, of: Callable[[str], int], most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(word)
        return value


def bucket_of(bits: int, salt: str = "") -> Callable[[str], int]:
    mask, low = (1 << bits) - 1, xxhash.xxh3_64_intdigest
    return lambda word: low((salt + word).encode("utf-8", "surrogatepass")) & mask


def in_slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to `most` or less, a larger row alone."""
    begin = total = 0
    end = 0
    for end, n in enumerate(sizes):
        if end > begin and total + n > most:
            yield begin, end
            begin, total = end, 0
        total += n
    if total or end >= begin:
        yield begin, end + 1


def texts_of(column) -> list[str]:
    """A pandas or Arrow column of texts as Python strings, null as ''."""
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column.tolist()
    return [x if isinstance(x, str) else "" for x in values]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by keys, cut so that no group of equal keys is divided between two tables."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = [batch.column(k)[0].as_py() for k in keys]
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        if rest and [rest[-1].column(k)[rest[-1].num_rows - 1].as_py() for k in keys] != first:
            yield pa.Table.from_batches(rest)
            rest = []
        if first == last:
            rest.append(batch)
            continue
        cut = starts_of(batch, keys)[-1]
        yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def starts_of(rows, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys; the keys are integers without nulls."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = rows.column(k).to_numpy(zero_copy_only=False) if isinstance(rows.column(k), pa.Array) else rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
