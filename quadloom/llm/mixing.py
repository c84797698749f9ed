"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import fresh, spread_lookup, stored

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[0-9!-/:-@\[-`{-~]"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text of letters, down to 0.1 for one of digits and punctuation only."""
    body = F.coalesce(text, F.lit(""))
    return 1.0 - 0.9 * F.regexp_count(body, F.lit(JUNK)) / F.greatest(F.length(body), F.lit(1))


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """sizes (source, source_size) -> with weight, target. Sources by code point, null last, weigh 1, 2, 3, repeating.

    Targets share the sum of all sizes by weight, none above max_repeats times its own size, the excess reshared by
    weight: target = min(max_repeats * size, level * weight), where the level is found in the order of size / weight.
    One row per source, so the ordered windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    w = w.withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(every))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward).cast("double"))
    w = w.withColumn("found", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(every)["l"])
    return w.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(documents: DataFrame, max_repeats: int = 3, weight: Column | None = None, boundary_rows: int = 200_000, max_sources: int = 100_000) -> DataFrame:
    """One row per row of documents: doc_id, size, source_size, target, taken.

    A source's target is met by complete epochs (every document once each) and then by a fractional selection: each
    document draws an exponential key divided by its quality weight (Efraimidis-Spirakis), and those of the least keys
    are taken, while their summed sizes come nearer to what is left of the target. Keys depend on the id only, so reruns
    agree. The prefix sum is made over 4096 buckets of the key; only a source's bucket in which the budget ends is sorted,
    and buckets of more than boundary_rows rows are divided again, so no task holds a source. A null text has size 0 and
    is taken 0 times; documents of size 0 too. A null source is a source. Rows without an id draw their keys by their
    texts. Ties in the key go by id and size; rows that repeat an id compete as documents, with one key. An empty table
    gives no rows; other columns are ignored. Up to max_sources sources are broadcast; of more than those, only sources
    with over a thousandth of all rows are, and the others are joined by a shuffle.
    """
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    sized = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), uniform.alias("u"), (quality_weight(F.col("text")) if weight is None else weight).alias("w"))
    rows = stored(sized.select("doc_id", "source", _key().alias("key"), "size", (1.0 - F.pow(F.col("u"), 1.0 / F.col("w"))).alias("r")), "mix-rows")
    sources = stored(rows.groupBy("source", "key").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), max_repeats).select(_key().alias("k"), "source_size", "target")
    targets = stored(targets.join(sources.select("key", "n_rows"), F.col("k") == F.col("key")).drop("key"), "mix-targets")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    total = rows.count()

    def at_source(table: DataFrame) -> DataFrame:
        """rows with what a table says about their source (k, n_rows)."""
        if small:
            return rows.join(F.broadcast(table.drop("n_rows")), F.col("key") == F.col("k")).drop("k")
        return spread_lookup(rows, "key", table, "k", "n_rows", total)

    small = targets.count() <= max_sources
    # Radix search for the key at which each source's budget ends: `base` words are below the bucket [low, low + width).
    width, level = 1.0 / BUCKETS, 1
    found = _boundary(at_source, targets.where("left > 0").select("k", "n_rows", "left", F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("base")), width)
    while level < 4 and (found.agg(F.max("n")).first()[0] or 0) > boundary_rows:
        width, level = width / BUCKETS, level + 1
        found = _boundary(at_source, found.drop("n"), width)

    plan = targets.join(found.select("k", "low", "base"), "k", "left")
    met = at_source(plan)
    # Which side of the bucket a row is on; a source that needs all of its rows has no boundary.
    at = F.floor(F.col("r") / width)
    mine = F.floor(F.col("low") / width + 0.5)
    met = met.withColumn("side", F.when(F.col("left") <= 0, 1).when(F.col("low").isNull(), -1).otherwise(F.signum(at - mine).cast("int")))
    inside = met.where("side = 0")
    order = Window.partitionBy("key").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("size").over(order) + F.col("base"))
    inside = inside.withColumn("extra", (F.col("upto") + F.col("upto") - F.col("size") <= 2 * F.col("left")).cast("int")).drop("upto")
    rest = met.where("side <> 0").withColumn("extra", (F.col("side") < 0).cast("int"))
    return rest.unionByName(inside).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken"))


def _key() -> Column:
    """A source's key in joins, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _boundary(at_source, spans: DataFrame, width: float) -> DataFrame:
    """spans (k, n_rows, left, low, base) -> the bucket of `width` in each span where the running sum of sizes reaches left."""
    spans = spans.withColumn("rows_of", F.col("n_rows")).withColumn("s", F.col("k"))
    met = at_source(spans).withColumn("b", (F.floor(F.col("r") / width) - F.floor(F.col("low") / width + 0.5)).cast("int")).where(F.col("b").between(0, BUCKETS - 1))
    sums = met.groupBy("s", "rows_of", "left", "low", "base", "b").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("sum").over(upto) + F.col("base"))
    hit = sums.where("upto >= left").groupBy("s", "rows_of", "left", "low").agg(F.min(F.struct("b", "upto", "sum", "n")).alias("x"))
    return stored(hit.select(F.col("s").alias("k"), F.col("rows_of").alias("n_rows"), "left", (F.col("low") + F.col("x.b") * F.lit(width)).alias("low"), (F.col("x.upto") - F.col("x.sum")).cast("long").alias("base"), F.col("x.n").alias("n")), "mix-ends")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken, with all columns; not taken ones go.

    A document's decisions are found again by its id and size, one of each, so ids are expected to be unique here; where
    an id repeats, its rows share the most that any of them was taken.
    """
    key, times = fresh(documents, "_mix_id"), fresh(documents, "_mix_times")
    taken = mix(documents, **options).where("taken > 0").groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(times)).withColumnRenamed("doc_id", key)
    met = documents.join(taken, documents["doc_id"].eqNullSafe(F.col(key))).drop(key)
    copy = fresh(documents, "_mix_copy")
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in documents.columns))
