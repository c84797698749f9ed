"""Exact dedup by a log-structured merge index of text digests. DataFrame functions only: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import fresh, new_folder, spread_lookup, stored

#: Filters take 16 bits a key, but no more than this: 16 MB, whatever the number of keys. A fuller filter excludes less.
MOST_BITS = 1 << 27
#: Beyond so many memtables they hold more rows instead, so that compactions stay few and large: a run is sorted by many tasks.
MOST_MEMTABLES = 4096


def spread_join(rows: DataFrame, index: DataFrame, key: str, rows_of: str, total: int, spread: Column, most_hot: int = 1000) -> DataFrame:
    """Left join of rows with index (unique key; rows_of: how many rows carry it) that no hot key can make uneven.

    Keys of more than total / most_hot rows are fewer than most_hot, so that part of the index is broadcast; all other
    keys are shuffled. A row whose key is null or hot goes to a partition by `spread` instead of by its key.
    """
    limit = max(1000, total // most_hot)
    values = [c for c in index.columns if c != key]
    hot = index.where(F.col(rows_of) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    cold = index.where(F.col(rows_of) <= limit).select(F.col(key).alias("_ck"), F.struct(*values).alias("_cv"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    met = met.withColumn("_jk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit(b"-"), spread.cast("string").cast("binary"))))
    met = met.join(cold, F.col("_jk") == F.col("_ck"), "left").withColumn("_v", F.coalesce("_hv", "_cv"))
    return met.select(*rows.columns, *(F.col("_v")[c].alias(c) for c in values))


def filter_bits(keys: int) -> int:
    return min(MOST_BITS, 1 << max(16, (16 * keys - 1).bit_length()))


def bit_filter(keys: DataFrame, key: str, bits: int, *by: str) -> DataFrame:
    """A filter over the keys (one for each value of `by`): (*by, bucket, bitmap), bits / 32768 rows of 4 kB at most, however many keys."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.groupBy(*by, F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap"))


def marked(rows: DataFrame, key: str, made: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a boolean: false if the filter excludes the key. The filter is broadcast: MOST_BITS at most."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    position = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_at", F.bitmap_bucket_number(bit)).join(F.broadcast(made), F.col("_at") == F.col("_bucket"), "left")
    return met.withColumn(name, F.coalesce(F.floor(byte / F.pow(F.lit(2.0), position % 8)) % 2 == 1, F.lit(False))).select(*(F.col(f"`{c}`") for c in rows.columns), name)


def may_contain(rows: DataFrame, key: str, made: DataFrame, bits: int) -> DataFrame:
    """Rows that the filter doesn't exclude."""
    return marked(rows, key, made, bits, "_may").where("_may").drop("_may")


class DigestIndex:
    """Log-structured merge index: digest -> smallest and largest id, and number of rows.

    `flush` deals rows to memtables of about memtable_rows rows; each becomes a run at level 0, sorted by digest, with a
    filter of its digests. When a level has `fanout` runs or more, `compact` merges them into one run of the next level:
    digests that no other run's filter may contain pass as they are, without a shuffle; of the others smallest identifiers
    are kept with the largest and the counts. Runs are immutable and written to the shared folder, so any task can be run
    again. Filters have the same number of bits in all runs of an index, so those of merged runs are or-ed.
    """

    def __init__(self, spark: SparkSession, expected_rows: int, fanout: int = 8, memtable_rows: int = 1 << 20):
        self.spark, self.fanout, self.memtable_rows = spark, fanout, memtable_rows
        self.bits, self.levels = filter_bits(expected_rows), [[]]

    def flush(self, rows: DataFrame, count: int) -> None:
        """rows (digest, id), `count` of them. Copies are merged before rows are sorted into their runs."""
        memtables = min(MOST_MEMTABLES, max(1, -(-count // self.memtable_rows)))
        held = rows.select(F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)).cast("int").alias("memtable"), "digest", "id")
        merged = held.groupBy("memtable", "digest").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.count(F.lit(1)).alias("n"))
        if memtables > 1:  # a run in few files, each a range of digests
            merged = merged.repartitionByRange("memtable", "digest")
        path = new_folder(self.spark, "lsm-runs")
        merged.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").parquet(path)
        written = self.spark.read.schema("digest binary, low_id long, high_id long, n long, memtable int").parquet(path)
        filters = stored(bit_filter(written, "digest", self.bits, "memtable"), "lsm-filters")
        self.levels[0] += [(f"{path}/memtable={m}", filters.where(F.col("memtable") == m).drop("memtable")) for m in range(memtables)]
        self.compact()

    def _read(self, path: str) -> DataFrame:
        store = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = store.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(store)  # a memtable may have got no rows
        reader = self.spark.read.schema("digest binary, low_id long, high_id long, n long")
        return reader.parquet(path) if there else self.spark.createDataFrame([], "digest binary, low_id long, high_id long, n long")

    def merged(self) -> DataFrame:
        """All levels as one: runs that aren't compacted are merged on reading."""
        return self._merge([r for level in self.levels for r in level])

    def _merge(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        if len(runs) == 1:
            return self._read(runs[0][0])
        probed = None
        for i, (path, _) in enumerate(runs):
            others = self._or([made for j, (_, made) in enumerate(runs) if j != i])
            part = marked(self._read(path), "digest", others, self.bits, "_may")
            probed = part if probed is None else probed.unionByName(part)
        again = probed.where("_may").groupBy("digest").agg(F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"), F.sum("n").alias("n"))
        return probed.where("not _may").drop("_may").unionByName(again)

    def _or(self, filters: list[DataFrame]) -> DataFrame:
        every = filters[0]
        for made in filters[1:]:
            every = every.unionByName(made)
        return every.groupBy("_bucket").agg(F.bitmap_or_agg("_bitmap").alias("_bitmap"))

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self.fanout:
                runs, self.levels[level] = self.levels[level][: self.fanout], self.levels[level][self.fanout :]
                path = new_folder(self.spark, f"lsm-level{level + 1}")
                self._merge(runs).sortWithinPartitions("digest").write.parquet(path)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append((path, stored(self._or([made for _, made in runs]), "lsm-filters")))
            level += 1


def exact_dedup(documents: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_rows: int = 1 << 20, fanout: int = 8) -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, so null and empty texts are one group. Of equal
    texts the row with the largest (or smallest) id is kept. Rows that repeat an id with the same text are one document:
    all of them carry that id, so all or none are kept, and each counts in group_size. A null id never wins over others;
    a group with null ids only has keep_id null and keeps them. An empty table gives no rows. Other columns are ignored.

    Steps: digests -> memtables, sorted runs with filters -> compacted index; then hits (digests of two rows or more,
    found with a filter that their number sizes) are verified byte by byte: per digest the different texts are counted,
    copies being merged before the shuffle. Should a digest stand for two texts, those rows are grouped anew by their
    bytes. digest_bytes below 32 is for testing that.
    """
    rows, groups, hits, total = _hits(documents, keep, id_col, text_col, digest_bytes, memtable_rows, fanout)
    broken = stored(hits.groupBy("digest").agg(F.count_distinct("text").alias("texts")).where("texts > 1").join(groups.select("digest"), "digest", "left_semi"), "lsm-broken")
    out = _decided(spread_join(rows.drop("text"), groups, "digest", "n", total, F.xxhash64("id", "sha")))
    if broken.isEmpty():
        return out
    again = rows.join(broken.select("digest"), "digest", "left_semi")
    by_text = again.groupBy("digest", "text").agg((F.min if keep == "smallest" else F.max)("id").alias("best"), F.count(F.lit(1)).alias("n"))
    verified = again.join(by_text, ["digest", "text"]).select("id", "sha", "digest", "best", "n")
    return out.join(rows.select(F.col("sha").alias("text_sha256"), "digest").join(broken.select("digest"), "digest", "left_semi").select("text_sha256").distinct(), "text_sha256", "left_anti").select(*out.columns).unionByName(_decided(verified))


def _hits(documents: DataFrame, keep: str, id_col: str, text_col: str, digest_bytes: int, memtable_rows: int, fanout: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows with digests, digests of two rows or more, rows that may have one of those, number of rows with one)."""
    body = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = body.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes))
    count = documents.count()
    index = DigestIndex(documents.sparkSession, count, fanout, memtable_rows)
    index.flush(rows.select("digest", "id"), count)
    groups = stored(index.merged().where("n > 1").select("digest", F.col("low_id" if keep == "smallest" else "high_id").alias("best"), "n"), "lsm-hits")
    found = groups.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    bits = filter_bits(found["groups"])
    return rows, groups, may_contain(rows.select("digest", "text"), "digest", bit_filter(groups, "digest", bits), bits), found["rows"] or 0


def _decided(rows: DataFrame) -> DataFrame:
    single = F.col("n").isNull()
    best = F.when(single, F.col("id")).otherwise(F.col("best"))
    return rows.select(F.col("id").alias("doc_id"), best.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("id") == best, F.col("id").isNull() & best.isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the row that exact_dedup keeps.

    Where several rows are kept by exact_dedup (repeated rows; a group whose ids are all null), one of them stays. Rows
    whose text has no copy, as a filter of the others' digests tells, aren't shuffled.
    """
    sha, may, again, low = (fresh(documents, c) for c in ("_sha", "_may", "_sha2", "_low"))
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    decided = stored(exact_dedup(documents, **options).where("group_size > 1").select("doc_id", "kept", "text_sha256", "group_size"), "lsm-decided")
    best = decided.where("kept").groupBy(F.col("text_sha256").alias(again)).agg(F.max("doc_id").alias(low), F.max("group_size").alias("n"))
    best = stored(best, "lsm-best")
    found = best.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    bits = filter_bits(found["groups"])
    rows = documents.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = marked(rows, sha, stored(bit_filter(best.withColumnRenamed(again, sha), sha, bits), "lsm-filter"), bits, may)
    copies = rows.where(F.col(may)).drop(may)
    single = copies.join(best.select(again), F.col(sha) == F.col(again), "left_anti")
    copied = spread_lookup(copies, sha, best, again, "n", found["rows"] or 0).where(F.col(id_col).cast("long").eqNullSafe(F.col(low))).drop(low)
    one = copied.dropDuplicates([sha])
    return rows.where(~F.col(may)).drop(may).unionByName(single).unionByName(one).drop(sha)


