"""N-gram Jaccard join: MinHash candidates pruned by the posterior of their similarity, survivors verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import WordCache, forest, fresh, ship, spread_lookup, starts_of, stored, texts_of, whole_groups
from quadloom.llm.components import components
from quadloom.llm.lsm_dedup import bit_filter, filter_bits, may_contain, spread_join

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
STEP = 32
_random = np.random.default_rng(20_240_229)
_A = (_random.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_cache() -> WordCache:
    return WordCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def shingles(text: str, cache: WordCache, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the whole text, lower case, words cut at white space.

    A text of one to n - 1 words is one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = _scatter(total * _MIX[0] + h[k : len(h) - size + k + 1])
    return np.unique(total)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima over random linear functions of the shingles' 32 low bits."""
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 2048):
        part = low[begin : begin + 2048]
        np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values (a multiple of STEP): the least matches with which a pair goes on.

    Values are compared by their low byte, so a pair of similarity s matches with chance s + (1 - s) / 256. With a uniform
    prior for that chance, its posterior after m matches is Beta(m + 1, n - m + 1), and the chance that it is at least t
    equals that of at most m successes among n + 1 trials of chance t.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions among the pairs (a, b) whose posterior stays at the tolerance or above, comparing STEP values at a time."""
    on = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        if not len(on):
            break
        part = sig[:, k * STEP : (k + 1) * STEP]
        matches = matches + (part[a[on]] == part[b[on]]).sum(1, dtype=np.int32)
        keep = matches >= m
        on, matches = on[keep], matches[keep]
    return on


def _linked(starts: np.ndarray, n: int, test, most: int = 1 << 17) -> np.ndarray:
    """Labels of rows 0..n-1 such that all pairs within a group of consecutive rows that pass the test have one label.

    Pairs are tested by growing distance, about `most` at a time, and not at all once their rows have one label: a group
    of near copies costs about as many tests as it has rows.
    """
    label = np.arange(n)
    end_of = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    rows, d, held, total = np.arange(n), 1, [], 0

    def settle() -> None:
        nonlocal label, rows, held, total
        a, b = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        on = test(a, b)
        if len(on):
            label = forest(n, np.concatenate([np.arange(n), a[on]]), np.concatenate([label, b[on]]))
            open_groups = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
            rows = rows[open_groups[group[rows]]]
        held, total = [], 0

    while True:
        rows = rows[rows + d < end_of[rows]]
        if not len(rows):
            break
        a = rows[label[rows] != label[rows + d]]
        if len(a):
            held.append((a, a + d))
            total += len(a)
        if held and (total >= most or d & (d - 1) == 0):
            settle()
        d += 1
    if held:
        settle()
    return label


def _signatures(table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)


def _share_edges(least: list[int]):
    """Rows (bucket, share, id, sig) sorted by bucket and share -> edges of a spanning forest of each share's surviving pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "share"]
        for table in whole_groups(batches, keys):
            ids, sig = table.column("id").to_numpy(), _signatures(table)
            label = _linked(starts_of(table, keys), len(ids), lambda a, b, sig=sig: surviving(sig, a, b, least))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return run


def _cross_edges(least: list[int]):
    """Rows (bucket, share_i, share_j, share, id, cluster, sig): surviving pairs across two shares of a bucket that aren't in one cluster yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "share_i", "share_j"]
        for table in whole_groups(batches, keys):
            starts = starts_of(table, keys)
            for begin, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(begin, end - begin)
                ids, share, sig = part.column("id").to_numpy(), part.column("share").to_numpy(), _signatures(part)
                label = np.unique(part.column("cluster").to_numpy(), return_inverse=True)[1]
                found_a, found_b = [], []
                left, right = np.flatnonzero(share == share[0]), np.flatnonzero(share != share[0])
                for i in left:
                    others = right[label[right] != label[i]]
                    others = others[surviving(sig, np.full(len(others), i), others, least)]
                    _, first = np.unique(label[others], return_index=True)
                    for j in others[first]:
                        found_a.append(ids[i])
                        found_b.append(ids[j])
                        label[label == label[j]] = label[i]
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def _pack(n: int):
    """cluster, id, text -> cluster, id, shingles: the text's set, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        for batch in batches:
            sets = [shingles(t, cache, n).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), pa.array(sets, pa.binary())], ["cluster", "id", "shingles"])

    return run


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, id, tiles, shingles, base -> cluster, id, tiles, size, base_size, gone (shingles of the base that are missing), diff (all that differ)."""
    for batch in batches:
        out = []
        for own, base in zip(batch.column("shingles").to_pylist(), batch.column("base").to_pylist(), strict=True):
            x, b = np.frombuffer(own, np.uint64), np.frombuffer(base, np.uint64)
            diff = np.setxor1d(x, b, assume_unique=True)
            # |x| = |b| - gone + added and |diff| = gone + added
            out.append((len(x), len(b), (len(diff) - len(x) + len(b)) // 2, diff.tobytes()))
        numbers = [pa.array([r[k] for r in out], pa.int32()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "id", "tiles")), *numbers, pa.array([r[3] for r in out], pa.binary())], ["cluster", "id", "tiles", "size", "base_size", "gone", "diff"])


def _tile_links(least: list[int], threshold: float):
    """Rows (cluster, tile_i, tile_j, tile, id, copies, ..., diff, sig) sorted by the first three -> per row and tile: links and forest edges.

    Tiles (i, i) compare all their rows; tiles (i, j) compare the rows of tile i with those of tile j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "tile_i", "tile_j"]
        for table in whole_groups(batches, keys):
            starts = starts_of(table, keys)
            for begin, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(begin, end - begin)
                if part.num_rows < 2:
                    continue
                ids, copies, tile = (part.column(c).to_numpy() for c in ("id", "copies", "tile"))
                across = part.column("tile_i")[0].as_py() != part.column("tile_j")[0].as_py()
                a, b = _verified(part, tile if across else None, least, threshold)
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                label = forest(len(ids), a, b)
                on = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[label[on]]), pa.array(links[on].astype(np.int64))], ["a", "b", "links"])

    return run


def _verified(part: pa.Table, tile: np.ndarray | None, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a Jaccard index of the threshold or more: pruned by the posterior, then counted exactly.

    With D the shingles in which a set differs from its cluster's base and g those of the base that it lacks, two sets
    share |base| - g1 - g2 + |D1 and D2| shingles.
    """
    sig = _signatures(part)
    size, base, gone = (part.column(c).to_numpy().astype(np.int64) for c in ("size", "base_size", "gone"))
    diffs = [np.frombuffer(d, np.uint64) for d in part.column("diff").to_pylist()]
    where = np.unique(np.concatenate(diffs), return_inverse=True)[1]
    ends = np.cumsum([len(d) for d in diffs])
    begins = ends - [len(d) for d in diffs]
    seen = np.zeros(int(where.max(initial=-1)) + 1, bool)
    rows = np.arange(len(size))
    found_a, found_b = [], []
    for i in rows[:-1]:
        others = rows[i + 1 :]
        if tile is not None:
            others = others[tile[others] != tile[i]]
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        others = others[low >= threshold * high]  # the index is at most the ratio of the sizes
        others = others[surviving(sig, np.full(len(others), i), others, least)]
        if not len(others):
            continue
        own = where[begins[i] : ends[i]]
        seen[own] = True
        for k in range(0, len(others), 512):
            some = others[k : k + 512]
            n = ends[some] - begins[some]
            upto = np.cumsum(n)
            at = np.repeat(begins[some] - (upto - n), n) + np.arange(n.sum())
            hits = np.concatenate([[0], np.cumsum(seen[where[at]], dtype=np.int64)])
            both = base[i] - gone[i] - gone[some] + hits[upto] - hits[upto - n]
            hit = some[both >= threshold * (size[i] + size[some] - both) - 1e-9]
            found_a.append(np.full(len(hit), i))
            found_b.append(hit)
        seen[own] = False
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _describe(n: int):
    """id, text -> id, set_key (128-bit hash of the shingle set), sig (low bytes), bands (hash of each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        powers = _scatter(np.arange(1, ROWS + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
        salt = np.arange(BANDS, dtype=np.uint64) * _MIX[2]
        for batch in batches:
            ids, keys, sigs, bands = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                s = shingles(text, cache, n)
                if i is None or not len(s):
                    continue
                full = signature(s)
                ids.append(i)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(full.astype(np.uint8).tobytes())
                bands.append(_scatter((full.reshape(BANDS, ROWS).astype(np.uint64) * powers).sum(1, dtype=np.uint64) + salt).view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), lists], ["id", "set_key", "sig", "bands"])

    return run


def jaccard_join(documents: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, share_rows: int = 1024, tile_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, class_id, n_links, kept.

    Two documents are linked if the Jaccard index of their sets of n-word shingles is at least the threshold; n_links counts
    the other documents linked directly, exact copies too; class_id is the smallest id reachable by links; kept: it is its
    own class. Null and empty texts have no shingles and link with nothing. Rows that repeat an id are one document. A row
    without an id isn't compared: class_id null, no links, kept. An empty table gives no rows; other columns are ignored.

    1. Each text gets a MinHash signature and BANDS bucket numbers; texts of equal shingle sets become one class row.
    2. In each bucket pairs are compared STEP values at a time and dropped when the posterior probability of reaching the
       threshold falls below the tolerance. What survives is returned as a spanning forest, so rows stay linear. Buckets
       are dealt in shares of about share_rows rows, by another hash in each, so that near copies meet in some bucket's
       share; pairs across two shares that aren't in one cluster by then are compared in the same way.
    3. The components of these edges hold every candidate pair. Each is compared whole: pruning once more, then the exact
       index. A set is shingled once and kept as its difference from the set of its cluster's smallest id; this and the
       signature are dealt in tiles of tile_rows rows, or of the root of the cluster's size where that is more, so a row
       is copied as often as that root at most. Tiles return link counts and a forest, never the pairs.
    """
    ship(documents.sparkSession)
    least = least_matches(threshold, tolerance)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    described = stored(docs.mapInArrow(_describe(n), "id long, set_key binary, sig binary, bands array<long>"), "jaccard-sigs")

    # Equal shingle sets: one representative each.
    groups = stored(described.select("id", "set_key").distinct().groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "jaccard-sets")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    reps = groups.select(F.col("rep").alias("id"), "copies")
    one = stored(described.join(reps, "id").select("id", "copies", "sig", "bands"), "jaccard-reps")
    clusters = stored(_clusters(one, least, share_rows), "jaccard-clusters")
    links = stored(_links(docs, one, clusters, least, threshold, n, tile_rows), "jaccard-links")
    classes = components(links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per_set = groups.join(counted, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    per_set = stored(per_set.select("set_key", "copies", F.coalesce("component_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-classes")

    # Back to documents; a set that many documents share is never one task's.
    per_doc = spread_join(described.select("id", "set_key"), per_set, "set_key", "copies", total, F.xxhash64("id"))
    per_doc = per_doc.groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n_links").cast("long").alias("n_links"))
    out = docs.select(F.col("id").alias("doc_id")).join(per_doc.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def _clusters(one: DataFrame, least: list[int], share_rows: int) -> DataFrame:
    """(node, cluster) of all sets that survive a comparison with another in a bucket."""
    bands = one.select("id", F.explode("bands").alias("bucket"))
    shared = stored(bands.groupBy(F.col("bucket").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("rows", F.col("n")), "jaccard-buckets")
    rows = shared.agg(F.sum("n")).first()[0] or 0
    shares = F.ceil(F.col("rows") / share_rows).cast("int")
    members = spread_lookup(bands, "bucket", shared, "key", "n", rows).select("id", "bucket", shares.alias("shares"), F.pmod(F.xxhash64("id", "bucket"), shares).cast("int").alias("share"))
    members = stored(members, "jaccard-members")
    signed = members.join(one.select("id", "sig"), "id")
    dealt = signed.select("bucket", "share", "id", "sig").repartition("bucket", "share").sortWithinPartitions("bucket", "share")
    near = components(dealt.mapInArrow(_share_edges(least), "a long, b long"))

    # Buckets of several shares whose rows aren't all in one cluster.
    wide = signed.where("shares > 1").join(near, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("component_id", "id"))
    wide = stored(wide.select("bucket", "shares", "share", "id", "cluster", "sig"), "jaccard-wide")
    mixed = wide.groupBy(F.col("bucket").alias("key")).agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    mixed = stored(mixed, "jaccard-mixed")
    if mixed.isEmpty():
        return near.withColumnRenamed("component_id", "cluster")
    open_rows = spread_lookup(wide, "bucket", mixed, "key", "n", mixed.agg(F.sum("n")).first()[0])
    pairs = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).where("other <> share")
    keys = ["bucket", "share_i", "share_j"]
    pairs = pairs.select("bucket", F.least("share", "other").alias("share_i"), F.greatest("share", "other").alias("share_j"), "share", "id", "cluster", "sig")
    across = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cross_edges(least), "a long, b long")
    return components(near.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(across)).withColumnRenamed("component_id", "cluster")


def _links(docs: DataFrame, one: DataFrame, clusters: DataFrame, least: list[int], threshold: float, n: int, tile_rows: int) -> DataFrame:
    """Rows (a, b: an edge of a forest or a itself, links) of each tile of each cluster."""
    count = clusters.count()
    member = clusters.select(F.col("node").alias("id"), "cluster")
    bits = filter_bits(count)  # the filter spares texts outside clusters the shuffle
    few = may_contain(docs.where("id is not null"), "id", bit_filter(member, "id", bits), bits)
    packed = stored(few.join(member, "id").select("cluster", "id", "text").mapInArrow(_pack(n), "cluster long, id long, shingles binary"), "jaccard-packed")
    sizes = stored(packed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")), "jaccard-sizes")
    bases = packed.where("id = cluster").select(F.col("cluster").alias("key"), F.col("shingles").alias("base")).dropDuplicates(["key"])
    tiles = F.ceil(F.col("rows") / F.greatest(F.lit(float(tile_rows)), F.sqrt("rows"))).cast("int")
    bases = bases.join(sizes, F.col("key") == F.col("cluster")).select("key", "base", tiles.alias("tiles"), F.col("rows").alias("n"))
    # At most 100 base sets are broadcast.
    met = spread_lookup(packed, "cluster", stored(bases, "jaccard-bases"), "key", "n", count, most_hot=100)
    differing = met.select("cluster", "id", "tiles", "shingles", "base").mapInArrow(_differ, "cluster long, id long, tiles int, size int, base_size int, gone int, diff binary")
    dealt = differing.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).join(one.select("id", "copies", "sig"), "id")
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["cluster", "tile_i", "tile_j"]
    each = each.select("cluster", F.least("tile", "other").alias("tile_i"), F.greatest("tile", "other").alias("tile_j"), "tile", "id", "copies", "size", "base_size", "gone", "diff", "sig")
    return each.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tile_links(least, threshold), "a long, b long, links long")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents that jaccard_join keeps, with all their columns: one document of each class."""
    name = fresh(documents, "_kept_id")
    gone = jaccard_join(documents, **options).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col(options.get("id_col", "doc_id")) == F.col(name), "left_anti")
