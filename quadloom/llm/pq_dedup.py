"""Embedding near-dedup: coarse inverted lists, residual product codes, asymmetric table lookups, exact cosine rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import forest, hash_share, ship, starts_of, stored, whole_groups
from quadloom.llm.components import components
from quadloom.llm.lsm_dedup import spread_join

#: Vectors are compared length by length, with an index for each; more lengths are an error, never a partial result.
MOST_LENGTHS = 1000


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class ProductIndex:
    """Coarse centres of unit vectors and, for residuals, a codebook of each of `parts` subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 16, codes: int = 256, seed: int = 5, shelves: int = 1):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.parts = next(p for p in range(min(parts, self.dim), 0, -1) if self.dim % p == 0)
        self.width = self.dim // self.parts
        self.centres = k_means(sample, lists, 10, rng)
        cell = nearest(sample, self.centres)
        residual = sample - self.centres[cell]
        self.books = [k_means(residual[:, self._part(p)], codes, 6, rng) for p in range(self.parts)]
        # Neighbouring lists share a shelf; shelves hold about as many rows of the sample each.
        by = np.argsort(nearest(self.centres, k_means(self.centres, shelves, 6, rng)), kind="stable")
        filled = np.cumsum(np.bincount(cell, minlength=len(by))[by])
        self.shelf = np.zeros(len(by), np.int32)
        self.shelf[by] = np.minimum(np.maximum(filled - 1, 0) * shelves // max(1, len(sample)), shelves - 1)

    def _part(self, p: int) -> slice:
        return slice(p * self.width, (p + 1) * self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, distance of each vector from what its codes stand for)."""
        cell = nearest(x, self.centres)
        residual = x - self.centres[cell]
        codes = np.stack([nearest(residual[:, self._part(p)], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        rebuilt = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)
        return cell, codes, np.sqrt(((residual - rebuilt) ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Rows by cells: whether the bisecting plane of the cell's and the row's own cell's centre is within `radius` of the row.

        A vector of cell c is at least as near to c as to the cell of x, so it is beyond the bisecting plane of the two
        centres, and x is (d(x, c)^2 - d(x, own)^2) / (2 |c - own|) away from that plane: other cells hold none within the radius.
        """
        d = distances(x, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(distances(self.centres[own], self.centres))
        return d - d[np.arange(len(x)), own][:, None] <= 2 * apart * (radius + 1e-6) + 1e-9

    def rebuilt(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for. Its distance from a vector is the sum of the vector's table entries of the codes."""
        return self.centres[cell] + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)


def unit(values: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision and scaled to length 1; None: null, empty, zero, or with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in values:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = float(np.sqrt(x @ x)) if np.isfinite(x).all() else 0.0
            if not math.isfinite(norm) and np.isfinite(x).all() or 0 < norm < 1e-150:
                x = x / np.abs(x).max()
                norm = float(np.sqrt(x @ x))
            x = x / norm if norm > 0 and math.isfinite(norm) else None
        out.append(x)
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, vecs, dims = [], [], [], []
        for i, x in zip(batch.column(0).to_pylist(), unit(batch.column(1)), strict=True):
            if i is not None and x is not None:
                raw = x.tobytes()
                ids.append(i)
                keys.append(xxhash.xxh3_128_digest(raw))
                vecs.append(raw)
                dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], ["id", "key", "vec", "dim"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def near_dedup(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, sample_rows: int = 20_000, block: int = 16_384, shelves: int = 4) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is the threshold or more; n_links counts the other ids linked
    directly, those of equal vectors too; component_id is the smallest id reachable; kept: it is the row's own. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of different lengths.
    Rows that repeat an id count once. A null id isn't compared: component_id null, kept. An empty table gives no rows.

    The index (about 3 sqrt(rows) lists, 4096 at most; codebooks) is fitted on a sample of about sample_rows rows; every row
    is encoded. Probes are sufficient: a list is skipped only if geometry says that it can't hold a link, and a code only if
    its table distance exceeds the radius by more than its own, stored, error. What is left is reranked by the exact cosine,
    so no link is lost. Where vectors have no structure that lists can follow, most lists are probed and the work is
    quadratic. Neighbouring lists share a shelf, to which a query is sent once however many of its lists are probed, and
    only if the shelf comes after its own: each pair of shelves is compared once, for both sides. There are as many
    shelves as hold about `block` rows each, and `shelves` at least. Shelves and their queries are cut into blocks, so a
    list or a dense spot of any size is many tasks; blocks return link counts and a spanning forest, never the pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_prepared, "id long, key binary, vec binary, dim int"), "pq-rows")
    groups = stored(rows.select("id", "key").distinct().groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "pq-groups")
    reps = stored(rows.join(groups.select(F.col("rep").alias("id"), F.col("key").alias("k"), "copies"), "id").where("k = key").select("id", "copies", "vec", "dim").dropDuplicates(["id"]), "pq-reps")
    lengths = reps.groupBy("dim").count().where("count > 1").limit(MOST_LENGTHS + 1).collect()  # a length of one vector has no links
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    dims = {r["dim"]: r["count"] for r in lengths}
    found = None
    for dim, n in sorted(dims.items()):
        links = _links(reps.where(F.col("dim") == dim), dim, n, threshold, lists or max(1, min(4096, round(3 * math.sqrt(n)))), sample_rows, block, shelves)
        found = links if found is None else found.unionByName(links)
    links = stored(found if found is not None else spark.createDataFrame([], "a long, b long, links long"), "pq-links")
    classes = components(links.select("a", "b")).select(F.col("node").alias("rep"), "component_id")
    counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per_key = groups.join(counted, "rep", "left").join(classes, "rep", "left")
    per_key = stored(per_key.select("key", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "pq-classes")
    total = per_key.agg(F.sum("copies")).first()[0] or 0
    per_id = spread_join(rows.select("id", "key"), per_key, "key", "copies", total, F.xxhash64("id"))
    per_id = per_id.groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(per_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dim: int, n: int, threshold: float, lists: int, sample_rows: int, block: int, shelves: int) -> DataFrame:
    """Links among vectors of one length: rows (a, b: an edge of a forest or a itself, links)."""
    spark = reps.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = min(sample_rows, max(256, 4_000_000 // dim))
    sample = reps.where(hash_share(F.col("id"), F.lit("pq")) < min(1.0, rows / n)).select("id", "vec").toArrow().sort_by("id")
    if not sample.num_rows:
        sample = reps.select("id", "vec").orderBy("id").limit(256).toArrow()
    held = spark.sparkContext.broadcast(ProductIndex(_matrix(sample.column("vec"), dim), lists, shelves=min(lists, max(shelves, math.ceil(n / block)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column("vec"), dim)
                cell, codes, error = index.encode(x)
                probes = [np.unique(np.maximum(index.shelf[p], index.shelf[c])) for p, c in zip(index.probes(x, radius), cell, strict=True)]
                ends = np.cumsum([0, *map(len, probes)]).astype(np.int32)
                lists_ = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(probes)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), part.column("vec"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(index.shelf[cell]), lists_], ["id", "copies", "vec", "cell", "code", "error", "shelf", "probes"])

    coded = stored(reps.select("id", "copies", "vec").mapInArrow(encode, "id long, copies long, vec binary, cell int, code binary, error double, shelf int, probes array<int>"), "pq-codes")
    asked = coded.select("id", F.explode("probes").alias("shelf"))
    sizes = coded.groupBy("shelf").agg(F.count(F.lit(1)).alias("n_list")).join(asked.groupBy("shelf").agg(F.count(F.lit(1)).alias("n_asked")), "shelf")
    sizes = F.broadcast(stored(sizes.select("shelf", F.ceil(F.col("n_list") / block).cast("int").alias("l"), F.ceil(F.col("n_asked") / block).cast("int").alias("q")), "pq-sizes"))  # a row for each shelf, 4096 at most
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    listed = coded.join(sizes, "shelf").select("shelf", own("l").alias("lb"), every("q").alias("qb"), F.lit(0).alias("side"), "id", "copies", "vec", "cell", "code", "error")
    asking = coded.select("id", "copies", "vec", F.col("shelf").alias("home"), F.explode("probes").alias("shelf")).join(sizes, "shelf")
    asking = asking.select("shelf", every("l").alias("lb"), own("q").alias("qb"), F.when(F.col("home") == F.col("shelf"), 1).otherwise(2).alias("side"), "id", "copies", "vec", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    keys = ["shelf", "lb", "qb"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for table in whole_groups(batches, keys):
            starts = starts_of(table, keys)
            for begin, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
                got = _search_block(index, table.slice(begin, end - begin), dim, threshold, radius)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["a", "b", "links"])

    both = listed.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(search, "a long, b long, links long")


def _search_block(index: ProductIndex, part: pa.Table, dim: int, threshold: float, radius: float):
    """Listed rows (side 0) against asking ones of their own shelf (1) and of shelves before it (2)."""
    side = part.column("side").to_numpy()
    n = int((side == 0).sum())
    if not n or n == len(side):
        return None
    ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
    x = _matrix(part.column("vec"), dim)
    cells = part.column("cell").slice(0, n).to_numpy()
    codes = np.frombuffer(b"".join(part.column("code").slice(0, n).to_pylist()), np.uint8).reshape(n, -1)
    reach = (radius + part.column("error").slice(0, n).to_numpy() + 1e-3) ** 2
    by = np.argsort(cells, kind="stable")
    listed = [(cells[rows[0]], rows, index.rebuilt(cells[rows], codes[rows])) for rows in np.split(by, np.flatnonzero(np.diff(cells[by])) + 1)]
    links, a, b, held = np.zeros(len(ids), np.int64), [], [], 0
    for k in range(n, len(ids), 512):
        probed = index.probes(x[k : k + 512], radius)
        for cell, rows, rebuilt in listed:
            asking = np.flatnonzero(probed[:, cell]) + k
            if not len(asking):
                continue
            q, near = np.nonzero(distances(x[asking], rebuilt) <= reach[rows])
            q, near = asking[q], rows[near]
            other = ids[near] != ids[q]
            q, near = q[other], near[other]
            if not len(q):
                continue
            linked = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 32768]], x[near[i : i + 32768]]) for i in range(0, len(q), 32768)]) >= threshold
            q, near = q[linked], near[linked]
            np.add.at(links, q, copies[near])
            foreign = side[q] == 2  # the listed row won't ask in its turn
            np.add.at(links, near[foreign], copies[q[foreign]])
            a.append(q)
            b.append(near)
            held += len(q)
            if held > 4_000_000:  # what is linked so far as a forest: memory stays bounded where all are near
                b = [forest(len(ids), np.concatenate(a), np.concatenate(b))]
                a, held = [np.arange(len(ids))], len(ids)
    if not a:
        return None
    # The same id may be listed and asking: both stand for one node.
    _, node = np.unique(ids, return_inverse=True)
    first = np.zeros(node.max() + 1, np.int64)
    first[node[::-1]] = np.arange(len(ids))[::-1]
    label = forest(len(ids), first[node[np.concatenate(a)]], first[node[np.concatenate(b)]])
    target = label[first[node]]
    on = np.flatnonzero((links > 0) | ((target != first[node]) & (first[node] == np.arange(len(ids)))))
    return ids[on], ids[target[on]], links[on]
