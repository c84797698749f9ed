import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import bayes_join, lsm_dedup, pq_dedup, queries
from quadloom.llm.common import forest, held_out
from quadloom.llm.components import components


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_hand(documents, keep):
    groups = defaultdict(list)
    for r in documents:
        groups[r.text or ""].append(r.doc_id)
    best = {t: keep((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(repr((r.doc_id, best[r.text or ""], len(groups[r.text or ""]), r.doc_id == best[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest())) for r in documents)


@pytest.mark.parametrize("keep,digest_bytes", [("largest", 32), ("smallest", 32), ("largest", 0), ("smallest", 0)])
def test_exact_dedup_by_hand(documents, keep, digest_bytes):
    """digest_bytes 0: every text has one digest, so all hits fail the byte verification and are grouped by their bytes."""
    for options in ({}, {"memtable_rows": 2, "fanout": 3}):
        got = lsm_dedup.exact_dedup(documents, keep=keep, digest_bytes=digest_bytes, **options)
        assert sorted(repr(tuple(r)) for r in got.collect()) == by_hand(documents.collect(), max if keep == "largest" else min)


def test_exact_dedup_keeps_columns_and_empty_tables(documents, empty):
    kept = lsm_dedup.drop_copies(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8, 9]
    assert lsm_dedup.exact_dedup(empty).count() == 0 and lsm_dedup.drop_copies(empty).count() == 0


def test_drop_copies_goes_by_row(spark):
    """The copy that goes has an id that another text's row has too; groups of null ids and repeated rows leave one row."""
    rows = [(1, "a"), (2, "a"), (1, "b"), (None, "c"), (None, "c"), (3, "d"), (3, "d"), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = lsm_dedup.drop_copies(docs)
    assert got.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", "b"), ("2", "a"), ("3", "d"), ("4", "None"), ("None", "c")]


def test_index_merges_runs(spark):
    index = lsm_dedup.DigestIndex(spark, 100, fanout=3, memtable_rows=4)
    want = {}
    for k in range(4):
        rows = spark.range(k, 20, 2).select(F.sha2((F.col("id") % 7).cast("string").cast("binary"), 256).cast("binary").alias("digest"), "id")
        index.flush(rows, rows.count())
        for i in range(k, 20, 2):
            low, high, n = want.get(i % 7, (i, i, 0))
            want[i % 7] = min(low, i), max(high, i), n + 1
    assert sorted((r.low_id, r.high_id, r.n) for r in index.merged().collect()) == sorted(want.values())
    assert len(index.levels) > 1 and all(len(level) < 3 for level in index.levels)


def test_compaction_passes_what_no_other_run_has(spark):
    """Digests that other runs' filters exclude aren't merged: they are the same rows."""
    index = lsm_dedup.DigestIndex(spark, 400, fanout=2, memtable_rows=1000)
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("digest")
    for low, high in ((0, 200), (190, 390)):
        index.flush(spark.range(low, high).select(digest, "id"), high - low)
    got = {r.low_id: r.n for r in index.merged().collect()}
    assert len(index.levels) == 2 and got == {i: 2 if 190 <= i < 200 else 1 for i in range(390)}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("k"))
    some = keys.limit(300)
    bits = lsm_dedup.filter_bits(300)
    made = lsm_dedup.bit_filter(some, "k", bits)
    passed = lsm_dedup.may_contain(keys, "k", made, bits)
    assert passed.join(some, "k", "left_semi").count() == 300 and passed.count() < 400
    assert lsm_dedup.filter_bits(10**12) == lsm_dedup.MOST_BITS


def test_spread_join_with_a_hot_key(spark):
    data = spark.range(5000).select("id", F.when(F.col("id") < 3000, F.lit(b"h")).when(F.col("id") < 4000, F.col("id").cast("string").cast("binary")).alias("k"))
    index = data.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    out = lsm_dedup.spread_join(data, index, "k", "n", 4000, F.col("id"), most_hot=2)
    assert out.count() == 5000 and out.where("low is null").count() == 1000 and out.where("n = 3000 and low = 0").count() == 3000


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 400), (None, 3)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 40), rng.integers(0, 50, 40)
    label = list(range(50))
    for _ in range(50):
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert forest(50, a, b).tolist() == label


def jaccard_by_hand(documents, n=5, threshold=0.8):
    sets = {}
    for r in documents:
        w = (r.text or "").lower().split()
        s = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        if r.doc_id is not None:
            sets[r.doc_id] = s
    links = {a: [b for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])] for a in sets}
    out = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = (min(seen), len(links[a]), min(seen) == a)
    return out


def variants(spark, groups=12, copies=9, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((len(out), " ".join(text)))
    shared = " ".join(words[:30])
    out += [(len(out) + i, shared + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    return spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("tile_rows,share_rows", [(256, 1024), (3, 256), (4, 2)])
def test_jaccard_join_by_hand(spark, tile_rows, share_rows):
    docs = variants(spark)
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in bayes_join.jaccard_join(docs, tile_rows=tile_rows, share_rows=share_rows).collect()}
    assert got == jaccard_by_hand(docs.collect())


def test_jaccard_join_edges(documents, empty):
    got = rows(bayes_join.jaccard_join(documents))
    assert len(got) == 10 and {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got} == {(1, 1, 2, True), (2, 1, 2, False), (3, 1, 2, False), (4, 4, 0, True), (5, 5, 0, True), (6, 6, 0, True), (None, None, 0, True), (8, 8, 0, True), (9, 9, 0, True)}
    kept = bayes_join.one_of_each(documents)
    assert kept.columns == documents.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "8", "8", "9", "None"])
    assert bayes_join.jaccard_join(empty).count() == 0


def test_pruning_tolerance():
    least = bayes_join.least_matches(0.8, 1e-6)
    assert len(least) == bayes_join.HASHES // bayes_join.STEP and least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(bayes_join.STEP, 1000, bayes_join.STEP), strict=False))


def test_near_dedup_by_hand(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    v = [b + rng.normal(size=32) * s for b in base for s in (0, 0.05, 0.15, 0.3)]
    data = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(900, [float(x) for x in v[0]]), (901, None), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0, None] + [0.0] * 30), (905, [1.0]), (906, [2.0]), (907, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    df = df.unionByName(df.where("vec_id = 3")).unionByName(df.where("vec_id = 5").withColumn("vec_id", F.lit(None).cast("long")))
    m = np.array([x for _, x in data[: len(v) + 1]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    ids = [i for i, _ in data[: len(v) + 1]]
    links = {i: {ids[k] for k in np.flatnonzero(m @ m[j] >= 0.95) if k != j} for j, i in enumerate(ids)}
    links |= {905: {906}, 906: {905}}
    got = {r.vec_id: r for r in pq_dedup.near_dedup(df, block=16).collect()}
    assert pq_dedup.near_dedup(df).count() == len(data) + 2
    assert {i: r.n_links for i, r in got.items()} == {**{i: len(links.get(i, ())) for i, _ in data}, None: 0}
    for i, mates in links.items():
        assert all(got[x].component_id == got[i].component_id for x in mates) and got[i].kept == (got[i].component_id == i)
    assert pq_dedup.near_dedup(df.where("false")).count() == 0


def test_near_dedup_of_a_dense_group_of_low_rank(spark):
    """Lists split the group along its own two axes, so partners differ in just the directions that lead to other lists."""
    rng = np.random.default_rng(8)
    base, axes = rng.normal(size=64), np.linalg.qr(rng.normal(size=(64, 2)))[0]
    x = np.vstack([base / np.linalg.norm(base) + rng.uniform(-0.4, 0.4, (900, 2)) @ axes.T, rng.normal(size=(300, 64))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for options in ({}, {"block": 64}):
        got = {r.vec_id: r for r in pq_dedup.near_dedup(df, **options).collect()}
        assert [got[i].n_links for i in range(len(x))] == want.tolist()
        assert {got[i].component_id for i in range(900)} == {0}


def test_near_dedup_recall(spark):
    """Each link that brute force finds among all rows is found, those of the stated queries (ids divisible by 100) too."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    x = np.array(rows.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = dict(zip(rows.vec_id.tolist(), ((x @ x.T >= 0.95).sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in pq_dedup.near_dedup(table).collect()}
    assert sum(want.values()) > 0 and got == want and any(i % 100 == 0 for i in want)


def test_near_dedup_of_too_many_lengths(spark):
    """Lengths of a single vector don't count; more than the bound of the others is an error."""
    wide = [(n, [1.0] * n) for n in range(1, 1104)]
    df = spark.createDataFrame(wide + [(5000, [2.0] * 1050 + [3.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq_dedup.near_dedup(df).collect()}
    assert sorted(i for i, r in got.items() if r.n_links) == [1051, 5000] and got[5000].component_id == 1051
    twice = spark.createDataFrame(wide + [(6000 + n, [1.0] * (n - 1) + [2.0]) for n in range(2, 1104)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1000 different lengths"):
        pq_dedup.near_dedup(twice)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


def test_folds(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


@pytest.mark.parametrize("seed", range(30))
def test_forest_of_random_graphs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 200))
    a, b = rng.integers(0, n, n // 2 + 1), rng.integers(0, n, n // 2 + 1)
    want = np.arange(n)
    while True:
        before = want.copy()
        for x, y in zip(a, b, strict=True):
            want[x] = want[y] = min(want[x], want[y])
        if (want == before).all():
            break
    assert (forest(n, a, b) == want).all()
