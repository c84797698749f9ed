import hashlib
import re
from collections import defaultdict

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import fm_quality, queries
from tests.llm.test_texts import quality_by_hand, targets_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """Each stage on what the one before it kept, against brute force; the classifier by its labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    table = spark.read.parquet(f"{SF}/labels.parquet")
    labels = {r.doc_id: r.quality for r in table.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_copies", "near_copies", "mixture", "tokens"] and corpus_pipeline.ORACLE_SQL is None

    kept = stages["quality"](spark, docs, SF).cache()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == columns
    assert np.mean([i in ids for i, q in labels.items() if q == 1]) > 0.97
    fm = fm_quality.fit_quality(docs, table)
    short = {r.doc_id: quality_by_hand(fm, r.text, r.n_chars) for r in docs.collect() if len((r.text or "").split()) < 150}
    assert len(short) > 20 and all((i in ids) == (q >= 0.3) for i, q in short.items() if abs(q - 0.3) > 1e-4)

    single = stages["exact_copies"](spark, kept, SF).cache()
    best = {}
    for r in kept.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(best.values())

    near = stages["near_copies"](spark, single, SF).cache()
    from tests.llm.test_copies import jaccard_by_hand

    want = {i for i, (c, _, _) in jaccard_by_hand(single.collect()).items() if i == c}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want

    mix = stages["mixture"](spark, near, SF).cache()
    assert mix.columns == columns and {r.doc_id for r in mix.collect()} <= want
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in near.collect()}
    copies = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, (source, n) in size.items():
        sizes[source] += n
        taken[source] += n * copies.get(i, 0)
    for source, target in targets_by_hand(sizes).items():
        assert abs(taken[source] - target) <= max(n for s, n in size.values() if s == source)
        epochs = int(target // sizes[source])  # complete epochs come first
        assert all(epochs <= copies.get(i, 0) <= epochs + 1 for i, (s, n) in size.items() if s == source and n)

    out = stages["tokens"](spark, mix, SF).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in mix.collect()}
    assert len(out) == mix.count()
    for r in out:
        ids = np.array(lib.encode(texts[r.doc_id] or ""), "<i4")
        assert r.round_trip and r.ids == ids.tolist() and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark, documents, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, f"file://{tmp_path}").cache()
        assert docs.count() >= 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("not round_trip").count() == 0
