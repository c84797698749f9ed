import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quadloom.llm import fm_quality, langid, mixing, nnpu_toxicity, queries, sp_wfst, token_counts, warc
from quadloom.llm.sp_model import BPE, NORMAL, SPACE, UNIGRAM, UNKNOWN, USER_DEFINED, ModelSpec

SF = "/root/testdata/sf0.1"
MODEL = open(queries.tokenizer_path(), "rb").read()
BITS = ["a", "b", "the", "tion", " ", "  ", "   ", "日", "😀", "𝕏", "\n", "é", ".", " of", " in", "ing", SPACE, "\t", "<s>", "aaaa", "          ", "　", "http://", "12", "\0"]


def random_texts(n, longest, seed=1):
    rng = random.Random(seed)
    out = ["", " ", "  ", SPACE, "a" * 3000, " " * 200, "the" * 500, "\n" * 100]
    for k in range(n):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, longest)))
        out.append(t.replace(" ", "") if k % 7 == 0 else t)
    return out


# --- token counts and pieces ----------------------------------------------------------------------------------------


def test_spliced_counts_are_the_librarys():
    counter = token_counts.ChunkCounter(MODEL, chunk_chars=64, overlap=8)
    texts = random_texts(800, 200)
    assert counter.counts(texts) == [len(x) for x in counter.library.encode(texts)]
    assert counter.widened > 0


def test_token_count_query(spark, documents, empty):
    n = token_counts.token_count(spark, F.col("text"), queries.tokenizer_path(), chunk_chars=1000, overlap=16)
    got = {r.doc_id: r.n for r in documents.select("doc_id", n.alias("n")).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert got == {r.doc_id: len(lib.encode(r.text or "")) for r in documents.collect()}
    assert empty.select(n.alias("n")).count() == 0
    js = token_counts.token_count(spark, F.col("text"), queries.tokenizer_path("byte_bpe_50k.json"))
    assert documents.where("doc_id = 9").select(js.alias("n")).first().n > 0


def test_transducer_gives_the_librarys_pieces():
    machine, lib = sp_wfst.PieceTransducer(MODEL, most_segments=100), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for t in random_texts(1500, 60):
        ids = machine.encode(t).tolist()
        assert ids == lib.encode(t), t
        assert machine.decode(ids) == lib.decode(ids) == machine.round_trip(t) and machine.comes_back(t, ids)
    for n in range(1, 60):
        for t in (" " * n, " " * n + "the", " " * n + "日", "a" + " " * n):
            assert machine.encode(t).tolist() == lib.encode(t)


def merged_by_hand(machine, s):
    """Merging in its own words: the best pair of the whole string, the leftmost of equals, again and again."""
    parts = list(s)
    while True:
        found = [(-machine.spec.scores[machine.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in machine.ids]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pair_weights_are_what_merging_says():
    machine, rng = sp_wfst.PieceTransducer(MODEL), random.Random(5)
    made = [k for p, k in machine.ids.items() if len(p) == 1 or k in machine.parts]
    for _ in range(4000):
        a, b = rng.choice(made), rng.choice(made)
        pieces = [machine.spec.pieces[a], machine.spec.pieces[b]]
        assert machine._may_follow(a, b) == (merged_by_hand(machine, "".join(pieces)) == pieces)
    for p, k in rng.sample(list(machine.ids.items()), 2000):
        assert (len(p) == 1 or k in machine.parts) == (merged_by_hand(machine, p) == [p])


def test_character_maps_are_compiled():
    """The library's own rules on top of the pieces, without and with the removal of spaces."""
    odd = [*BITS, "①", "ﬁ", "Å", "ｶﾞ", "\u200b", "¨", "½", "ſ", "e\u0301", "Ⅷ", "ﷺ", "한", "가"]
    rng = random.Random(9)
    for rule in ("nmt_nfkc_cf", "nmt_nfkc"):
        mapped = MODEL + sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        for model in (mapped, mapped + b"\x1a\x02\x20\x01"):
            machine, lib = sp_wfst.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
            assert len(machine.replace.arcs) > 1000
            for t in [*random_texts(200, 30), *("".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(600))]:
                assert machine.encode(t).tolist() == lib.encode(t), t


def test_replaced_strings_are_the_leftmost_longest():
    rules = {"ab": "1", "abcd": "2", "bc": "3", "c": "", "cda": "4", "x": "xx"}
    machine, rng = sp_wfst.Replacer(rules), random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice("abcdx ") for _ in range(rng.randint(0, 14)))
        want, at = "", 0
        while at < len(t):
            n = next((n for n in (4, 3, 2, 1) if t[at : at + n] in rules and at + n <= len(t)), 0)
            want, at = want + (rules[t[at : at + n]] if n else t[at]), at + max(n, 1)
        assert machine(t) == want


def test_unigram_shortest_path_by_enumeration():
    pieces = {"<unk>": 0.0, SPACE: -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.2, SPACE + "a": -3.5, "ba": -3.1}
    machine = sp_wfst.PieceTransducer(ModelSpec(list(pieces), list(pieces.values()), [UNKNOWN] + [NORMAL] * 7, UNIGRAM))

    def best(s):
        if not s:
            return 0.0, []
        found = [(c - pieces[s[:n]], [s[:n], *rest]) for n in range(1, len(s) + 1) if s[:n] in pieces for c, rest in [best(s[n:])]]
        return min(found)

    rng = random.Random(2)
    for _ in range(200):
        t = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(2))
        got = [machine.spec.pieces[i] for i in machine.encode(t)]
        cost = -sum(pieces[p] for p in got)
        assert "".join(got) == machine.normalise(t) and cost == pytest.approx(best(machine.normalise(t))[0])
    assert machine.encode("axb").tolist().count(0) == 1
    with pytest.raises(ValueError, match="user-defined"):
        sp_wfst.PieceTransducer(ModelSpec(["a"], [0.0], [USER_DEFINED], BPE))
    with pytest.raises(ValueError, match="merges in their order"):
        sp_wfst.PieceTransducer(ModelSpec(["a", "b", "ab", "abb"], [0.0, 0.0, -2.0, -1.0], [NORMAL] * 4, BPE))


def test_encoding_and_decoding_tables(spark, documents, empty):
    made = sp_wfst.encode_documents(documents, queries.tokenizer_path())
    back = sp_wfst.decode_documents(made, queries.tokenizer_path())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in documents.collect())
    assert made.where("round_trip").count() == 10 and made.where("n_tokens = 0").count() == 2 and made.where("n_tokens <> size(ids)").count() == 0
    assert sp_wfst.encode_documents(empty, queries.tokenizer_path(), with_ids=False).count() == 0


# --- classifiers ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label,least", [("op1_quality_classifier", "quality", 0.98), ("op5_toxicity", "toxic", 0.93)])
def test_held_out_scores(spark, name, label, least):
    got = queries.queries()[name](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    rank, y = held.score.rank(), held[label]
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > least
    assert (held.predicted[y == 0] == (0 if label == "toxic" else held.predicted[y == 0])).mean() > 0.97


def test_held_out_languages(spark):
    got = queries.op7_language_id(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 7, 7)]])
def test_classifiers_with_odd_labels(spark, documents, empty, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for docs in (documents, empty):
        fm = fm_quality.fit_quality(docs, table)
        tox = nnpu_toxicity.fit_toxicity(docs, table)
        out = docs.select(fm_quality.quality_score(docs, fm).alias("q"), nnpu_toxicity.toxicity_score(docs, tox).alias("t")).collect()
        assert len(out) == docs.count() and all(0 <= x <= 1 for r in out for x in r)
    without = documents.drop("n_chars")
    assert without.select(fm_quality.quality_score(without, fm_quality.fit_quality(without, table)).alias("q")).count() == 10


def test_machine_pairs_by_sum_over_pairs():
    fm = fm_quality.FactorisationMachine(size=20, rank=3)
    rng = np.random.default_rng(1)
    fm.w, fm.bias = rng.normal(size=20).astype(np.float32), 0.3
    ids, x = np.array([1, 4, 7, 9, 2, 3]), rng.normal(size=6).astype(np.float32)
    starts = np.array([0, 4])
    want = [0.3 + sum(fm.w[i] * a for i, a in zip(g, v, strict=True)) + sum(fm.v[g[i]] @ fm.v[g[j]] * v[i] * v[j] for i in range(len(g)) for j in range(i)) for g, v in ((ids[:4], x[:4]), (ids[4:], x[4:]))]
    assert fm.raw(ids, x, starts)[0] == pytest.approx(want, abs=1e-5)


def test_negative_risk_is_held_at_zero():
    rng = random.Random(3)
    common = list(range(100, 140))
    pos = [np.array(sorted({7, *rng.sample(common, 10)})) for _ in range(60)]
    unl = [np.array(sorted(({7} if i % 10 == 0 else set()) | set(rng.sample(common, 10)))) for i in range(400)]
    model = nnpu_toxicity.fit_nnpu(pos, unl, 0.1)
    assert model.ids.tolist() == [7] and model.weights[0] + model.bias > 0 > model.bias


def test_languages_back_off(spark, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der die und strasse", "de"), ("the and street houses", "en")] * 20)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the")[0] == "en" and model.predict("strassen")[0] == "de" and model.predict("streets")[0] == "en"
    assert model.predict("") == model.predict("12 !") == ("und", 0.0)
    none = langid.fit_languages(empty)
    assert none.predict("the") == ("und", 0.0)
    docs = spark.createDataFrame([(1, None), (2, "42"), (3, "the street")], "doc_id long, text string")
    assert {r.doc_id: r.l.lang_pred for r in docs.select("doc_id", langid.language(docs, model).alias("l")).collect()} == {1: "und", 2: "und", 3: "en"}


def test_words_are_letters_and_their_marks():
    assert langid.WORDS.findall("½ ② Ⅷ ٣ 12") == [] and langid.WORDS.findall("हिन्दी में") == ["हिन्दी", "में"] and langid.WORDS.findall("l'été x2y") == ["l", "été", "x", "y"]
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(32, 0x2FFF), rng.randint(0x4E00, 0x4E80), rng.randint(32, 0x1FFFF)])) for _ in range(rng.randint(0, 12)))
        assert langid.words_of(t) == langid.WORDS.findall(t), t
    model = langid.LanguageModel(["de"], [{} for _ in range(6)], [np.zeros((0, 1), np.float32)] * 6, np.zeros(1, np.float32))
    assert model.predict("½ ② Ⅷ") == ("und", 0.0) and model.predict("\u0301") == ("und", 0.0)


def test_language_by_brute_force(spark, documents):
    """Every word's row found anew in the tables, with a plain sum; repeated rows, clashing names, ties and a long text among them."""
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("der die und strasse haus", "de"), ("the and street houses", "en"), ("le la rue maison", "fr")] * 10)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit_languages(train)

    def score(text):
        words, total = langid.WORDS.findall((text or "").lower()), [0.0] * len(model.langs)
        if not words:
            return "und", 0.0
        for w in words:
            if w in model.tables[0]:
                row = model.matrices[0][model.tables[0][w]]
            else:
                row = model.unseen
                for n in range(min(5, len(w) + 2), 0, -1):
                    marked = f"\x02{w}\x03"
                    known = [model.tables[n][g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in model.tables[n]]
                    if known:
                        row = [float(sum(model.matrices[n][k][c] for k in known)) / len(known) for c in range(len(model.langs))]
                        break
            total = [a + float(b) for a, b in zip(total, row, strict=True)]
        p = [math.exp(x - max(total)) for x in total]
        return model.langs[p.index(max(p))], max(p) / sum(p)

    texts = ["strassen", "die maison", "houses the", "zzz qqq", "", None, "42", "der " * 150_000, "rue " * 3 + "the"]
    asked = spark.createDataFrame([(i, t, "de", i % 2) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.l for r in asked.select("doc_id", langid.language(asked, model).alias("l")).collect()}
    for i, t in enumerate(texts + texts[:2]):
        lang, share = score(t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(share, abs=1e-3), t
    assert langid.LanguageModel(["a", "b"], [{"w": 0}, *({} for _ in range(5))], [np.zeros((1, 2), np.float32)] * 6, np.zeros(2, np.float32)).predict("w") == ("a", 0.5)


def quality_by_hand(fm, text, n_chars):
    """The score with a sum over all pairs of features."""
    ids, x, _ = fm_quality.features([text or ""], [n_chars], fm_quality._word_cache())
    z = fm.bias + sum(float(fm.w[i]) * float(a) for i, a in zip(ids, x, strict=True))
    v = fm.v[ids].astype(np.float64) * x[:, None]
    z += sum(float(v[i] @ v[j]) for i in range(len(ids)) for j in range(i))
    return 1 / (1 + math.exp(-z))


def test_quality_and_toxicity_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = [(900_001, None, "en", "a", None, "x"), (900_002, "", "en", "a", 0, "x"), (900_003, "word " * 20_000, None, None, 5, "x"), (900_003, "word " * 20_000, None, None, 5, "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    fm, tox = fm_quality.fit_quality(docs, labels), nnpu_toxicity.fit_toxicity(docs, labels)
    weights = dict(zip(tox.ids.tolist(), tox.weights.tolist(), strict=True))
    rows = docs.select("doc_id", "text", "n_chars", fm_quality.quality_score(docs, fm).alias("q"), nnpu_toxicity.toxicity_score(docs, tox).alias("t")).collect()
    for r in rows:
        if len((r.text or "").split()) < 150 or r.doc_id > 900_000:
            assert r.q == pytest.approx(quality_by_hand(fm, r.text, r.n_chars), abs=1e-4)
        present = {f for w in nnpu_toxicity.WORDS.findall((r.text or "").lower()) for f in nnpu_toxicity.word_features(w)}
        assert r.t == pytest.approx(1 / (1 + math.exp(-(tox.bias + sum(weights.get(f, 0.0) for f in present)))), abs=1e-9)


# --- mixing ---------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        free -= over or free
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mix_by_hand(spark, documents, empty):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "b", "c", "é", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    sizes, source = defaultdict(int), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    for rows_in_bucket in (50, 3):
        assert sorted(map(tuple, mixing.mix(docs, boundary_rows=rows_in_bucket).collect())) == sorted(map(tuple, got))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(documents).count() == 10 and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_rows_without_an_id_draw_by_their_texts(spark):
    """Many rows without an id don't share one key, so the search divides them."""
    rows = [(None, "w " * (1 + i % 9) + f"t{i}", "a" if i < 900 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, boundary_rows=3).collect()
    a = [r for r in got if r.source_size > 2000]
    assert len(got) == 1000 and 0 < sum(r.taken for r in a) < sum(r.size for r in a) and abs(sum(r.taken for r in a) - a[0].target) <= 10
    # More sources than are broadcast: the same by a shuffle.
    assert sorted(map(tuple, mixing.mix(docs, max_sources=1).collect())) == sorted(map(tuple, got))


def test_better_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words of prose here").otherwise("1234 5678 !!!! #### $$$$").alias("text"), F.when(F.col("id") < 3990, "b").otherwise("a").alias("source"))
    rows = mixing.mix(docs.withColumn("source", F.when(F.col("doc_id") < 400, "a").otherwise("b"))).where("taken > 0 and source_size > 2000").collect()
    good = sum(1 for r in rows if r.doc_id % 2 == 0)
    assert good > 0.5 * len(rows)


# --- archives -------------------------------------------------------------------------------------------------------


def test_archive_round_trip_and_format(tmp_path):
    records = [warc.make_record(i, f"http://x/{i}?é", (f"<p>page {i % 7}</p>" * (i % 40)).encode(), "d" * 64, 5, 3 if i % 5 == 0 else None) for i in range(300)]
    with open(tmp_path / "a.warc.zst", "wb") as f:
        warc.write_archive(records, f)
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.DICT_MAGIC and list(warc.read_archive(raw)) == records
    fields = warc.parse_record(records[5])["fields"]
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Profile"] == warc.SAME_PAYLOAD and fields["WARC-Target-URI"] == "http://x/5?%C3%A9"
    for n in (1, 3, 5, 7):  # too few to train on: their raw content is the dictionary
        with open(tmp_path / "b.warc.zst", "wb") as f:
            warc.write_archive(records[:n], f)
        raw = (tmp_path / "b.warc.zst").read_bytes()
        assert int.from_bytes(raw[:4], "little") == warc.DICT_MAGIC and int.from_bytes(raw[4:8], "little") > 0
        assert list(warc.read_archive(raw)) == list(warc.read_archive(raw, step=7)) == records[:n]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_archive(raw[:-3]))


def test_dictionaries_are_made_of_whole_records_within_bounds():
    records = [bytes([65 + k % 26]) * (50_000 if k % 50 == 0 else 300) + str(k).encode() for k in range(400)]
    made = warc.train(records, dict_bytes=4096, sample_bytes=100_000)
    assert 0 < len(made) <= 4096
    assert len(warc.train([b"x" * 10_000_000], dict_bytes=4096)) == 4096


def test_shared_folders_of_other_schemes(tmp_path, monkeypatch):
    from types import SimpleNamespace

    from pyarrow import fs

    assert isinstance(warc.open_shared(f"file://{tmp_path}")[0], fs.LocalFileSystem)
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: uri))  # no network here
    assert warc.open_shared("s3a://bucket/x") == "s3://bucket/x" and warc.open_shared("hdfs://host/x") == "hdfs://host/x"


def test_archives_of_pages(spark):
    big = "<html>" + "x" * 200
    rows = [(5, "u", big, "z"), (2, None, big, "z"), (2, None, big, "z"), (9, "u", "short", None), (10, "u", "short", None), (11, "u", None, None), (12, "u", "", None), (None, "u", big, None), (20, "u", "<p>é</p>" * 30_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=str)
    n = len(big)
    assert got == sorted([(5, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (9, 5, "response", None), (10, 5, "response", None), (11, 0, "response", None), (12, 0, "response", None), (None, n, "revisit", 2), (20, 270_000, "response", None)], key=str)
    manifest = warc.write_archives(warc.decide(pages), warc.new_folder(spark, "w"), archive_bytes=1000)
    assert manifest.agg(F.sum("records")).first()[0] == 9
    texts = {r.page_id: r.payload for r in warc.read_archives(spark, manifest).where("record_type = 'response'").collect()}
    assert bytes(texts[2]).decode() == big
    assert warc.archive_pages(pages.where("false")).count() == 0
