"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import WordCache, bucket_of, labelled_sample, ship, texts_of

WORD_BITS, STATS, BINS = 16, 12, 16
STAT_BASE = 1 << WORD_BITS
SIZE = STAT_BASE + (STATS + 1) * BINS

# Classes of UTF-8 bytes: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 line end, 6 punctuation, 7 symbol.
_CLASS = np.zeros(256, np.uint8)
for _chars, _class in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (" \t\r", 4), ("\n", 5), (".,;:'\"-()", 6), ("!?#$%&*+/<=>@[\\]^_`{|}~", 7)):
    _CLASS[[ord(c) for c in _chars]] = _class
del _chars, _class


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    """STATS numbers in [0, 1] that tell prose from lists, tables, shouting, symbols and repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    c = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    n = max(1, len(words))
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    return [c[1], c[2], c[3], c[4], min(1.0, c[5] * 20), c[6], c[7], distinct / n, repeats, min(1.0, len(raw) / n / 20), math.log1p(len(words)) / 12, len(set(lines)) / len(lines)]


def features(texts: list[str], n_chars: list[float], cache: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, values, first position of each text): whole texts, each distinct word once."""
    ids, values, starts, at = [], [], [], 0
    for text, n in zip(texts, n_chars, strict=True):
        words = text.split()
        distinct = set(words)
        stats = structure(text, words, len(distinct))
        stat_ids = [STAT_BASE + k * BINS + min(BINS - 1, int(x * BINS)) for k, x in enumerate(stats)]
        known = n is not None and n == n and n >= 0
        stat_ids.append(STAT_BASE + STATS * BINS + (min(BINS - 2, int(math.log1p(n))) if known else BINS - 1))
        own = np.fromiter(map(cache.__getitem__, distinct), np.int64, len(distinct))
        ids += [np.array(stat_ids), own]
        values += [np.full(len(stat_ids), 0.5), np.full(len(own), 1 / math.sqrt(max(1, len(own))))]
        starts.append(at)
        at += len(stat_ids) + len(own)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32), np.array(starts, np.int64)


class FactorisationMachine:
    """score = bias + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2): the pairwise term in linear time."""

    def __init__(self, size: int = SIZE, rank: int = 4, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank)).astype(np.float32)

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * values[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        linear = np.add.reduceat(self.w[ids] * values, starts)
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.bias + linear + pairs, vx, total

    def score(self, ids, values, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, starts)[0].astype(np.float64), -60, 60)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.08, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the weighted log loss: about `steps` batches, each row once an epoch."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-4), np.full_like(self.v, 1e-4), 1e-4
        for _ in range(max(3, -(-steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for chunk in np.array_split(order, max(1, len(order) // batch)):
                n = np.array([len(rows[i][0]) for i in chunk])
                ids, x = np.concatenate([rows[i][0] for i in chunk]), np.concatenate([rows[i][1] for i in chunk])
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                z, vx, total = self.raw(ids, x, starts)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chunk]) * weight[chunk]).astype(np.float32)
                each = np.repeat(g, n) * x
                used, place = np.unique(ids, return_inverse=True)
                dw = np.bincount(place, each, len(used)).astype(np.float32) + decay * self.w[used]
                inner = each[:, None] * (np.repeat(total, n, axis=0) - vx)
                dv = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(self.v.shape[1])], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += float(g.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * float(g.sum()) / math.sqrt(gb)
        return self


def _word_cache() -> WordCache:
    return WordCache(bucket_of(WORD_BITS))


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = 3000, **options) -> FactorisationMachine:
    """A model from about per_class labelled rows of each class at most; features are made on the executors.

    Classes are weighted back to their shares among all training labels. With labels of one class or none, the model
    says that class's share, or 0.5, for every text.
    """
    ship(documents.sparkSession)
    sample, shares = labelled_sample(documents, labels, "quality", per_class)
    model = FactorisationMachine()
    if len(shares) < 2:
        model.v[:] = 0
        model.bias = {0: -4.0, 1: 4.0}[next(iter(shares))] if shares else 0.0
        return model
    if "n_chars" not in sample.columns:
        sample = sample.withColumn("n_chars", F.lit(None).cast("double"))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _word_cache()
        for b in batches:
            ids, x, starts = features(texts_of(b.text), b.n_chars.tolist(), cache)
            cut = lambda a: np.split(a, starts[1:])
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "ids": [a.astype(np.int32) for a in cut(ids)], "x": cut(x)})

    got = sample.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), "y").mapInPandas(collect, "doc_id long, y int, ids array<int>, x array<float>").toArrow().to_pandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)
    y = got.y.to_numpy(np.float32)
    n = np.bincount(got.y, minlength=2)
    if not n.all():
        model.v[:] = 0
        return model
    weight = np.array([shares[0] / n[0], shares[1] / n[1]]) * len(got)
    rows = [(np.asarray(a, np.int64), np.asarray(b, np.float32)) for a, b in zip(got.ids, got.x, strict=True)]
    return model.fit(rows, y, weight[got.y.to_numpy()].astype(np.float32), **options)


def quality_score(documents: DataFrame, model: FactorisationMachine) -> Column:
    """A score in [0, 1] of each whole text, however long; n_chars may be missing or null. No other column is read.

    A null text is scored as an empty one, which gets what its structure statistics say. Repeated rows and equal texts of
    equal n_chars get equal scores (there are no ties to break); an empty table gives no rows.
    """
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fm = FactorisationMachine(size=1)
        fm.bias, fm.w, fm.v = held.value
        cache = _word_cache()
        for text, n_chars in columns:
            texts, n, out = texts_of(text), n_chars.tolist(), []
            for a in range(0, len(texts), 256):
                out.append(fm.score(*features(texts[a : a + 256], n[a : a + 256], cache)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    n = F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(None).cast("double")
    return score(F.col("text").cast("string"), n)
