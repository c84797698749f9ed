"""Toxicity by non-negative positive-unlabelled learning (numpy) with a class-prior-corrected risk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import bucket_of, hash_share, held_out, labelled_sample, ship, texts_of

BITS = 20
PREFIXES = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")
_hash = bucket_of(BITS, "tox:")


def word_features(word: str) -> list[int]:
    """A lower-case word and its beginnings, hashed."""
    return [_hash("w " + word), *(_hash("b " + word[:k]) for k in PREFIXES if len(word) > k)]


class _Features(dict):
    """word -> its features as a tuple, `keep` of them only; emptied when it has grown large."""

    def __init__(self, keep: dict[int, int] | None = None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        ids = word_features(word)
        value = self[word] = tuple(ids) if self.keep is None else tuple(self.keep[i] for i in ids if i in self.keep)
        return value

    def of(self, text: str) -> set[int]:
        """Features present in the whole text."""
        found: set[int] = set()
        for x in map(self.__getitem__, set(WORDS.findall(text.lower()))):
            if x:
                found.update(x)
        return found


class ToxicityModel:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias


def prior_of(shares: dict[int, float], default: float = 0.1) -> float:
    """Class prior: the share of toxic among training labels of both kinds; the default where only toxic ones exist."""
    return min(0.9, max(0.005, shares.get(1, 0.0))) if 0 in shares else default


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_g2: float = 20.0, most: int = 8192) -> np.ndarray:
    """Features that positives have over three times as often as unlabelled texts, by the likelihood ratio G2 of their document frequency."""
    p, u = len(positive), len(unlabelled)
    dp, du = (np.bincount(np.concatenate(rows), minlength=1 << BITS).astype(np.float64) for rows in (positive, unlabelled))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    ep, eu = (dp + du) * p / (p + u), (dp + du) * u / (p + u)
    g2 = 2 * (part(dp, ep) + part(du, eu) + part(p - dp, p - ep) + part(u - du, u - eu))
    found = np.flatnonzero((g2 > least_g2) & (dp >= 3) & (dp / p > 3 * np.maximum(du, 0.5) / u))
    return np.sort(found[np.argsort(-g2[found], kind="stable")][:most])


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> ToxicityModel:
    """Linear weights that minimise prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) with the logistic loss.

    Where the estimate of the negative risk falls below 0 the step goes up along its gradient (Kiryo et al. 2017). Whole
    batches with Adagrad; the weights are those of `telling` features and start at 0, the bias at the log odds of the prior.
    """
    used = telling(positive, unlabelled)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    p, u = len(positive), len(unlabelled)
    n = np.array([len(r) for r in [*positive, *unlabelled]])
    col = place[np.concatenate([*positive, *unlabelled])]
    row = np.repeat(np.arange(p + u), n)[col >= 0]
    col = col[col >= 0]
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    g2, gb2 = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(row, w[col], p + u)
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[p:].mean() - prior * as_negative[:p].mean()
        back = np.concatenate([np.full(p, -prior / p), np.full(u, 1 / u)]) * chance
        g = -back
        if negative_risk >= 0:
            g = back.copy()
            g[:p] += prior / p * (chance[:p] - 1)
        dw, db = np.bincount(col, g[row], len(used)) + decay * w, float(g.sum())
        g2 += dw**2
        gb2 += db**2
        w -= rate * dw / np.sqrt(g2)
        b -= 0.2 * rate * db / np.sqrt(gb2)
    return ToxicityModel(used, w, b)


def fit_toxicity(documents: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, prior: float | None = None, **options) -> ToxicityModel:
    """A model from about `positives` confirmed toxic rows and about `unlabelled` others of any kind, at most.

    Held-out ids are in neither. Unlabelled rows are drawn from all documents by a hash of the id. prior is the share of
    toxic texts among all; None takes the share among the training labels, which is right where rows were labelled at
    random. Without toxic examples or without unlabelled text, every text scores below 0.5.
    """
    ship(documents.sparkSession)
    sample, shares = labelled_sample(documents, labels, "toxic", positives)
    total = documents.where(~held_out(F.col("doc_id"))).count()
    rate = min(1.0, unlabelled / max(1, total))
    others = documents.select("doc_id", "text").where(~held_out(F.col("doc_id")) & (hash_share(F.col("doc_id"), F.lit("u")) < rate))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Features()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "kind": b.kind, "ids": [np.fromiter(sorted(cache.of(t)), np.int32) for t in texts_of(b.text)]})

    both = sample.where("y = 1").select("doc_id", "text", F.lit(1).alias("kind")).unionByName(others.select("doc_id", "text", F.lit(0).alias("kind")))
    got = both.mapInPandas(collect, "doc_id long, kind int, ids array<int>").toArrow().to_pandas().sort_values(["kind", "doc_id"], kind="stable")
    # Texts of the same features count once: copies would make any of their words telling.
    rows = lambda kind: list({x.tobytes(): x for x in (np.asarray(x, np.int64) for x in got.ids[got.kind == kind])}.values())
    positive, others = rows(1), rows(0)
    if not positive or not others:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -2.0)
    return fit_nnpu(positive, others, prior if prior is not None else prior_of(shares), **options)


def toxicity_score(documents: DataFrame, model: ToxicityModel) -> Column:
    """A score in [0, 1] of each whole text, however long. No other column is read, whatever its name.

    Null and empty texts have no features and get the model's bias alone. Repeated rows and equal texts get equal scores
    (there are no ties to break); an empty table gives no rows.
    """
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.ids, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, weights, bias = held.value
        cache, w = _Features(dict(zip(ids.tolist(), range(len(ids)), strict=True))), weights.tolist()
        for text in columns:
            z = np.array([bias + sum(w[i] for i in sorted(cache.of(t))) for t in texts_of(text)], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return score(F.col("text").cast("string"))
