"""Language identification: known words by log frequency, unseen ones by progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from itertools import groupby
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import hash_share, held_out, ship, texts_of

LONGEST = 5


_categories = list(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))


def _of_categories(kinds: str) -> str:
    """The characters of some Unicode categories as ranges of a character class."""
    ranges, begin = [], 0
    for inside, run in groupby(_categories, lambda category: category[0] in kinds):
        end = begin + sum(1 for _ in run)
        if inside:
            ranges.append(f"\\U{begin:08x}-\\U{end - 1:08x}")
        begin = end
    return "".join(ranges)


#: A letter (categories L*), then letters and marks (M*): vowel signs stay within words.
WORDS = re.compile(f"[{_of_categories('L')}][{_of_categories('LM')}]*")
#: Where a text has neither a mark nor a number that is no decimal digit, this finds the same words, and faster.
_PLAIN = re.compile(r"[^\W\d_]+")
_ODD = frozenset(chr(c) for c, category in enumerate(_categories) if category[0] == "M" or category in ("No", "Nl"))
del _categories


def words_of(text: str) -> list[str]:
    return (_PLAIN if text.isascii() or _ODD.isdisjoint(text) else WORDS).findall(text)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks of its ends."""
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class _Rows(dict):
    """word -> row of `scores`, made on demand; emptied when `most` rows are used, so memory stays bounded."""

    def __init__(self, model: LanguageModel, most: int = 300_000):
        super().__init__()
        self.model, self.scores = model, np.zeros((most, max(1, len(model.langs))), np.float32)

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.scores):
            raise OverflowError
        row = len(self)
        self.scores[row] = self.model.word(word)
        self[word] = row
        return row


class LanguageModel:
    """tables[0]: words; tables[n]: n-grams; each maps to a row of its matrix of log frequencies, a column per language."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], matrices: list[np.ndarray], unseen: np.ndarray):
        self.langs, self.tables, self.matrices, self.unseen, self.rows = langs, tables, matrices, unseen, None

    def word(self, word: str) -> np.ndarray:
        found = self.tables[0].get(word)
        return self.matrices[0][found] if found is not None else self.back_off(word)

    def back_off(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.tables[n]
            known = [k for k in map(table.get, grams(word, n)) if k is not None]
            if known:
                return self.matrices[n][known].mean(0)
        return self.unseen

    def predict(self, text: str) -> tuple[str, float]:
        """Texts without a letter, and any text where no language was learned, are und with score 0."""
        words = words_of(text.lower())
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for k in range(0, len(words), 100_000):
            total += self._sum(words[k : k + 100_000])
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())

    def _sum(self, words: list[str]) -> np.ndarray:
        for _ in range(2):
            if self.rows is None:
                self.rows = _Rows(self)
            try:
                at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
                return self.rows.scores[at].sum(0, dtype=np.float64)
            except OverflowError:
                self.rows = None
        raise OverflowError("more words in a slice than rows")


def fit_languages(documents: DataFrame, per_lang: int = 1000, smoothing: float = 0.5, min_word: int = 2, max_langs: int = 1000) -> LanguageModel:
    """Counts over about per_lang documents of each language at most, drawn by a hash of the id; held-out ones are not used.

    Words seen min_word times or more are kept as words. Languages are few: more than max_langs is an error.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(totals) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(totals)
    if not langs:
        return LanguageModel([], [{} for _ in range(LONGEST + 1)], [np.zeros((0, 0), np.float32)] * (LONGEST + 1), np.zeros(0))
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, min(1.0, per_lang / totals[lang])).otherwise(rate)
    sample = rows.where(hash_share(F.col("doc_id"), F.lit("lang")) < rate)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(b.text, b.lang, strict=True):
                by_lang.setdefault(lang, Counter()).update(words_of(text.lower()))
            for lang, words in by_lang.items():
                yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})

    got = sample.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    words, at = np.unique(got.word.to_numpy(object), return_inverse=True) if len(got) else (np.zeros(0, object), np.zeros(0, np.int64))
    seen = np.zeros((len(words), len(langs)), np.float64)
    seen[at, [langs.index(x) for x in got.lang]] = got.n
    known = seen.sum(1) >= min_word
    tables, matrices = [], []

    def add(keys: list[str], rows: np.ndarray) -> None:
        low = np.log(rows.sum(0) + smoothing * max(1, len(keys)))
        tables.append({key: i for i, key in enumerate(keys)})
        matrices.append((np.log(rows + smoothing) - low).astype(np.float32))

    add(words[known].tolist(), seen[known])
    weight = np.where(seen > 0, 1 + np.log(np.maximum(seen, 1)), 0)
    for size in range(1, LONGEST + 1):
        found = [grams(w, size) for w in words]
        keys, rows = pd.factorize(np.array([g for gs in found for g in gs] or [""], object))[::-1]
        total = np.zeros((len(keys), len(langs)))
        if any(found):
            np.add.at(total, rows, weight[np.repeat(np.arange(len(words)), [len(gs) for gs in found])])
        kept = total.sum(1) >= (2 if size > 1 else 1e-9)
        add(np.asarray(keys)[kept].tolist(), total[kept])
    return LanguageModel(langs, tables, matrices, np.full(len(langs), -12.0, np.float32))


def language(documents: DataFrame, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of the whole text; no other column is read, whatever its name.

    Null and empty texts and texts without a letter (Unicode categories L*) are und with score 0, as are all texts where no
    language was learned. Very long texts are scored whole, 100,000 words at a time. Of languages that tie the first by
    code point is said. Repeated rows get the same result each; an empty table gives no rows.
    """
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.langs, [list(t) for t in model.tables], model.matrices, model.unseen))

    @F.pandas_udf("lang_pred string, score double")
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, tables, matrices, unseen = held.value
        own = LanguageModel(langs, [{key: i for i, key in enumerate(t)} for t in tables], matrices, unseen)
        for text in columns:
            yield pd.DataFrame([own.predict(t) for t in texts_of(text)], columns=["lang_pred", "score"])

    return predict(F.col("text").cast("string"))
