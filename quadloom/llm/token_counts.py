"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where that is proven safe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import in_slices, ship, texts_of
from quadloom.llm.sp_model import SPACE, parse_model


def spanning_pairs(pieces: list[str]) -> set[str]:
    """All pairs of neighbouring characters inside vocabulary pieces. A pair that isn't here is never within one token."""
    return {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}


class ChunkCounter:
    """Counts tokens as the library gives them for the whole text.

    A boundary between two characters is stable if no vocabulary piece holds the two side by side: no token spans it, no
    merge crosses it, so what stands on its two sides is encoded independently. Two chunks are spliced at a stable
    boundary inside their overlap at which both have a token boundary; where the overlap has none it is doubled, in the
    end up to the rest of the text. Texts of chunk_chars or less are encoded at once.
    """

    def __init__(self, model: bytes, chunk_chars: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = parse_model(model)
        self.stable = spec.is_bpe and spec.is_identity and not spec.remove_extra_whitespaces and not spec.has_user_pieces
        self.pairs = spanning_pairs(spec.normal_pieces)
        self.chunk_chars, self.overlap, self.widened = chunk_chars, overlap, 0

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk_chars or not self.stable]
        for a, b in in_slices((len(texts[i]) for i in short), 1 << 19):
            for i, ids in zip(short[a:b], self.library.encode([texts[i] for i in short[a:b]], num_threads=1, return_type="numpy"), strict=True):
                out[i] = len(ids)
        for i, t in enumerate(texts):
            if self.stable and len(t) > self.chunk_chars:
                out[i] = self.huge(t)
        return out

    def _begins(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where tokens of text[begin:end] begin, as offsets of the whole text."""
        offsets = self.library.encode(text[begin:end], return_type="offset_mapping")["offsets"]
        return np.fromiter((x[0] for x in offsets), np.int64, len(offsets)) + begin

    def huge(self, text: str) -> int:
        n = len(text)
        total = at = start = 0  # tokens before offset `at` are counted; the present chunk is text[start:end]
        end = min(n, self.chunk_chars)
        begins = self._begins(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                low = max(start, end - overlap)
                high = min(n, low + self.chunk_chars + overlap)
                following = self._begins(text, low, high)
                p = self._common(text, max(low, at) + 1, end, begins, following)
                if p is not None:
                    total += int(((begins >= at) & (begins < p)).sum())
                    start, at, end, begins = low, p, high, following
                    break
                self.widened += 1
                if low <= start:  # not one stable boundary in the whole chunk: the rest is encoded with all before it
                    return total + int((self._begins(text, 0, n) >= at).sum())
                overlap *= 2
        return total + int((begins >= at).sum())

    def _common(self, text: str, low: int, high: int, begins: np.ndarray, following: np.ndarray) -> int | None:
        both = np.intersect1d(begins, following)
        for p in both[(both >= low) & (both < high)].tolist():
            if text[p - 1 : p + 1].replace(" ", SPACE) not in self.pairs:
                return p
        return None


def token_count(spark: SparkSession, text: Column, model_path: str, **options) -> Column:
    """Tokens of each whole text as the library gives them; no other column is read.

    Null counts as empty, which has none. Very long texts are encoded in chunks that are spliced where that is proven
    safe; `.json` models are encoded whole by tokenizers. Repeated rows are counted each (there are no ties to break); an
    empty table gives no rows.
    """
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    json_model = model_path.endswith(".json")

    @F.pandas_udf("long")
    def count(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if json_model:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(model.value.decode())
            library.no_truncation()
            library.no_padding()
            counts = lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        else:
            counts = ChunkCounter(model.value, **options).counts
        for column in columns:
            yield pd.Series(counts(texts_of(column)), dtype="int64")

    return count(text)
