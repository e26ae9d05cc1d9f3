"""Operator 10: language identification by error-correcting output codes over hashed byte trigrams.

Each language gets a codeword of +1 and -1. For every bit of the code a binary classifier (naive Bayes log-odds of hashed
trigrams, languages weighing alike) predicts that bit; the decoder takes the codeword with the least logistic loss over
the bits, each weighed by how well its two sides differ, and flags a text as ambiguous when the second codeword's loss
is close.

Trigram counts cover all rows to learn from; they are summed as rows (language, bucket, count). Only languages times
``BUCKETS`` counts, whatever the corpus, reach the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language teach nothing; if
no row has one, every text is ``und``; a single language is predicted for every text with letters; texts are used whole,
in slices of bounded memory; other columns are not read; repeated rows count as often as they occur; of equally near
languages the first in the order of their names is predicted; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import map_texts

BUCKETS = 1 << 15
SLICE = 1 << 20
SMOOTHING = 0.5
AMBIGUOUS = 0.9  # scores below it are flagged

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_LOWER[[9, 10, 11, 12, 13]] = 32


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all byte trigrams of ``text`` between two spaces, a slice at a time."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)
    for at in range(0, len(raw) - 2, SLICE):
        x = _LOWER[raw[at : at + SLICE + 2]]
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, bucket, n) of one task."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            if has_letter(text):
                counts = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in trigrams(text):
                    counts += np.bincount(part, minlength=BUCKETS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages: every two-way split for up to five, else random columns."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n)))
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1).astype(np.int8)[:, None]
        apart = (bits - code.astype(int) @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


class Model:
    """Languages in order, their codewords, and a weight for each bucket and bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.bits = np.ones(self.code.shape[1])
        if len(langs) > 1:
            shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
            for b, side in enumerate(self.code.T):
                plus, minus = shares[side > 0].mean(0), shares[side < 0].mean(0)
                self.weights[:, b] = np.log(plus / minus)
                self.bits[b] = np.sum((plus - minus) * np.log(plus / minus))
            self.bits *= len(self.bits) / self.bits.sum()

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the decision is ambiguous."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total, n = 0.0, 0
        for part in trigrams(text):
            total, n = total + self.weights[part].sum(0, dtype=np.float64), n + len(part)
        margin = total / np.sqrt(n)
        loss = np.logaddexp(0, -self.code * margin) @ self.bits
        p = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(p[best] / p.sum())
        return self.langs[best], score, score < AMBIGUOUS


def train(docs: DataFrame) -> Model:
    """Learn from all rows with a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = rows.mapInPandas(count_trigrams, "lang string, bucket int, n long")
    # at most BUCKETS rows a language reach the driver
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    at = {x: i for i, x in enumerate(langs)}
    counts[table["lang"].map(at).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times bits floats
    fields = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "ambiguous": (T.BooleanType(), pa.bool_())}
    return map_texts(docs, keep, lambda texts: zip(*map(shared.value.decode, texts)), fields)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=["doc_id", "held_out"])
