"""Operator 6: quality rules by line sequence labelling with a linear-chain conditional random field.

Every line of a text that has a word gets a few features of its own shape and place. A two-label chain (content,
boilerplate) is decoded by Viterbi, and a document stays when the words of its content lines make up at least
``MIN_SHARE`` of all its words. Documents that fail the base rules (under 50 words, or most words in repeated
three-word windows) go in any case.

There are no labels of lines, so a document's quality label stands for each of its lines; lines that repeat an earlier
one, or are mostly symbols, count as boilerplate anywhere. The field is fitted by gradient ascent on the likelihood of
at most ``SAMPLE`` labelled documents of either kind, chosen by a hash of the id; all else covers every row.

Defined cases: null and empty texts have no words and fail the base rules; without labels, or with one kind only, no
document is rejected by the field; texts are used whole; other columns are not read unless named in ``keep``; repeated
rows are judged alike; a content share of exactly the least one is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import filter_texts, map_texts

SAMPLE = 1500
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS = 60

SYMBOLS = b"#*$%&|<>"
_SPACE, _UPPER, _DIGITS = b" \t\n\r\x0b\x0c", bytes(range(65, 91)), b"0123456789"
_PUNCT, _LINKS = b".,;:!?", b"@/\\_=[]{}"
#: Values of each feature; a line has one of each.
WIDTHS = (5, 5, 4, 4, 4, 2, 2, 4, 3, 3)
OFFSETS = np.cumsum((0, *WIDTHS[:-1]))
N_FEATURES = sum(WIDTHS)


def _level(x: float, *edges: float) -> int:
    return sum(x > e for e in edges)


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines with a word: feature numbers (a row of ten each) and word counts."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)

        def count(chars, line=line, size=size):
            return size - len(line.translate(None, chars))

        same = line in seen
        seen.add(line)
        rows.append((
            _level(n, 1, 3, 8, 20),
            _level(count(SYMBOLS) / n, 0, 0.05, 0.3, 0.9),
            _level(count(_UPPER) / size, 0.05, 0.2, 0.5),
            _level(count(_DIGITS) / size, 0, 0.05, 0.3),
            _level(count(_PUNCT) / n, 0.02, 0.3, 0.9),
            int(words[-1][-1:] in b".!?"),
            int(same),
            _level(len(set(words)) / n, 0.25, 0.5, 0.8),
            _level(count(_LINKS) / n, 0, 0.2),
            0 if not sizes else 1,
        ))
        sizes.append(n)
    if rows:
        rows[-1] = (*rows[-1][:-1], 2 if len(rows) > 1 else 0)
    return np.array(rows, np.int16).reshape(-1, len(WIDTHS)) + OFFSETS, np.array(sizes, np.int64)


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more in the list, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict = defaultdict(lambda: len(number))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    m = len(number)
    pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]  # ids stay small for any number of words
    _, which, times = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : k + len(twice)] |= twice
    return int(marked.sum())


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = repeated_words(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, symbols, dup, repeat, failed


class Field:
    """A chain with labels 0 (content) and 1 (boilerplate): weights of features, of pairs and of the first label."""

    def __init__(self):
        self.emit, self.move, self.first = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The best labels of one text's lines."""
        scores = self.emit[rows].sum(1)
        best = scores[0] + self.first
        (aa, ab), (ba, bb) = self.move
        x, y = best
        back = []
        for s, t in scores[1:].tolist():
            p, q = x + aa > y + ba, x + ab > y + bb
            back.append((0 if p else 1, 0 if q else 1))
            x, y = s + (x + aa if p else y + ba), t + (x + ab if q else y + bb)
        label = 0 if x >= y else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1])

    def fit(self, texts: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS) -> "Field":
        """Full-batch ascent (Adam) on the mean log-likelihood, with a small ridge; forward-backward over all texts."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        texts, labels = [texts[i] for i in order], [labels[i] for i in order]
        size = np.array([len(x) for x in texts])
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        rows, gold = np.concatenate(texts), np.concatenate(labels)
        live = [start[: np.searchsorted(-size, -t)] + t for t in range(size[0])]  # places of lines number t
        params = [self.emit, self.move, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        hot = np.eye(2)[gold]
        for step in range(1, rounds + 1):
            scores = self.emit[rows].sum(1)
            a, b = np.zeros_like(scores), np.zeros_like(scores)
            a[live[0]] = scores[live[0]] + self.first
            for t in range(1, len(live)):
                was = a[live[t] - 1]
                a[live[t]] = scores[live[t]] + np.logaddexp(was[:, :1] + self.move[0], was[:, 1:] + self.move[1])
            pairs = np.zeros((2, 2))
            z = np.logaddexp(*a[start + size - 1].T)
            for t in range(len(live) - 1, 0, -1):
                at = live[t]
                right = scores[at] + b[at]
                joint = a[at - 1][:, :, None] + self.move + right[:, None, :]
                pairs += np.exp(joint - z[: len(at), None, None]).sum(0)
                b[at - 1] = np.logaddexp(self.move[:, 0] + right[:, :1], self.move[:, 1] + right[:, 1:])
            p = np.exp(a + b - np.repeat(z, size)[:, None])
            emit = np.zeros_like(self.emit)
            for k in range(rows.shape[1]):
                np.add.at(emit, rows[:, k], hot - p)
            follows = np.ones(len(rows), bool)
            follows[start] = False
            true = np.zeros((2, 2))
            np.add.at(true, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
            grads = [emit, true - pairs, (hot - p)[start].sum(0)]
            for i, g in enumerate(grads):
                g = g / len(rows) - 1e-4 * params[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                params[i] += 0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self


def weak_labels(rows: np.ndarray, good: bool) -> np.ndarray:
    """Labels of lines from their document's label: repeats and lines of symbols are boilerplate anywhere."""
    same, symbols = rows[:, 6] == OFFSETS[6] + 1, rows[:, 1] >= OFFSETS[1] + 3
    return np.where(same | symbols | (not good), 1, 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fit the field, or None where one of the two kinds of documents is missing."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = None
    for kind in (0, 1):
        some = marks.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * sample ids are broadcast, and as many documents' features (not texts) reach the driver
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [line_features((x or "").encode("utf-8", "replace").split(b"\n"))[0] for x in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "quality": batch["quality"], "rows": [x.astype(np.int16).tobytes() for x in rows],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = found.mapInPandas(run, f"doc_id {kind}, quality int, rows binary").toPandas().sort_values("doc_id")
    texts = [np.frombuffer(x, np.int16).reshape(-1, len(WIDTHS)).astype(np.int64) for x in got["rows"]]
    kept = [(x, weak_labels(x, q == 1)) for x, q in zip(texts, got["quality"]) if len(x)]
    if len({q for x, q in zip(texts, got["quality"]) if len(x)}) < 2:
        return None
    return Field().fit([x for x, _ in kept], [y for _, y in kept])


def label_lines(text: str | None, field: Field | None) -> tuple[float, list[int]]:
    """Share of words in content lines, and the label of every line that has a word."""
    rows, sizes = line_features((text or "").encode("utf-8", "replace").split(b"\n"))
    if field is None or not len(rows):
        return float(len(rows) > 0), [0] * len(rows)
    labels = field.viterbi(rows)
    return float(sizes[labels == 0].sum() / sizes.sum()), labels.tolist()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict(text: str | None, field: Field | None) -> tuple:
    """The base counts, base_failed, content_share, n_content_lines and kept."""
    base, (share, labels) = base_rules(text), label_lines(text, field)
    return (*base, share, labels.count(0), not base[-1] and share >= MIN_SHARE)


def judge(docs: DataFrame, field: Field | None, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with the base counts, base_failed, content_share, n_content_lines and kept."""
    whole, flag = (T.LongType(), pa.int64()), (T.BooleanType(), pa.bool_())
    fields = {c: whole for c in COUNTS}
    fields |= {"base_failed": flag, "content_share": (T.DoubleType(), pa.float64()), "n_content_lines": whole, "kept": flag}
    return map_texts(docs, keep, lambda texts: zip(*(verdict(x, field) for x in texts)), fields)


def kept_documents(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents that stay, in their own columns."""
    return filter_texts(docs, lambda texts: [verdict(x, field)[-1] for x in texts])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
