"""Operator 5: toxicity of texts after noisy-channel deobfuscation.

A word that mixes letters with digits or symbols, or doubles letters at two places or more, is a noisy form of an intended
word; so is a run of short fragments that may be one or more words spelled out with spaces. The characters form a lattice:
each stands for itself, for the letters it imitates, or for nothing (a separator, a repeat); a space between fragments ends
a word or stands for nothing. Viterbi decoding finds the most likely intended spelling under the channel's costs and a
character trigram model counted over all texts, word ends included. Words of any length are decoded. A run enters the
lattice if two of its fragments are single characters, or if a cue could be read across its spaces (no other reading
could change a score).

The restored words are scored: log-odds of whole words and of their first four to eight letters, learned from at most
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents (chosen by a hash of the id) on one half of them; a logistic
regression on a text's strongest word and the sum of its strong words is fitted on the other half. Words restored from a
run are scored from each of their letters on, as their beginning is uncertain. Character counts cover all rows.

Defined cases: null and empty texts score as a text without any cue; without labels of both kinds every score is 0;
texts are used whole; repeated rows score alike; a score at the threshold counts as toxic, and of readings of one price the first
that the lattice lists holds; an empty table gives an empty table; other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import filter_texts, map_texts, materialize

SAMPLE_TOXIC, SAMPLE_CLEAN, MIN_SUPPORT = 4000, 12000, 4
THRESHOLD = 0.7
STRONG, CLIP, SURE = 2.0, 5.0, 1.28
PREFIXES = (4, 5, 6, 7, 8)
MEMO = 200_000  # words that a task remembers at once

#: Letters that a character can stand for.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
SEPARATORS = frozenset(".-_*'~,/\\|^`\"+=:;· ")
COST_SELF_ODD, COST_IMITATE, COST_DROP, COST_REPEAT, COST_KEEP_SEPARATOR = 6.0, 0.7, 0.5, 0.7, 4.0
#: A space that stands for nothing, by how many of its neighbours are longer than one character.
COST_JOIN = (0.3, 1.2, 2.0)
#: The longest fragment of a run.
FRAGMENT = 4
MARKS = ".,;:?\"'[]{}«»…"
#: Marks in front of a word that can stand for its first letter.
LEADING = "!("
NOT_LETTERS = frozenset(LEADING + MARKS)

#: Character classes of the language model: 0 boundary, 1-26 letters, 27 other letters, 28 digits, 29 the rest.
N_CLASSES = 30
_CLASS = np.full(0x250, 27, np.uint8)
_CLASS[:0xC0] = 29
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 28
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def char_class(c: str) -> int:
    return int(_CLASS[min(ord(c), 0x24F)])


def count_characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class trigrams of one task: rows (cell, n)."""
    total = np.zeros(N_CLASSES**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            raw = np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "replace"), np.uint32)
            for at in range(0, len(raw) - 2, 1 << 20):
                x = _CLASS[np.minimum(raw[at : at + (1 << 20) + 2], 0x24F)].astype(np.int64)
                total += np.bincount((x[:-2] * N_CLASSES + x[1:-1]) * N_CLASSES + x[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})


class Decoder:
    """The channel and the character model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape((N_CLASSES,) * 3) + 0.0
        uni = c.sum((0, 1)) + 1.0
        uni /= uni.sum()
        bi = c.sum(0) + 5.0 * uni
        bi /= bi.sum(1, keepdims=True)
        tri = c + 5.0 * bi
        self.log = np.log(tri / tri.sum(2, keepdims=True)).tolist()

    def restore(self, word: str, repeated: bool | None = None) -> str:
        """The most likely intended spelling of one noisy, lower-case word or run of fragments.

        ``repeated`` says whether a letter like the one before it may stand for nothing (None: if the word repeats itself).
        """
        log = self.log
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for options in lattice(word, repeated):
            after: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, cost in states.items():
                x, y = state
                for out, price, z in options:
                    if out:
                        key, total = (y, z), cost + price - log[x][y][z]
                    else:
                        key, total = state, cost + price
                    if key not in after or total < after[key]:
                        after[key] = total
                        came[key] = (state, out)
            states = after
            back.append(came)
        state = min(states, key=lambda k: states[k] - log[k[0]][k[1]][0])
        found = []
        for came in reversed(back):
            state, out = came[state]
            found.append(out)
        return "".join(reversed(found))

    def runs(self, words: list[str], readable=None) -> Iterator[str]:
        """Words restored from runs of short fragments, which are not words of the text as it stands.

        ``readable(fragments)`` tells whether a run without single characters is worth decoding.
        """
        for run, single in short_runs(words):
            if single > 1 or (readable is not None and readable(run)):
                for w in self.restore(" ".join(run)).split():
                    w = "".join(c for c in w if c.isalpha())
                    if len(w) > 3 and w not in run:
                        yield w

    def clean(self, word: str) -> str:
        """A word as it is scored: stripped of marks at its ends, restored if it looks noisy."""
        bare = word.strip(MARKS + "!()")
        if bare.isalpha() and not repeats(bare):
            return bare
        if not any(map(str.isalpha, bare)):
            return bare
        return "".join(c for c in self.restore(word.strip(MARKS)) if c.isalpha())

    def others(self, word: str) -> Iterator[tuple[str, bool]]:
        """Further spellings that a word may be read as, and whether the channel has to confirm them: with a mark in front that may
        stand for a letter, and with one of two like letters."""
        marked = word[:1] in NOT_LETTERS and word.lstrip(MARKS)[:1] in LEADING
        if not marked and not _DOUBLED.search(word):
            return
        bare = word.strip(MARKS).rstrip("!()")
        if marked and len(bare) > 1:
            yield "".join(c for c in self.restore(bare) if c.isalpha()), False
        bare = bare.lstrip(LEADING)
        if bare.isalpha() and (two := _DOUBLED.search(bare)) and not repeats(bare):
            yield bare[: two.start()] + bare[two.end() :], True


Option = tuple[str, float, int]


def readings(c: str, repeated: bool) -> list[Option]:
    """What a character other than a space can stand for: output (may be empty), price and class of the output."""
    kind = char_class(c)
    if 1 <= kind <= 27:
        return [(c, 0.0, kind), *([("", COST_REPEAT, 0)] if repeated else [])]
    options: list[Option] = [(x, COST_IMITATE, char_class(x)) for x in IMITATES.get(c, "")]
    if c in SEPARATORS:
        options.append(("", COST_DROP, 0))
    return [*options, (c, COST_KEEP_SEPARATOR if c in SEPARATORS else COST_SELF_ODD, kind)]


_KNOWN: dict[tuple[str, bool], list[Option]] = {(chr(c), r): readings(chr(c), r) for c in range(33, 256) for r in (False, True)}


def lattice(word: str, repeated: bool | None = None) -> list[list[Option]]:
    """The readings of each character of a word or run."""
    again, before, out = repeats(word) if repeated is None else repeated, "", []
    for k, c in enumerate(word):
        if c == " ":
            longer = int(k > 1 and word[k - 2] != " ") + int(k + 2 < len(word) and word[k + 2] != " ")
            out.append([(" ", 0.0, 0), ("", COST_JOIN[longer], 0)])
        else:
            key = (c, again and c == before)
            out.append(_KNOWN.get(key) or readings(*key))
        before = c
    return out


_DOUBLED = re.compile(r"(.)(?=\1)", re.S)


def repeats(word: str) -> bool:
    """Whether a letter stands three times in a row, or letters are doubled at two places or more."""
    first = _DOUBLED.search(word)
    return first is not None and _DOUBLED.search(word, first.end()) is not None


def readings_of(starts: set[str]) -> re.Pattern:
    """Whatever may be read as one of these beginnings: each letter as itself or imitated, and between letters what may stand
    for nothing (separators and the letter again). It takes more than the channel does, never less."""
    tree: dict[str, dict] = {}
    for start in starts:
        node = tree
        for c in start:
            node = node.setdefault(c, {})

    def either(node: dict[str, dict]) -> str:
        out = []
        for c, rest in sorted(node.items()):
            same = re.escape(c + "".join(k for k, letters in IMITATES.items() if c in letters))
            out.append(f"[{same}]" + (f"[{same}{between}]*{either(rest)}" if rest else ""))
        return f"(?:{'|'.join(out)})" if out else "(?!)"

    between = re.escape("".join(sorted(SEPARATORS - {" "})))
    return re.compile(either(tree))


def short_runs(words: list[str]) -> Iterator[tuple[list[str], int]]:
    """Two or more short fragments in a row, and how many of them are single characters."""
    run: list[str] = []
    single = 0
    for w in words:
        n = len(w)
        if n <= FRAGMENT:
            run.append(w)
            single += n == 1
        elif run:
            if len(run) > 1:
                yield run, single
            run, single = [], 0
    if len(run) > 1:
        yield run, single


def cues(word: str) -> set[str]:
    """What a restored word is scored by."""
    return {"=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)}


class Scorer:
    """Cue log-odds and the regression's three weights."""

    def __init__(self, decoder: Decoder, odds: dict[str, float], weights=(0.0, 0.0, 0.0), usable=True):
        self.decoder, self.odds, self.weights, self.usable = decoder, odds, weights, usable
        self.memo: dict[str, float] = {}
        self.starts = {c[1:5] for c in odds}
        self.read = readings_of({x for x in self.starts if len(x) == 4})

    def best(self, word: str) -> float:
        if word[:4] not in self.starts:
            return 0.0
        return max((self.odds.get(c, 0.0) for c in cues(word)), default=0.0)

    def word(self, word: str) -> float:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if not self.read.search(word):  # by no readings of its characters is there a cue in it
            self.memo[word] = 0.0
            return 0.0
        clean = self.decoder.clean(word)
        found = self.best(clean) if clean else 0.0
        for other, doubtful in self.decoder.others(word):
            # only what would count more is worth decoding
            if (more := self.best(other)) > found and not (doubtful and self.decoder.restore(clean, True) != other):
                found = more
        self.memo[word] = found
        return found

    def readable(self, run: list[str]) -> bool:
        """Whether a cue's first letters can be read anywhere in a run, by any readings of its characters: if not, what it is
        restored to scores nothing, whatever that is."""
        joined = "".join(run)
        if len(joined) < 4:
            return False
        if joined.isalpha() and not _DOUBLED.search(joined):  # every letter stands for itself
            return any(joined[k : k + 4] in self.starts for k in range(len(joined) - 3))
        return self.read.search(joined) is not None

    def evidence(self, text: str | None) -> tuple[float, float]:
        words = (text or "").lower().split()
        known, found = self.memo, {}
        for w in set(words):
            s = known.get(w)
            if s is None:
                s = self.word(w)
            if s:
                found[w] = s
        for w in self.decoder.runs(words, self.readable):
            found[w] = max(found.get(w, 0.0), *(self.best(w[k:]) for k in range(len(w) - 3)))
        strong = [s for s in found.values() if s > STRONG]
        return max(strong, default=0.0) / CLIP, min(sum(strong), 3 * CLIP) / CLIP

    def score(self, text: str | None) -> float:
        if not self.usable:
            return 0.0
        x, y = self.evidence(text)
        a, b, c = self.weights
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def learn_characters(docs: DataFrame) -> Decoder:
    """Count class trigrams over all rows; 27,000 sums reach the driver."""
    table = docs.select("text").mapInPandas(count_characters, "cell int, n long")
    table = table.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N_CLASSES**3)
    counts[table["cell"].to_numpy(int)] = table["n"]
    return Decoder(counts)


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, both classes weighing alike."""
    x = np.column_stack([np.ones(len(x)), x])
    w, weight = np.zeros(3), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (y - p)) - 0.02 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
        w = w + np.linalg.solve(hess, grad)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from ``docs`` that have a label; the caller leaves out rows that are held out."""
    decoder = learn_characters(docs)
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL")
    sample = sample.dropDuplicates(["doc_id"]).withColumn("half", F.xxhash64(F.lit(1), "doc_id") % 2 == 0)
    sample = materialize(sample, "toxic-sample")
    size = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if any(not size.get((t, h)) for t in (0, 1) for h in (True, False)):
        return Scorer(decoder, {}, usable=False)

    def counter(wanted: set | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter = Counter()
            for batch in batches:
                for text in batch["text"]:
                    each: set[str] = set()
                    words = text.lower().split()
                    for w in {*map(decoder.clean, set(words)), *decoder.runs(words)}:
                        each |= cues(w) if w else set()
                    found.update(each if wanted is None else each & wanted)
            if found:
                yield pd.DataFrame({"cue": list(found), "n": list(found.values())})

        return run

    part = sample.where("half").repartition(min(64, 2 * spark.sparkContext.defaultParallelism), "doc_id")
    toxic = part.where("toxic = 1").select("text").mapInPandas(counter(None), "cue string, n long")
    toxic = toxic.groupBy("cue").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_SUPPORT)
    # bounded by the words of the sample
    seen = {r["cue"]: r["n"] for r in toxic.collect()}
    clean = part.where("toxic = 0").select("text").mapInPandas(counter(set(seen)), "cue string, n long")
    other = {r["cue"]: r["n"] for r in clean.groupBy("cue").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = size[1, True], size[0, True]
    for word in [x[1:] for x in seen if x[0] == "="]:  # a prefix that one word explains says nothing about others
        for prefix in cues(word) - {"=" + word}:
            if seen.get(prefix, 0) * 0.8 <= seen["=" + word]:
                seen.pop(prefix, None)
    odds = {}
    for cue, n in seen.items():
        k = other.get(cue, 0)
        x = math.log((n + 0.5) / (n1 + 1)) - math.log((k + 0.5) / (n0 + 1))
        x -= SURE * math.sqrt(1 / (n + 0.5) + 1 / (k + 0.5))  # a lower bound: few texts prove little
        if x > STRONG:
            odds[cue] = min(x, CLIP)
    scorer = Scorer(decoder, odds)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [scorer.evidence(x) for x in batch["text"]]
            yield pd.DataFrame({"x": [g[0] for g in got], "y": [g[1] for g in got], "toxic": batch["toxic"]})

    rest = sample.where("NOT half").select("text", "toxic").mapInPandas(evidence, "x double, y double, toxic int").toPandas()
    scorer.weights = _regression(rest[["x", "y"]].to_numpy(), rest["toxic"].to_numpy(float))
    scorer.memo = {}
    return scorer


def score(docs: DataFrame, scorer: Scorer, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # cues of the bounded sample and 27,000 floats
    fields = {"score": (T.DoubleType(), pa.float64()), "predicted": (T.IntegerType(), pa.int32())}

    def run(texts: list[str | None]) -> tuple[list[float], list[int]]:
        scores = [shared.value.score(x) for x in texts]
        return scores, [int(s >= THRESHOLD) for s in scores]

    return map_texts(docs, keep, run, fields)


def clean_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents that do not score as toxic, in their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return filter_texts(docs, lambda texts: [shared.value.score(x) < THRESHOLD for x in texts])


def restore_texts(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """doc_id and restored: the words of each text as they are scored, and those restored from runs after them."""

    def restore(text: str | None) -> str:
        words = (text or "").lower().split()
        return " ".join([*map(decoder.clean, words), *decoder.runs(words)])

    return map_texts(docs, ["doc_id"], lambda texts: [list(map(restore, texts))], {"restored": (T.StringType(), pa.string())})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    scorer = train(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, scorer, keep=["doc_id", "held_out"])
