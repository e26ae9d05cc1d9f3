"""Operator 4: pack documents into sequences by a configuration linear program over the lengths.

Documents are tokenized (every distinct word of the corpus once), cut at the sequence length, and only the histogram of
piece lengths, at most ``LENGTH`` rows, goes to the driver. There the program over configurations (multisets of
lengths that fit a sequence) is solved by multiplicative weights: a length's price falls as its share of covered pieces grows,
and a knapsack dynamic program finds the best configurations at the current prices, until nearly all need is covered.
Amounts are rounded to whole sequences, and what is left goes by best fit into the free room, on the histogram as well. Prices
give a lower bound on the sequences. Pieces then learn their place from their rank among the pieces of their length.

Defined cases: a null or empty text is one piece with the closing id alone; an empty table gives an empty table;
repeated rows and null ids are packed as any other; other columns are not read; texts are tokenized whole.
"""

from __future__ import annotations

import dataclasses
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import materialize, running_sum
from talus.llm.word_values import value_words

LENGTH, CLOSING_ID = 2048, 0
#: Of the program: how fast prices fall, how much dearer long pieces are, how far below the best a configuration may be, what a round
#: may take of what is left and of the need, and the share of all ids that is left to best fit.
RATE, TILT, SLACK, STEP, LEAST, REST = 2.0, 0.3, 0.2, 0.5, 0.1, 0.01
#: What a configuration may lose where a size in it has run out: at first, and at last, when nothing else is left.
TRIM = (0.002, 0.03)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By dynamic programming, for every room: the value of its best filling, and the size that is taken last in it (0: the
    room is that of one less). ``price[l]`` is that of size l; sizes that are not for sale have a negative one."""
    size = len(price) - 1
    best, choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    sold = np.flatnonzero(price > 0)
    low, high = (int(sold[0]), int(sold[-1])) if len(sold) else (size + 1, 0)
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        if (top := min(high, room)) >= low:
            gains = price[low : top + 1] + best[room - top : room - low + 1][::-1]
            k = int(gains.argmax())
            if gains[k] > best[room]:
                best[room], choice[room] = gains[k], low + k
    return best, choice


def filling(choice: np.ndarray, first: int, may: np.ndarray) -> dict[int, int]:
    """The size ``first`` and the best filling of the room beside it, with no size more often than it ``may``.

    Where the best filling takes a size too often, that of one less room is looked at.
    """
    items, room = {first: 1}, len(choice) - 1 - first
    while room > 0:
        size = int(choice[room])
        if size and items.get(size, 0) < may[size]:
            items[size] = items.get(size, 0) + 1
            room -= size
        else:
            room -= 1
    return items


Plan = list[tuple[dict[int, int], int]]


@dataclasses.dataclass
class Solution:
    """Configurations with how often each is used, which together hold every piece exactly once; a lower bound on the
    sequences; pieces shorter than a sequence, and how many of them the program's configurations placed."""

    plan: Plan
    bound: int
    pieces: int
    placed: int


def dual_bound(price: np.ndarray, need: np.ndarray) -> int:
    """No packing has fewer sequences than the value of all pieces by that of the best configuration, at any prices."""
    best = knapsack(price)[0][-1]
    return int(np.ceil(price @ need / best - 1e-6)) if best > 0 else 0


def program(left: np.ndarray, size: int) -> tuple[Plan, np.ndarray]:
    """Configurations for most of the pieces, which are taken from ``left`` (how many of each size), and the last prices.

    Multiplicative weights: a size's price is its length, tilted towards long ones, and falls by exp(-RATE * share) as the
    covered share of its need grows. The knapsack's dynamic program prices all configurations of a round at once: the best
    one that has a given size is that size and the best filling of the room beside it. Those within ``SLACK`` of the best of all are taken,
    long sizes first, each as often as its scarcest size allows of what it may give in the round (``STEP`` of what is left, or
    ``LEAST`` of its need). Amounts are rounded down to whole sequences as they are taken, and what that leaves is priced again, so every
    configuration holds real pieces. The program ends when ``REST`` of all ids is left.
    """
    need, lengths, plan = left.copy(), np.arange(size + 1), []
    tilted = lengths * (1 + TILT * lengths / size)
    price, trim = tilted.astype(float), TRIM[0]
    while lengths @ left > REST * (lengths @ need):
        price = tilted * np.exp(-RATE * (1 - left / np.maximum(need, 1)))
        sold = np.where(left > 0, price, -1.0)
        best, choice = knapsack(sold)
        before = len(plan)
        may = np.minimum(left, np.ceil(np.maximum(STEP * left, LEAST * need)).astype(np.int64))
        worth = np.where(left > 0, sold + best[size - lengths], -1.0)
        for length in np.flatnonzero(worth >= (1 - SLACK) * best[size])[::-1].tolist():
            while may[length]:
                items = filling(choice, length, may)
                if sum(sold[k] * n for k, n in items.items()) < (1 - trim) * worth[length]:
                    break
                often = min(int(may[k]) // n for k, n in items.items())
                plan.append((items, often))
                for k, n in items.items():
                    left[k] -= n * often
                    may[k] -= n * often
        if len(plan) == before:
            trim *= 2
            if trim > TRIM[1]:
                break
    return plan, price


def solve(histogram: dict[int, int], size: int = LENGTH) -> Solution:
    """Pack pieces with the lengths of ``histogram`` into sequences of ``size``: the program's configurations, then best fit for
    the rest of its rounding."""
    need = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    left, lengths = need.copy(), np.arange(size + 1)
    made: Plan = [({size: 1}, int(need[size]))] if need[size] else []
    left[size] = 0
    pieces = int(left.sum())
    found, price = program(left, size)
    placed = pieces - int(left.sum())
    even = np.concatenate([[0.0], 1 / (size // lengths[1:])])  # sizes of which as many fit are worth the same
    bound = max(-(-int(lengths @ need) // size), dual_bound(price, need), dual_bound(even, need))
    return Solution(best_fit(made + found, left, size), bound, pieces, placed)


def best_fit(found: Plan, left: np.ndarray, size: int) -> Plan:
    """Put the pieces that are left into the free room of the configurations, by groups of equal sequences."""
    free: dict[int, list[list]] = defaultdict(list)
    for items, often in found:
        free[size - sum(length * n for length, n in items.items())].append([items, often])
    for length in range(size, 0, -1):
        while left[length]:
            room = next((r for r in range(length, size) if free[r]), None)
            if room is None:
                often, each = divmod(int(left[length]), size // length), size // length
                if often[0]:
                    free[size - each * length].append([{length: each}, often[0]])
                if often[1]:
                    free[size - often[1] * length].append([{length: often[1]}, 1])
                left[length] = 0
                break
            items, often = free[room].pop()
            used = min(often, int(left[length]))
            if used < often:
                free[room].append([items, often - used])
            free[room - length].append([items | {length: items.get(length, 0) + 1}, used])
            left[length] -= used
    return [(items, often) for groups in free.values() for items, often in groups]


def places(plan: list[tuple[dict[int, int], int]], size: int = LENGTH) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset) sorted by length and rank."""
    rows, rank, sequence = [], [0] * (size + 1), 0
    for items, often in plan:
        offset = 0
        for length, n in items.items():
            rows.append((length, rank[length], often, sequence, offset))
            rank[length] += n * often
            offset += n * length
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenized(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids as unsigned 32-bit little-endian bytes).

    Words are cut at ASCII white space, which the tokenizer drops before it looks at what is left and right of it, so
    a text's ids are its words' ids in order.
    """

    def value(words: list[bytes]) -> list[bytes]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Tokenizer.from_file(tokenizer)
        code = {"<u2": "H", "<u4": "I"}[id_kind(encode.get_vocab_size())]
        out: list[bytes] = []
        for lo in range(0, len(words), 1000):
            some = [w.decode("utf-8") for w in words[lo : lo + 1000]]
            out.extend(array(code, x.ids).tobytes() for x in encode.encode_batch_fast(some, add_special_tokens=False))
        return out

    marks: dict[bytes, bytes] = {}

    class Ids(dict):
        """The ids of each word as it is written: those of its stem, which stands for itself, and of its closing mark."""

        def __missing__(self, word: bytes) -> bytes:
            body, mark = stem(word)
            found = self[word] = self[body] + (marks[mark] if mark else b"")
            return found

    def finish(rows: pa.Table, values: dict[bytes, bytes]) -> pa.Table:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(tokenizer)
        kind = id_kind(encode.get_vocab_size())
        for mark in MARKS:
            marks[mark] = np.array(encode.encode(mark.decode(), add_special_tokens=False).ids, kind).tobytes()
        ids_of, closing = Ids(values), np.array([CLOSING_ID], kind).tobytes()
        out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "ids")}
        for row, text in enumerate(rows.column("text")):
            ids = np.frombuffer(b"".join(map(ids_of.__getitem__, split(text.as_py()))) + closing, kind).astype("<u4")
            for piece, at in enumerate(range(0, len(ids), LENGTH)):
                part = ids[at : at + LENGTH].tobytes()
                for name, x in zip(out, (row, piece, at, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                    out[name].append(x)
        columns = {"doc_id": rows.column("doc_id").take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
        columns |= {c: pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")}
        return pa.table(columns | ({"ids": pa.array(out["ids"], pa.binary())} if with_ids else {}))

    whole = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *whole, *([T.StructField("ids", T.BinaryType())] * with_ids),
    ])
    # as bytes, which are what words and their values are
    return value_words(docs.select("doc_id", F.col("text").cast("binary").alias("text")), split, stem, value, finish, schema)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary < 1 << 16 else "<u4"


MARKS = (b".", b",")


LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def stem(word: bytes) -> tuple[bytes, bytes]:
    """A word of Latin letters in lower case, and a closing mark: the tokenizer takes such words in lower case, and
    letters and marks apart. Any other word stays as it is."""
    if word.isalpha():  # ASCII letters
        return word.lower(), b""
    body, mark = (word[:-1], word[-1:]) if word[-1:] in MARKS else (word, b"")
    if body.isalpha():
        return body.lower(), mark
    text = body.decode("utf-8")
    return (text.lower().encode("utf-8"), mark) if LATIN.fullmatch(text) else (word, b"")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, tokenizer or public_tokenizer(), with_ids), "pieces")
    # at most LENGTH rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for length in sorted(histogram):
        before[length], total = total, total + histogram[length]
    table = places(solve(histogram).plan)
    # a row for each length of each configuration: bounded by the configurations and LENGTH, whatever the corpus
    shared = spark.sparkContext.broadcast((table, before))
    ranked = running_sum(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "piece", "ids_crc32"], "_one", "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, before = shared.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy(np.int64)
            rank = batch.pop("_rank").to_numpy(np.int64) - 1 - batch["length"].map(before).to_numpy(np.int64)
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            copy, at = np.divmod(rank - row[:, 1], row[:, 2])
            batch["sequence_id"], batch["offset"] = row[:, 3] + at, row[:, 4] + copy * length
            yield batch

    ranked = ranked.drop("_one")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
