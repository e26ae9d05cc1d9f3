"""Operator 1: language-model scores from a log-frequency Bloom filter of word pairs and triples.

Counting. Every task sums the hashed n-grams (2 to ``ORDER`` words) of its training texts and sends them, packed by the
range of their hash, to buckets. A bucket quantises each count to a level (``EDGES`` holds the least count of each: 1, 2, 3,
4, 6, 8, 12, ...) and enters the n-gram once for every level up to its own in a Bloom filter of its own, sized for its
entries. Every n-gram enters, those seen once as well. The buckets' filters side by side are the filter.

Scoring. The filter grows with the corpus, so no worker can be sent all of it. Documents are dealt to blocks of about
``BLOCK_BYTES`` of text; each block sends its distinct n-grams to the buckets, where the bucket's filter is, and they are
probed level after level until one is missing; levels go back to the block that asked. Nothing passes the driver but sums.
The middle of an n-gram's level stands for its count, as a continuation and as a history alike, and a continuation counts as often as its
history at most, so a history with one continuation gives it all that smoothing leaves:

    P(w | h) = (count(h, w) + MU * P(w | h without its first word)) / (count(h) + MU)

ending at the base model's P(w) (a text's first token has no history of two words), with exact counts of single words from the same exchange. ``MU`` of each order is the
value at which the mass given to the shorter history, on average over all training tokens, is the share of n-grams seen
once (the Good-Turing estimate of the unseen). The probabilities of a history add up to one within half a
step of the levels (a factor of 1.23) and but for false positives.

Words are compared by 64-bit hashes, n-grams by a bucket and 32 more bits; the filters' false positives
(about one in a hundred for each level) are the larger error.

Defined cases: a null or empty text is the closing token alone; without training rows all counts are 0 and only the
smoothing is left; a bucket without n-grams has an empty filter; repeated rows count and score as often as they occur;
null ids are held in training; other columns are not read; texts are used whole; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import block_count, materialize

ORDER = 3
BITS, HASHES = 10, 6
ADD = 0.1
FLUSH = 2_000_000
BLOCK_BYTES = 8 << 20
#: Blocks for each bucket of n-grams.
SHARE = 2
END = b""  # no word is empty

#: The least count of each level from 1 on; level 0 is unseen.
EDGES = np.unique(np.concatenate(([0], np.ceil(1.5 ** np.arange(60))))).astype(np.int64)
LAST = np.append(EDGES[1:] - 1, EDGES[-1])
#: What a level stands for, wherever it is met: the geometric middle of its counts, so that a count is off by half a step at most.
MIDDLE = np.sqrt(EDGES * LAST.astype(float))
LEVELS = len(EDGES)

_U = np.uint64
_END_HASH = xxhash.xxh3_64_intdigest(END)


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def padded(text: str | None) -> list[bytes]:
    """A text's tokens after as many closing tokens as the longest history has."""
    return [END] * (ORDER - 1) + tokens(text)


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of 2 to ORDER words that end at each place; texts are padded."""
    out, g = [], h
    for k in range(2, ORDER + 1):
        before = np.full_like(g, _END_HASH)
        before[1:] = g[:-1]
        g = mix(before * _U(0x9E3779B97F4A7C15) + h + _U(k))
        out.append(g)
    return out


def real_places(sizes: list[int]) -> np.ndarray:
    """The places of tokens that are no padding, for padded texts of these sizes."""
    real = np.ones(sum(sizes), bool)
    starts = np.cumsum([0, *sizes[:-1]])
    for k in range(ORDER - 1):
        real[starts + k] = False
    return real


def keyed(g: np.ndarray, n: int) -> np.ndarray:
    """N-grams as numbers that sort by bucket: bucket and 32 bits."""
    return ((g >> _U(32)) % _U(n)) << _U(32) | (g & _U(0xFFFFFFFF))


def by_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the buckets begin in sorted keys."""
    return np.searchsorted(keys, np.arange(n + 1, dtype=_U) << _U(32))


def planes(x: np.ndarray) -> bytes:
    """Numbers byte after byte of all of them, compressed: what travels is mostly small."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def numbers(blob: bytes, kind: str) -> np.ndarray:
    """The numbers of ``planes``."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def spread(sorted_keys: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as their differences."""
    return planes(np.diff(sorted_keys.astype("<u4"), prepend=np.uint32(0)))


def gather(blob: bytes) -> np.ndarray:
    """The numbers of ``spread``."""
    return np.cumsum(numbers(blob, "<u4"), dtype="<u4")


class Hasher:
    """64-bit hashes of words, remembering some."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 400_000:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), _U, len(words))


COUNTED = pa.schema([("bucket", pa.int32()), ("n_words", pa.int32()), ("grams", pa.binary()), ("times", pa.binary())])


def count_grams(n: int):
    """A task's n-grams as rows (bucket, n_words, grams, times): 32 bits of each hash, and its count."""

    def flush(held: list[np.ndarray], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        real = real_places(sizes)
        for k, g in enumerate(grams(np.concatenate(held)), 2):
            keys, times = np.unique(keyed(g[real], n), return_counts=True)
            cuts = by_bucket(keys, n)
            for b in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[b], cuts[b + 1])
                row = [[b], [k], [spread(keys[at] & _U(0xFFFFFFFF))], [planes(times[at].astype("<u4"))]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, COUNTED)], schema=COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, sizes, size = Hasher(), [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                h = hasher(padded(text.as_py()))
                held.append(h)
                sizes.append(len(h))
                size += len(h)
                if size > FLUSH:
                    yield from flush(held, sizes)
                    held, sizes, size = [], [], 0
        if held:
            yield from flush(held, sizes)

    return run


def probes(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """Places of a level's entries in a filter of ``size`` bits."""
    x = mix((keys & _U(0xFFFFFFFF)) + _U(level * 0xD6E8FEB86659FD93 % 2**64))
    y = mix(x) | _U(1)
    for k in range(HASHES):
        yield ((x + _U(k) * y) % _U(size)).astype(np.int64)


def build_filter(keys: np.ndarray, counts: np.ndarray, room: int = BITS) -> bytes:
    """The filter of distinct n-grams with their counts, with ``room`` bits for each entry."""
    level = np.searchsorted(EDGES, counts, side="right") - 1
    size = max(64, -(-int(level.sum()) * room // 64) * 64)
    bits = np.zeros(size, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= k]
        for at in probes(some, k, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(filt: bytes, keys: np.ndarray) -> np.ndarray:
    """The level of each n-gram: level after level is asked for until one is missing."""
    bits = np.frombuffer(filt, np.uint8)
    level, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for k in range(1, LEVELS):
        hit = np.ones(len(left), bool)
        for at in probes(keys[left], k, 8 * len(bits)):
            hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        left = left[hit]
        if not len(left):
            break
        level[left] = k
    return level


def histogram(counts: np.ndarray) -> np.ndarray:
    """How many counts each level has, and their sum."""
    level = np.searchsorted(EDGES, counts, side="right") - 1
    return np.stack([np.bincount(level, minlength=LEVELS), np.bincount(level, counts, LEVELS).astype(np.int64)]).astype("<i8")


def build_bucket(table: pa.Table, room: int = BITS) -> pa.Table:
    """One bucket's filters, one for each number of words, with the histogram of their counts."""
    rows = {k: ([np.empty(0, "<u4")], [np.empty(0, "<u4")]) for k in range(2, ORDER + 1)}
    for k, g, t in zip(*(table.column(c).to_pylist() for c in ("n_words", "grams", "times"))):
        if g:
            rows[k][0].append(gather(g))
            rows[k][1].append(numbers(t, "<u4"))
    out: dict[str, list] = {"filters": [], "histogram": []}
    for k in rows:
        keys, which = np.unique(np.concatenate(rows[k][0]), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate(rows[k][1]), minlength=len(keys)).astype(np.int64)
        out["filters"].append(build_filter(keys.astype(_U), counts, room))
        out["histogram"].extend(histogram(counts).ravel().tolist())
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "filters": pa.array([out["filters"]], pa.list_(pa.binary())),
        "histogram": pa.array([out["histogram"]], pa.list_(pa.int64())),
    })


@dataclasses.dataclass
class Model:
    """The filters (a table: bucket, filters), how many buckets there are, and the histogram of counts for each order."""

    filters: DataFrame
    buckets: int
    histograms: np.ndarray


def train(docs: DataFrame, room: int = BITS) -> Model:
    """Count and enter the n-grams of the texts of ``docs``; the filters are written once."""
    spark = docs.sparkSession
    n = -(-block_count(docs, BLOCK_BYTES) // SHARE)
    packed = docs.select("text").mapInArrow(count_grams(n), "bucket int, n_words int, grams binary, times binary")
    empty = spark.range(n).select(F.col("id").cast("int").alias("bucket"), F.lit(2).alias("n_words"), F.lit(b"").alias("grams"), F.lit(b"").alias("times"))
    built = packed.unionByName(empty).groupBy("bucket").applyInArrow(lambda table: build_bucket(table, room), "bucket int, filters array<binary>, histogram array<long>")
    built = materialize(built, "filters")
    # sums over all buckets: 2 * LEVELS numbers for each order
    sums = built.select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    found = np.zeros((ORDER - 1) * 2 * LEVELS)
    for row in sums:
        found[row["pos"]] = row["n"]
    return Model(built.select("bucket", "filters"), n, found.reshape(ORDER - 1, 2, LEVELS))


def smoothing(histories: np.ndarray, once: float) -> float:
    """MU, from the histogram of the histories' counts and the number of n-grams seen once."""
    n, total = histories
    some = n > 0
    n, total = n[some], total[some]
    every = total.sum()
    if not every:
        return 1.0
    wanted, mean = min(max(once / every, 1e-6), 0.999), total / n
    low, high = -7.0, 21.0
    for _ in range(60):
        middle = (low + high) / 2
        mu = np.exp(middle)
        low, high = (middle, high) if (total * mu / (mean + mu)).sum() / every < wanted else (low, middle)
    return float(np.exp(low))


def ordered(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words sorted by bucket and hash, the sorting order, and where buckets begin."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    bucket = h % _U(n)
    order = np.lexsort((h, bucket))
    return h[order], order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=_U))


class Block:
    """The distinct words and n-grams of a block's texts."""

    def __init__(self, texts: list[str | None], n: int):
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        number[END]
        ids = [np.fromiter((number[w] for w in padded(x)), np.int64) for x in texts]
        self.sizes = [len(x) for x in ids]
        self.at = np.concatenate(ids)
        self.real = real_places(self.sizes)
        self.hashes, self.order, self.cuts = ordered(list(number), n)
        word = np.empty(len(number), _U)
        word[self.order] = self.hashes
        self.keys, self.which, self.gram_cuts = [], [], []
        for g in grams(word[self.at]):
            keys, which = np.unique(keyed(g[self.real], n), return_inverse=True)
            self.keys.append(keys)
            self.which.append(which)
            self.gram_cuts.append(by_bucket(keys, n))

    def times(self, counts: np.ndarray) -> np.ndarray:
        """How often each word occurs in texts that count, in the order of ``hashes``."""
        weight = np.repeat(counts, self.sizes)
        found = np.bincount(self.at[self.real], weights=weight[self.real], minlength=len(self.order))
        return found[self.order].astype("<u4")


GRAMS = [f"grams{k}" for k in range(2, ORDER + 1)]
ASKED = pa.schema([("bucket", pa.int32()), ("_block", pa.int32()), ("hashes", pa.binary()), ("times", pa.binary()), *((c, pa.binary()) for c in GRAMS)])
ANSWERED = pa.schema([("bucket", pa.int32()), ("_block", pa.int32()), ("counts", pa.binary()), ("histogram", pa.binary()), ("distinct", pa.int64()), *((c, pa.binary()) for c in GRAMS)])


def ask(n: int):
    def run(rows: pa.Table) -> pa.Table:
        """A block's distinct words, their counts in its training texts, and its distinct n-grams, for every bucket."""
        block = Block(rows.column("text").to_pylist(), n)
        times = block.times(np.array([not x for x in rows.column("held_out").to_pylist()], float))
        cut = lambda x, cuts: [planes(x[a:b]) for a, b in zip(cuts, cuts[1:])]
        lists = [list(range(n)), [rows.column("_block")[0].as_py()] * n, cut(block.hashes, block.cuts), cut(times, block.cuts)]
        lists += [[spread(keys[a:b] & _U(0xFFFFFFFF)) for a, b in zip(cuts, cuts[1:])] for keys, cuts in zip(block.keys, block.gram_cuts)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(lists, ASKED)], schema=ASKED)

    return run


def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """A bucket's word counts and the levels of n-grams, for each block in the order it asked."""
    if not asked.num_rows:
        return ANSWERED.empty_table()
    hashes = [numbers(x, "<u8") for x in asked.column("hashes").to_pylist()]
    times = np.concatenate([numbers(x, "<u4") for x in asked.column("times").to_pylist()])
    words, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=times, minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, hashes)])
    rows = asked.num_rows
    lists = [asked.column("bucket").to_pylist(), asked.column("_block").to_pylist(), [planes(total[which[a:b]].astype("<i8")) for a, b in zip(cuts, cuts[1:])]]
    lists += [[histogram(total).tobytes()] * rows, [int((total > 0).sum())] * rows]
    for filt, c in zip(model.column("filters")[0].as_py(), GRAMS):
        lists.append([planes(probe(filt, gather(x).astype(_U))) for x in asked.column(c).to_pylist()])
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(lists, ANSWERED)], schema=ANSWERED)


WHOLE = ("n_tokens", "n_known", "train_tokens")
MORE = ("n_pairs", "n_triples", "n_again")


def finish(n: int, histograms: np.ndarray):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["doc_id", "held_out"]).append_column("n_tokens", pa.array([], pa.int64()))
        answers = answers.sort_by("bucket")
        block = Block(rows.column("text").to_pylist(), n)
        count = np.empty(len(block.order), np.int64)
        count[block.order] = np.concatenate([numbers(x, "<i8") for x in answers.column("counts").to_pylist()])
        words = sum(np.frombuffer(x, "<i8") for x in answers.column("histogram").to_pylist()).reshape(2, LEVELS)
        all_, distinct = int(words[1].sum()), sum(answers.column("distinct").to_pylist())
        at = block.at
        base = ((count + ADD) / (all_ + ADD * (distinct + 1)))[at]
        p, before, tables = base, count[at], [words, *histograms]
        found = {"base_score": np.log10(base), "n_known": count[at] > 0, "n_tokens": np.ones(len(at))}
        levels = []
        for k, (c, which) in enumerate(zip(GRAMS, block.which)):
            level = np.zeros(len(at), np.int64)
            level[block.real] = np.concatenate([numbers(x, "u1") for x in answers.column(c).to_pylist()])[which]
            mu = smoothing(tables[k], histograms[k][0][1])
            history = np.concatenate(([0], before[:-1]))
            p = (np.minimum(MIDDLE[level], history) + mu * p) / (history + mu)
            before = MIDDLE[level]
            levels.append(level)
        found |= {"score": np.log10(p), "n_pairs": levels[0] > 0, "n_triples": levels[-1] > 0, "n_again": levels[-1] > 1}
        starts = np.cumsum([0, *block.sizes[:-1]])
        columns = {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out")}
        found["train_tokens"] = None
        for c in (*WHOLE, "base_score", "score", *MORE):
            if c == "train_tokens":
                columns[c] = pa.array([all_] * rows.num_rows, pa.int64())
                continue
            x = np.add.reduceat(np.where(block.real, found[c], 0.0), starts)
            columns[c] = pa.array(x, pa.float64()) if c in ("base_score", "score") else pa.array(x.astype(np.int64))
        return pa.table(columns)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): the contract's columns, and how many pairs and triples are known, and
    triples known more than once."""
    n = model.buckets
    blocks = block_count(docs, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = docs.select("doc_id", "text", "held_out", block.alias("_block")).repartition(blocks, "_block")
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    ddl = lambda schema: ", ".join(f"{f.name} {names[f.type]}" for f in schema)
    asked = blocked.groupBy("_block").applyInArrow(ask(n), ddl(ASKED))
    answers = asked.groupBy("bucket").cogroup(model.filters.groupBy("bucket")).applyInArrow(answer, ddl(ANSWERED))
    fields = [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in WHOLE)]
    fields += [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")] + [T.StructField(c, T.LongType()) for c in MORE]
    return blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(finish(n, model.histograms), T.StructType(fields))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    return score(docs, train(docs.where(~F.col("held_out"))))
