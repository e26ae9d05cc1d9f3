"""Operator 7: self-join on Jaccard similarity of word shingles, by chosen paths.

Texts with equal shingle sets are one set with a weight. A set is embedded as ``WIDTH`` minima of hashed shingles. A run
starts from all sets; a node of its tree samples coordinates, each with probability 1 / (``SAMPLED`` * ``WIDTH``), and
sends every set to one child for each sampled coordinate, named by the set's value there, so that sets that share the
sampled token meet. Nodes of at most ``SPLIT`` sets are compared by brute force; larger ones are split again on fresh
coordinates until they are small. The number of runs follows from the chance that two sets at the threshold stay together
on some path, and ``RECALL``.

Large groups of copies never fall apart that way, so they are collapsed: in a large node every set meets about ``PIVOTS``
sampled ones and takes the label of those it agrees with. Sets with one label are in one candidate group already; a node
with one label only is closed, and one with at most ``SPLIT`` sets besides its largest label is finished by letting those
meet all others. The rows made are in proportion to the sets in a node.

Agreement of minima only forms candidate groups (with a margin of four standard deviations below the threshold). Within a
group all pairs of shingle sets are then compared exactly, as products of bounded matrices in one task for a group of up to
``BLOCK`` sets, and for larger groups in pairs of packed blocks (one row for each block of up to ``BLOCK`` sets or
``BLOCK_BYTES`` bytes). A pair counts once whatever runs found it; links are summed by set and classes are the connected
components of exact links. The links of a group of n different texts are counted, never emitted: rows grow with the
square of n / ``BLOCK``, arithmetic with the number of links.

Defined cases: a text of one to four words has one shingle, all its words; null texts and texts without words link to
nothing; equal texts are links of each other; null ids are kept (a class of such rows only has a null id); texts are used
whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import discard, free_name, gathered, in_groups, map_texts, materialize
from talus.llm.components import components

WORDS, THRESHOLD = 5, 0.8
WIDTH, SAMPLED, SPLIT, PIVOTS, RECALL = 128, 0.6, 1500, 64, 0.999
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Bytes of a shingle's hash that are compared.
SHINGLE = 5
CANDIDATE = math.floor(WIDTH * THRESHOLD - 4 * math.sqrt(WIDTH * THRESHOLD * (1 - THRESHOLD)))

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_ODD = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of unsigned numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(threshold=THRESHOLD, sampled=SAMPLED, recall=RECALL) -> int:
    """Runs needed: the pair is lost in one run with the chance that a branching process dies out."""
    lost = 0.0
    for _ in range(1000):
        lost = math.exp(-threshold / sampled * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingle_set(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, _U)
    if len(memo) > 300_000:
        memo.clear()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), _U, len(words))
    n = min(WORDS, len(words))
    total = np.zeros(len(words) - n + 1, _U)
    for k in range(n):
        total = mix(total + h[k : len(h) - n + 1 + k] + _U(k + 1))
    return np.unique(total)


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(WIDTH, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] + _ADD) * _ODD).min(0), out=least)
    return (least >> _U(32)).astype(np.uint32)


def describe(texts: list[str | None]) -> tuple[list, ...]:
    """Key, first nodes, low bytes of the minima and 40-bit shingles of each text; null for texts without words."""
    memo: dict[bytes, int] = {}
    _, at, name = sampled(mix(np.arange(1, runs() + 1, dtype=_U) * _U(0xA24BAED4963EE407)))  # the runs' roots hold all sets
    out: tuple[list, ...] = ([], [], [], [])
    for text in texts:
        shingles = shingle_set(text, memo)
        found: tuple = (None,) * 4
        if len(shingles):
            least = minima(shingles)
            nodes, short = child(name, least[at]), shingles.view(np.uint8).reshape(-1, 8)[:, 8 - SHINGLE :]
            found = (xxhash.xxh3_128_digest(shingles.tobytes()), nodes.tobytes(), least.astype(np.uint8).tobytes(), short.tobytes())
        for column, x in zip(out, found):
            column.append(x)
    return out


def sampled(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its sampled coordinates: positions in ``node``, coordinates, and the hash of both."""
    name = mix(node.astype(_U)[:, None] + np.arange(1, WIDTH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    row, at = np.nonzero(name < _U(int(2**64 / (SAMPLED * WIDTH))))
    return row, at, name[row, at]


def child(name: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The name of the child for a sampled coordinate and a set's value there."""
    return mix(name + value.astype(_U) * _U(0xD6E8FEB86659FD93)).astype(np.int64)


def stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, WIDTH)


def first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            nodes = np.frombuffer(b"".join(batch["nodes"]), np.int64)
            yield pd.DataFrame({"node": nodes, "key": np.repeat(batch["key"].to_numpy(), len(nodes) // len(batch))})


def next_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children of large nodes, named by the minima's low bytes (which only lets a few more sets meet)."""
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.iloc[lo : lo + 2000]
            row, at, name = sampled(part["node"].to_numpy(np.int64))
            nodes = child(name, stack(part["minima"])[row, at])
            yield pd.DataFrame({"node": nodes} | {c: part[c].to_numpy()[row] for c in ("key", "minima", "label")})


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` things' component under links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def agreeing(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of minima that agree in at least CANDIDATE places."""
    pairs = []
    for lo in range(0, len(one), 32):
        agree = (one[lo : lo + 32, None, :] == two[None, :, :]).sum(2)
        x, y = np.nonzero(agree >= CANDIDATE)
        pairs.append((lo + x, y))
    x, y = (np.concatenate(p) for p in zip(*pairs))
    return x, y


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between sets of a small node that agree in enough minima; as many as a spanning forest has."""
    out_a, out_b = [], []
    for group in in_groups(batches, ["node"]):
        if len(group) < 2:
            continue
        keys, values = group["key"].to_numpy(), stack(group["minima"])
        root = forest(len(keys), *agreeing(values, values))
        linked = np.flatnonzero(root != np.arange(len(keys)))
        out_a.extend(keys[linked])
        out_b.extend(keys[root[linked]])
        if len(out_a) > 20_000:
            yield pd.DataFrame({"a": out_a, "b": out_b})
            out_a, out_b = [], []
    if out_a:
        yield pd.DataFrame({"a": out_a, "b": out_b})


def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each share of a large node meets the node's asked sets: new labels, and edges (key, near) to other sets."""
    for group in in_groups(batches, ["node", "share"]):
        group = group.sort_values(["asked", "key"], ascending=[False, True])
        keys, values, old = group["key"].to_numpy(), stack(group["minima"]), group["label"].to_numpy(np.int64)
        n, asked = len(keys), int(group["asked"].sum())
        x, y = agreeing(values, values[:asked]) if asked else (np.empty(0, int),) * 2
        x, y = x[x != y], y[x != y]
        _, first, which = np.unique(old, return_index=True, return_inverse=True)
        same = np.flatnonzero(old != 0)  # one label is one candidate group already
        root = forest(n, np.concatenate((x, same)), np.concatenate((y, first[which[same]])))
        linked = np.zeros(n, bool)
        linked[x] = linked[y] = True
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, n) | _U(1)
        label = np.where(root < asked, names[root].astype(np.int64), old)
        new = linked & (root != np.arange(n)) & ((old == 0) | (old != old[root]))
        near = np.full(n, None, object)
        near[new] = keys[root[new]]
        stay = np.arange(n) >= asked
        out = stay | new
        yield pd.DataFrame({
            "node": group["node"].to_numpy()[out], "key": keys[out], "minima": group["minima"].to_numpy()[out],
            "label": label[out], "near": near[out], "on": (stay & group["on"].to_numpy(bool))[out],
        })


def intersections(one: list[np.ndarray], two: list[np.ndarray], same: bool = False) -> np.ndarray:
    """Sizes of the intersections of all sets in ``one`` with all in ``two``, as sums of products of bounded matrices.

    With ``same`` (one block with itself) shingles of a single set are left out; the diagonal means nothing then.
    """
    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    (u, i), (v, j) = flat(one), flat(two)
    if same:
        shared, times = np.unique(u, return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(u, v)
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, len(shared), 2048):
        part = shared[lo : lo + 2048]
        sides = []
        for x, k, n in ((u, i, len(one)),) if same else ((u, i, len(one)), (v, j, len(two))):
            at = np.minimum(np.searchsorted(part, x), len(part) - 1)
            hit = part[at] == x
            m = np.zeros((n, len(part)), np.float32)
            m[k[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[-1].T
    return out


def shingles_of(blob: bytes) -> np.ndarray:
    """Packed hashes as numbers."""
    wide = np.zeros((len(blob) // SHINGLE, 8), np.uint8)
    wide[:, 8 - SHINGLE :] = np.frombuffer(blob, np.uint8).reshape(-1, SHINGLE)
    return wide.view(_U).ravel()


def count_links(one: tuple, two: tuple | None) -> pd.DataFrame:
    """Per set of one block, or of two: the weight of the sets it links to, and the smallest it is connected with.

    A block is its keys, weights and sets of shingles.
    """
    same = two is None
    (keys, weight, sets), (other, heavy, far) = one, one if same else two
    both = intersections(sets, far, same)
    size = np.array([len(x) for x in sets]), np.array([len(x) for x in far])
    # |A and B| >= t |A or B|, in whole numbers
    t = int(THRESHOLD * 10)
    linked = both * (10 + t) >= (size[0][:, None] + size[1][None, :]) * t - 0.5
    if same:
        np.fill_diagonal(linked, False)
    x, y = np.nonzero(linked)
    if same:
        root = forest(len(keys), x, y)
        return pd.DataFrame({"key": keys, "links": linked @ weight, "near": keys[root]})
    root = forest(len(keys) + len(other), x, len(keys) + y)
    every = np.concatenate((keys, other))
    return pd.DataFrame({"key": every, "links": np.concatenate((linked @ heavy, weight @ linked)), "near": every[root]})


def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within groups of one block."""
    for group in in_groups(batches, ["root"]):
        if len(group) > 1:
            yield count_links((group["key"].to_numpy(), group["weight"].to_numpy(np.int64), list(map(shingles_of, group["shingles"]))), None)


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block of a large group."""
    for group in in_groups(batches, ["root", "block"]):
        yield pd.DataFrame({
            "root": [group["root"].iat[0]], "block": [group["block"].iat[0]], "blocks": [group["blocks"].iat[0]],
            "keys": [b"".join(group["key"])], "weights": [group["weight"].to_numpy(np.int64).tobytes()],
            "sizes": [(group["shingles"].str.len().to_numpy() // SHINGLE).astype("<u4").tobytes()], "sets": [b"".join(group["shingles"])],
        })


def exact_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between two packed blocks, or within one."""
    def unpacked(row) -> tuple:
        keys = np.array([row.keys[k : k + 16] for k in range(0, len(row.keys), 16)], object)
        cuts = np.cumsum(np.frombuffer(row.sizes, "<u4").astype(np.int64))[:-1]
        return keys, np.frombuffer(row.weights, np.int64), np.split(shingles_of(row.sets), cuts)

    columns = ["keys", "weights", "sizes", "sets"]
    for group in in_groups(batches, ["root", "left", "right"]):
        blocks = [unpacked(row) for row in group[columns].itertuples(index=False, name="Block")]
        yield count_links(blocks[0], blocks[1] if len(blocks) > 1 else None)


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between keys: a spanning forest of each candidate group, some edges repeated. ``sets`` has key, nodes, minima."""
    first = sets.select("key", "nodes").mapInPandas(first_level, "node long, key binary")
    rows, edges, level = materialize(first, "nodes"), [], 0
    while True:
        level += 1
        # the tables joined here grow with the corpus: by sorting at every size, never by broadcast
        if level == 1:
            stats = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("*", F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("main"))
            met = rows.join(stats.hint("merge"), "node").join(sets.select("key", "minima").hint("merge"), "key").withColumn("label", F.lit(0).cast("long"))
        else:
            stats = rows.groupBy("node", "label").agg(F.count("*").alias("m"))
            labelled = F.when(F.col("label") != 0, F.struct("m", "label"))
            stats = stats.groupBy("node").agg(F.sum("m").alias("n"), F.max(labelled).alias("top"))
            stats = stats.select("node", "n", F.coalesce("top.m", F.lit(0)).alias("most"), F.coalesce("top.label", F.lit(0)).alias("main"))
            met = rows.join(stats.where("n > 1 AND most < n").hint("merge"), "node")
        met = materialize(met.select("node", "key", "minima", "label", "n", "most", "main"), "met")
        small = gathered(met.where(F.col("n") <= SPLIT).select("node", "key", "minima"), "node")
        edges.append(materialize(small.mapInPandas(compare, "a binary, b binary").distinct(), "found"))
        large = met.where(F.col("n") > SPLIT)
        discard(rows)
        if large.isEmpty():
            discard(met)
            return functools.reduce(DataFrame.unionByName, edges)
        on = F.col("n") - F.col("most") > SPLIT
        chance = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) / (1 << 30)
        asked = F.when(on, chance < PIVOTS / F.col("n")).otherwise(F.col("label") != F.col("main"))
        shares = F.ceil(F.col("n") / SPLIT).cast("int")
        columns = ["node", "key", "minima", "label", on.alias("on")]
        members = large.select(*columns, F.pmod(F.xxhash64("key", F.lit(3)), shares).alias("share"), F.lit(False).alias("asked"))
        others = large.where(asked).select(*columns, F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(True).alias("asked"))
        done = gathered(members.unionByName(others.withColumn("share", F.col("share").cast("int"))), "node", "share")
        done = materialize(done.mapInPandas(meet, "node long, key binary, minima binary, label long, near binary, on boolean"), "labelled")
        edges.append(materialize(done.where("near IS NOT NULL").select(F.col("key").alias("a"), F.col("near").alias("b")).distinct(), "found"))
        going = done.where("on").select("node", "key", "minima", "label")
        rows = materialize(going.mapInPandas(next_level, "node long, key binary, minima binary, label long"), "nodes")
        discard(met, done)


def classes(docs: DataFrame, keep=()) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class), class_size, n_links, chosen, ``keep`` columns.

    ``chosen`` is true for the rows that have the smallest id of their class (and, among equal ids, the least of
    ``keep``). Kept columns may have any name but those.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    blob = (T.BinaryType(), pa.binary())
    kept = [f"_kept{k}" for k in range(len(keep))]
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)))
    described = map_texts(named, ["doc_id", *kept], describe, {"key": blob, "nodes": blob, "minima": blob, "shingles": blob})
    described = materialize(described.withColumn("_rid", F.monotonically_increasing_id()), "described")
    members = described.select("doc_id", "key", *kept)
    own = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", *kept)  # null ids come last
    sets = described.where("key IS NOT NULL").groupBy("key")
    sets = sets.agg(
        F.count("*").alias("weight"), F.min("_rid").alias("_rid"), F.min(own).alias("_least"),
        F.first(F.struct("nodes", "minima")).alias("_sketch"),
    )
    sets = materialize(sets.select("key", "weight", "_rid", "_least", "_sketch.*"), "sets")

    groups = materialize(components(candidates(sets)).withColumnRenamed("node", "key"), "groups")
    grouped = groups.hint("merge").join(sets.select("key", "weight", "_rid"), "key")
    shingles = described.select("_rid", "shingles")
    rows = materialize(grouped.hint("merge").join(shingles, "_rid").drop("_rid"), "grouped")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.join(sizes.select("root", blocks.alias("blocks")).hint("merge"), "root")
    linked = "key binary, links long, near binary"
    one = gathered(rows.where("blocks = 1").drop("blocks"), "root").mapInPandas(exact, linked)
    many = rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    packs = "root binary, block int, blocks int, keys binary, weights binary, sizes binary, sets binary"
    many = materialize(gathered(many, "root", "block").mapInPandas(packed, packs), "packed")
    # a row here is a whole block of sets
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumn("left", F.least("block", "_other")).withColumn("right", F.greatest("block", "_other"))
    many = gathered(many.drop("block", "blocks", "_other"), "root", "left", "right").mapInPandas(exact_pairs, linked)
    linked = materialize(one.unionByName(many), "linked")
    joined = components(linked.select(F.col("key").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "key")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))

    sets = sets.drop("nodes", "minima", "_rid").join(joined, "key", "left").join(links, "key", "left")
    sets = sets.withColumn("root", F.coalesce("root", "key"))
    sets = sets.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    sets = materialize(sets.drop("links"), "linked-sets")
    found = sets.groupBy("root").agg(F.sum("weight").alias("class_size"), F.min("_least").alias("_first"))
    found = sets.join(found, "root").select("key", "n_links", "class_size", "_first")
    one = members["key"] == found["key"]
    out = members.join(found, one, "left")
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).cast(id_kind).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | own.eqNullSafe(F.col("_first"))).alias("chosen"),
        *(F.col(k).alias(c) for c, k in zip(keep, kept)),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, in the columns of ``docs`` (of any names); texts without words all stay."""
    text = free_name(docs.columns, "_text")
    hashed = docs.withColumn(text, F.xxhash64("text"))
    stay = classes(hashed, keep=[text]).where("chosen")
    stay = stay.select(F.col("doc_id").alias("_stay_id"), F.col(text).alias("_stay_text")).distinct()
    same = hashed["doc_id"].eqNullSafe(stay["_stay_id"]) & (hashed[text] == stay["_stay_text"])
    kept = hashed.join(stay, same, "left_semi")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit("")) == ""
    worded = kept.where(~blank).dropDuplicates(["doc_id", text])
    return worded.unionByName(hashed.where(blank)).drop(text)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "class_size", "n_links")
