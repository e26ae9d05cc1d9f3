"""Operator 12: a Merkle manifest of a table, with a proof for every row.

Every leaf gets its index by a range sort and the counts of the ranges. The trees grow by events, as in a combineByKey:
a task keeps partial parents, each with its children's digests by place, until a parent has as many children as the
number of nodes on its level says; then it emits the parent, which is a child of the next one. What stays unresolved in
a task, the frontier, is dealt anew by an ancestor three levels further up, round after round. The roots of all sources
are the leaves of one more such tree. Links from children to parents, followed from the top, give every run of leaves
the siblings on its way to the root.

Defined cases: a null in any column has its own mark in the leaf; a null source is a tree of its own, first in order; an
empty table gives an empty table; an empty text is a value of length 0; null ids come before all others; rows equal in
source and id are put in order by their leaf, and wholly equal rows are interchangeable neighbours; columns other than
those named are not read, whatever their names.

A task holds partial parents of what it reads, and a group that is dealt anew has at most 4096 nodes of the lowest level
that is still open, however large a source is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import materialize, partitions

#: Children of a node as a power of two, and the levels that one round resolves.
BITS, LEVELS = 4, 3
ARITY = 1 << BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parent_digest(kids: bytes) -> bytes:
    return hashlib.sha256(kids.hex().encode()).digest()


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add _index (from 0, in ``order``) and _n (number of leaves) by tree (_g).

    Rows equal in the whole order are parted by a number that is written with them. A row's number in its sorted range
    counts on from the first of its tree there; the counts of the ranges before it are a window over one row for each
    range and tree.
    """
    leaves = materialize(leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    by = ["_g", *order, "_salt"]
    ranged = leaves.repartitionByRange(partitions(leaves.sparkSession), *by).sortWithinPartitions(*by)
    ranged = materialize(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    parts = ranged.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_g",
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_g")).alias("_n"),
    )
    parts = materialize(parts, "ranges")  # its size is known: Spark broadcasts it only while it is small
    return ranged.join(parts, ["_g", "_part"]).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


NODE = "_g string, _n long, _level int, _index long, _digest binary, _kids binary"


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes to their ancestors, as far as this task has all children; then the children of partial parents (_kids null)."""
    partial: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}
    names = [x.split()[0] for x in NODE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    for one in batches:
        out = []
        for tree, n, level, index, digest in zip(*(one.column(c).to_pylist() for c in names[:5])):
            while (width := -(-n // ARITY**level)) > 1:
                key = (tree, level + 1, index >> BITS)
                kids = partial.setdefault(key, (n, {}))[1]
                kids[index % ARITY] = digest
                if len(kids) < min(ARITY, width - (index >> BITS) * ARITY):
                    break
                del partial[key]
                together = b"".join(kids[k] for k in range(len(kids)))
                level, index, digest = level + 1, index >> BITS, parent_digest(together)
                out.append((tree, n, level, index, digest, together))
        if out:
            yield batch(out)
    out = []
    for (tree, level, index), (n, kids) in partial.items():
        out += [(tree, n, level - 1, index * ARITY + k, digest, None) for k, digest in kids.items()]
        if len(out) > 10_000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def grown(leaves: DataFrame) -> tuple[DataFrame, int]:
    """All nodes above the leaves with their children's digests, and the largest number of levels."""
    spark = leaves.sparkSession
    levels = height(leaves.agg(F.max("_n")).first()[0] or 0)
    open_ = leaves.select("_g", "_n", F.lit(0).alias("_level"), "_index", "_digest")
    nodes = spark.createDataFrame([], NODE)
    for top in range(0, levels + LEVELS, LEVELS) if levels else ():
        if top:  # every group holds all that is open below an ancestor on level ``top``
            up = F.expr(f"shiftright(_index, greatest(0, {top} - _level) * {BITS})")
            open_ = open_.repartition(partitions(spark), "_g", up)
        found = materialize(open_.mapInArrow(combine, NODE), "nodes")
        nodes = nodes.unionByName(found.where("_kids IS NOT NULL"))
        open_ = found.where("_kids IS NULL").drop("_kids")
    return nodes, levels


def runs(nodes: DataFrame, levels: int, tops: DataFrame) -> DataFrame:
    """Per run of leaves: _g, _index (of the run), _kids, _above (place and children, level by level to the root), _subroot.

    ``tops`` has _g and _over, what stands above the root of each tree. Links are followed from the top: a node's way up is its
    own place among its parent's children, then its parent's way. Keys are runs, which have few rows in any tree.
    """
    width = F.expr(f"_n <= pow({ARITY}, _level)")  # the node is the root of its tree
    roots = nodes.where(width).join(tops, "_g").select("_g", "_level", "_index", "_kids", F.col("_over").alias("_above"), F.col("_digest").alias("_subroot"))
    known = None
    for level in range(levels, 0, -1):
        here = roots.where(F.col("_level") == level).drop("_level")
        if known is not None:
            up = known.select("_g", F.col("_index").alias("_up"), F.col("_kids").alias("_run"), "_above", "_subroot")
            inner = nodes.where((F.col("_level") == level) & ~width).withColumn("_up", F.shiftright("_index", BITS))
            inner = inner.join(up, ["_g", "_up"])
            here = here.unionByName(inner.select("_g", "_index", "_kids", way("_run").alias("_above"), "_subroot"))
        known = here
    return known


def way(kids: str) -> Column:
    """The place among ``kids`` before the way of their parent."""
    place = (F.col("_index") % ARITY).cast("int")
    return F.concat(F.array(F.struct(place.alias("place"), F.col(kids).alias("kids"))), F.col("_above"))


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows of source, doc_id, _digest and any others: a row for each run of leaves, and the root as a table of one row.

    A run: _rows (at most 16 of the leaves, with their _index), _kids (all their digests; null for the only leaf of a
    source), _above, _subroot.
    """
    spark = leaves.sparkSession
    # no key is null: the empty one is the null source, and it comes first
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rest = [c for c in leaves.columns if c != "source"]
    leaves = materialize(placed(leaves.select(key.alias("_g"), *rest), ["doc_id", "_digest"]), "placed")
    nodes, levels = grown(leaves)
    single = leaves.where("_n = 1")
    subroots = nodes.where(f"_n <= pow({ARITY}, _level)").select("_g", "_digest").unionByName(single.select("_g", "_digest"))
    sources = placed(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_source"), "_digest"), ["_source"])
    sources = materialize(sources, "sources")
    upper, upper_levels = grown(sources)
    root = upper.where(f"_n <= pow({ARITY}, _level)").select("_digest").unionByName(sources.where("_n = 1").select("_digest"))
    nothing = F.array().cast("array<struct<place:int,kids:binary>>")
    if upper_levels:
        over = runs(upper, upper_levels, spark.range(1).select(F.lit("").alias("_g"), nothing.alias("_over")))
        over = over.withColumnRenamed("_index", "_run").drop("_subroot")
        tops = sources.withColumn("_run", F.shiftright("_index", BITS)).join(over, ["_g", "_run"])
        tops = tops.select(F.col("_source").alias("_g"), way("_kids").alias("_over"))
    else:
        tops = sources.select(F.col("_source").alias("_g"), nothing.alias("_over"))
    tops = materialize(tops, "tops")
    payload = [c for c in leaves.columns if c not in ("_g", "_n")]
    dealt = leaves.where("_n > 1").groupBy("_g", F.shiftright("_index", BITS).alias("_run"))
    dealt = dealt.agg(F.collect_list(F.struct(*payload)).alias("_rows"))
    found = single.join(tops, "_g").select(
        F.array(F.struct(*payload)).alias("_rows"), F.lit(None).cast("binary").alias("_kids"), F.col("_over").alias("_above"), F.col("_digest").alias("_subroot")
    )
    if levels:
        linked = runs(nodes, levels, tops).withColumnRenamed("_index", "_run")
        found = found.unionByName(dealt.join(linked, ["_g", "_run"]).select("_rows", "_kids", "_above", "_subroot"))
    return found, materialize(root, "root")


def proofs(leaves: DataFrame) -> DataFrame:
    """Per row of source, doc_id and _digest: doc_id, leaf, subroot, root and the way up, an array of (place, kids) from the leaf's own run on."""
    found, root = manifest(leaves.select("source", "doc_id", "_digest"))
    found = found.select(F.explode("_rows").alias("_row"), "_kids", "_above", "_subroot")
    found = found.select("_row.*", "_kids", "_above", "_subroot")
    path = F.when(F.col("_kids").isNull(), F.col("_above")).otherwise(way("_kids"))
    found = found.select("doc_id", F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"), path.alias("path"))
    return found.crossJoin(F.broadcast(root.toDF("root")))  # one row


DIGESTS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to one row a leaf: the hash of all its siblings, and the root that its _claim leads to."""
    for batch in batches:
        out = []
        for rows, kids, above, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("_rows", "_kids", "_above", "_subroot", "root"))):
            above = [(64 * x["place"], x["kids"].hex().encode()) for x in above]
            rest = b"".join(run[:at] + run[at + 64 :] for at, run in above)
            kids = kids.hex().encode() if kids is not None else None
            for row in rows:
                at = 64 * (row["_index"] % ARITY)
                own, steps = (b"", above) if kids is None else (kids[:at] + kids[at + 64 :], [(at, kids), *above])
                claim = row["_claim"].hex().encode()
                for at, run in steps:
                    claim = hashlib.sha256(run[:at] + claim + run[at + 64 :]).hexdigest().encode()
                claim = claim.decode()
                out.append((row["doc_id"], row["_digest"].hex(), subroot.hex(), root.hex(), hashlib.sha256(own + rest).hexdigest(), claim, claim == root.hex()))
        if out:
            types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGESTS.split(", ")])


def verified(leaves: DataFrame) -> DataFrame:
    """From rows of source, doc_id, _digest and _claim (the leaf that is presented): ids, digests, the root that the claim
    folds to with the original siblings, and whether it is the true one."""
    found, root = manifest(leaves.select("source", "doc_id", "_digest", "_claim"))
    return found.crossJoin(F.broadcast(root.toDF("root"))).mapInArrow(folded, DIGESTS)  # one row


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = [F.col(c) for c in COLUMNS]
    tampered = [*values[:-1], F.translate("text", UPPER, UPPER.lower())]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("source", "doc_id", leaf_digest(values).alias("_digest"), F.when(hit, leaf_digest(tampered)).alias("_claim"))
    return verified(leaves.withColumn("_claim", F.coalesce("_claim", "_digest")))


SQL = r"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
claims AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed FROM marked),
heads AS (
  SELECT doc_id, source, text, claimed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM claims),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claim FROM heads),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes
  WHERE n > 1 GROUP BY source, level, i // 16, n),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM tops
  WHERE n > 1 GROUP BY level, i // 16, n),
climbed AS (
  SELECT doc_id, source, leaf, i, 0 AS level, n, claim AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.i // 16, c.level + 1, (c.n + 15) // 16,
    sha256(string_agg(CASE WHEN k.i = c.i THEN c.folded ELSE k.digest END, '' ORDER BY k.i)),
    c.proof || coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (WHERE k.i <> c.i), '')
  FROM climbed c JOIN nodes k ON k.source IS NOT DISTINCT FROM c.source AND k.level = c.level AND k.i // 16 = c.i // 16
  WHERE c.n > 1 GROUP BY c.doc_id, c.source, c.leaf, c.i, c.level, c.n, c.folded, c.proof),
above AS (
  SELECT c.doc_id, c.leaf, s.digest AS subroot, s.i, 0 AS level, s.n, c.folded, c.proof
  FROM climbed c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.i // 16, c.level + 1, (c.n + 15) // 16,
    sha256(string_agg(CASE WHEN k.i = c.i THEN c.folded ELSE k.digest END, '' ORDER BY k.i)),
    c.proof || coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (WHERE k.i <> c.i), '')
  FROM above c JOIN tops k ON k.level = c.level AND k.i // 16 = c.i // 16
  WHERE c.n > 1 GROUP BY c.doc_id, c.leaf, c.subroot, c.i, c.level, c.n, c.folded, c.proof)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM above, (SELECT digest FROM tops WHERE n = 1) WHERE n = 1
"""
