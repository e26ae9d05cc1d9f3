"""Look up a value for every distinct word of a corpus, without a vocabulary in one place.

Documents are dealt to blocks. Each block lists its distinct words; the lists go to buckets by the words' hash, where
every word is valued once for the whole corpus; the values go back to the blocks that asked, and each block's documents
are finished with its own small dictionary. Traffic is the blocks' distinct words, not their running words, and no task
holds more than a block (about ``BLOCK_BYTES`` of text) or a bucket. Lists are as many rows as blocks times buckets, which is
what a shuffle of as many map tasks and partitions moves.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import block_count

BLOCK_BYTES = 16 << 20
#: Blocks for each bucket of words.
SHARE = 2

#: The words of a text, both in bytes.
Split = Callable[[bytes | None], list[bytes]]


def pack(items: list[bytes]) -> bytes:
    """A list of byte strings as one."""
    return struct.pack(f"<{len(items) + 1}I", len(items), *map(len, items)) + b"".join(items)


def unpack(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    out, at = [], 4 * n + 4
    for size in struct.unpack_from(f"<{n}I", blob, 4):
        out.append(blob[at : at + size])
        at += size
    return out


def value_words(docs: DataFrame, split: Split, stem: Callable, value: Callable, finish: Callable, schema) -> DataFrame:
    """Apply ``finish`` to each block of ``docs`` (doc_id, text in bytes, and more) with the values of its words.

    ``stem(word)`` gives what of a word is valued and the rest; ``value(stems)`` gives a list of byte strings for a
    bucket's distinct stems. ``finish(table, values)`` gets a block's rows and a dictionary from stem to value.
    """
    blocks = block_count(docs, BLOCK_BYTES)
    n = -(-blocks // SHARE)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = docs.withColumn("_block", block).repartition(blocks, "_block")
    listed_schema = pa.schema([("_bucket", pa.int32()), ("_block", pa.int32()), ("words", pa.binary())])

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[bytes]] = defaultdict(set)
        for batch in batches:
            for text, block in zip(batch.column("text").to_pylist(), batch.column("_block").to_pylist()):
                found[block].update(split(text))
        for block, words in found.items():
            buckets: list[list[bytes]] = [[] for _ in range(n)]
            for w in {stem(w)[0] for w in words}:
                buckets[xxhash.xxh3_64_intdigest(w) % n].append(w)
            for k, some in enumerate(buckets):
                if some:
                    row = [[k], [block], [pack(some)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, listed_schema)], schema=listed_schema)

    def value_bucket(rows: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in rows.column("words").to_pylist()]
        words = list(set().union(*lists))
        values = dict(zip(words, value(words)))
        found = [pack([values[w] for w in some]) for some in lists]
        return pa.table({"_block": rows.column("_block"), "words": rows.column("words"), "values": pa.array(found, pa.binary())})

    def finish_block(rows: pa.Table, lists: pa.Table) -> pa.Table:
        values: dict[bytes, bytes] = {}
        for words, found in zip(lists.column("words").to_pylist(), lists.column("values").to_pylist()):
            values.update(zip(unpack(words), unpack(found)))
        return finish(rows, values)

    listed = blocked.mapInArrow(list_words, "_bucket int, _block int, words binary")
    valued = listed.groupBy("_bucket").applyInArrow(value_bucket, "_block int, words binary, values binary")
    return blocked.groupBy("_block").cogroup(valued.groupBy("_block")).applyInArrow(finish_block, schema)
