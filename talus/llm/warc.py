"""Operator 2: WARC archives. Write pages as whole-file gzip streams, normalise them, read them back by offset.

``write_monolithic`` writes one gzip stream over all records of a file. ``normalise`` inflates every such stream once, in
bounded pieces, and rewrites each record as a gzip member of its own, with a sidecar of JSON lines that tell where it is.
``read_records`` seeks to the members that an index names and parses them alone. ``verified`` holds every record against its
payload, and every revisit against the payload of the response it refers to.

Archives and sidecars go to a folder that all executors share (under ``spark.checkpoint.dir``); a task writes under a
temporary name and renames, so a task that runs again does no harm. A record is held in memory whole, a file is not
inflated whole.

Defined cases: null html is an empty payload; null urls and ids leave their header out and come back null; an empty table
writes no record and reads back empty; rows that repeat an id and its payload are all responses where that id is the
largest; a stream that breaks off keeps its complete records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import materialize, partitions, scratch

MIN_REVISIT, DATE, PIECE, LEVEL = 1000, "2024-01-01T00:00:00Z", 1 << 20, 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
INDEX = "archive string, offset long, length long, type string, record_id string"


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    # only payloads that occur more than once are joined back; a hot one is a single row here
    same = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    same = same.agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(same, ["payload_digest", "payload_bytes"], "left")
    return rows.withColumn("refers_to", F.when(F.coalesce("page_id", F.lit(-1)) != F.col("_last"), F.col("_last"))).drop("_last")


def record_id(page_id) -> F.Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("?"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(rows: DataFrame) -> DataFrame:
    """One column, ``value``: each record up to its closing line ends."""
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    return rows.select("*", body.alias("_body")).select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", record_id(F.col("page_id"))),
            line("WARC-Date", F.lit(DATE)),
            optional("WARC-Target-URI", one_line("url")),
            optional("WARC-Page-ID", F.col("page_id").cast("string")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Refers-To", record_id(F.col("refers_to"))),
                    line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
                    line("WARC-Profile", F.lit(PROFILE)),
                ),
            ).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", F.octet_length("_body").cast("string")),
            F.lit("\r\n"),
            "_body",
        ).alias("value")
    )


def write_monolithic(pages: DataFrame, folder: str) -> None:
    """Spark's text writer with gzip: every file is one gzip stream over all its records."""
    record_text(with_revisits(pages)).write.option("lineSep", END).option("compression", "gzip").text(folder)


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """A gzip stream in pieces, read in pieces; further members follow on, a broken tail is dropped."""
    held, stream = b"", zlib.decompressobj(31)
    while True:
        held = held or read(PIECE)
        last = not held
        try:
            piece = stream.decompress(held, 8 * PIECE)
        except zlib.error:
            return
        if piece:
            yield piece
        elif last:
            return
        if stream.eof:
            held, stream = stream.unused_data, zlib.decompressobj(31)
        else:
            held = stream.unconsumed_tail


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each complete record."""
    held = bytearray()
    need = 0
    head: dict[str, str] | None = None
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = headers(bytes(held[:end]))
                need = end + 4 + int(head.get("content-length", 0)) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives in the folder ``source`` into ``target``; the index, read from the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        inputs, folder = fs.FileSystem.from_uri(source)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = posixpath.basename(path).split(".")[0]
                part, lines, at = f"{root}/.{name}-{uuid.uuid4().hex}", [], 0
                whole_file = inputs.open_input_stream(f"{folder}/{posixpath.basename(path)}", compression=None)
                with whole_file, store.open_output_stream(part) as out:
                    for head, whole in records(inflate(whole_file.read)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        lines.append(json.dumps({
                            "archive": f"{name}.warc.gz", "offset": at, "length": len(member),
                            "type": head.get("warc-type"), "record_id": head.get("warc-record-id"),
                        }))
                        at += len(member)
                with store.open_output_stream(part + ".index") as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                store.move(part, f"{root}/{name}.warc.gz")
                store.move(part + ".index", f"{root}/{name}.index.json")
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(lines)], pa.int64())})

    store, root = fs.FileSystem.from_uri(target)
    store.create_dir(root, recursive=True)
    # names only: a task opens its archives itself, as streams
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    done = files.mapInArrow(run, "archive string, records long")
    if not done.agg(F.count("*")).first()[0]:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(target)


def read_records(index: DataFrame, target: str) -> DataFrame:
    """The records that ``index`` names, each from its own member: page_id, type, refers_to, payload and more."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]
    number = lambda x: None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                whole = zlib.decompress(file.read(length), 31)
                at = whole.find(b"\r\n\r\n")
                head = headers(whole[:at])
                payload = whole[whole.find(b"\r\n\r\n", at + 4) + 4 : at + 4 + int(head["content-length"])]
                kind, digest, size = head["warc-type"], hashlib.sha1(payload).hexdigest(), len(payload)
                told = head.get("warc-payload-digest", "").removeprefix("sha1:"), number(head.get("warc-payload-length"))
                if kind == "revisit":  # the payload is in the record it refers to
                    payload, digest, size = None, *told
                rows.append((
                    number(head.get("warc-page-id")), head.get("warc-target-uri"), kind, number(head.get("warc-refers-to-page-id")),
                    payload, size, digest, (digest, size) == told,
                ))
                held += length
                if held > 8 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    n = partitions(index.sparkSession)
    placed = index.select("archive", "offset", "length").repartition(n, "archive").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(
        run,
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
        "payload_digest string, intact boolean",
    )


def verified(records_: DataFrame) -> DataFrame:
    """The records without their payloads; a revisit has the digest and length of the payload it refers to, and is intact if
    its own header says the same."""
    rows = materialize(records_.drop("payload"), "records")
    told = ["payload_bytes", "payload_digest"]
    sources = rows.where("record_type = 'response' AND intact").select(F.col("page_id").alias("refers_to"), *(F.col(c).alias(f"_{c}") for c in told))
    sources = sources.dropDuplicates(["refers_to"])  # an id that repeats its payload
    joined = rows.where("record_type = 'revisit'").join(sources, "refers_to", "left")
    same = F.coalesce(*(F.col(c) == F.col(f"_{c}") for c in told[:1]), F.lit(False)) & F.coalesce(F.col(told[1]) == F.col(f"_{told[1]}"), F.lit(False))
    revisits = joined.withColumn("intact", same).withColumns({c: F.col(f"_{c}") for c in told}).select(*rows.columns)
    return rows.where("record_type <> 'revisit'").unionByName(revisits)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, single = scratch(spark, "warc-whole"), scratch(spark, "warc-members")
    write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), whole)
    index = normalise(spark, whole, single)
    return verified(read_records(index, single)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
last AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to, true AS intact
FROM last
"""
