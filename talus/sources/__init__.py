"""Sources and sinks: typed readers of the tables, exports, latest-wins merging."""

from __future__ import annotations

import functools
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.replacing import cached_version, publish, replace_children, update_table  # noqa: F401


def replace_all(df: DataFrame, path: str) -> None:
    """The whole table anew; readers see the old one or the new one."""
    publish(df, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, **params) -> DataFrame:
    """A parameterised query over DataFrames; parameters are bound, not pasted."""
    return spark.sql(sql, args=params, **(views or {}))


def json_column(df: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """Decode a JSON text column; bad text becomes null, or an error where ``strict``."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return df.withColumn(column, F.from_json(column, schema, {"mode": mode}))


def export_csv(df: DataFrame, path: str) -> None:
    """All values quoted, quotes doubled, lines ended by CR LF."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the latest by ``order`` for each key; one shuffle by the key.

    At equal ``order`` a row of ``new`` wins, and among several the one that is last in the order of its other values.
    """
    mark = "_source"
    both = old.withColumn(mark, F.lit(0)).unionByName(new.withColumn(mark, F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, order, mark)]
    columns = [c for c in both.columns if c not in (*key, mark)]
    best = F.struct(F.col(order).isNotNull().alias("_has"), F.col(order).alias("_at"), mark, *(F.col(c).alias(f"_{k}") for k, c in enumerate(rest)))
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*columns), best).alias("_row"))
    return picked.select(*key, "_row.*").select(*(c for c in both.columns if c != mark))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one row for a key that ``new`` repeats."""
    missing = new.join(old.select(*key), key, "left_anti").dropDuplicates(key)
    return old.unionByName(missing.select(*new.columns), allowMissingColumns=True)


def sync_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Three-way sync: matched rows take the new values, new ones are added, missing ones stay but inactive.

    Columns that only ``old`` has are kept. ``new`` must hold a key once; a repeated key of it is taken once.
    """
    values = [c for c in new.columns if c != key]
    only_old = [c for c in old.columns if c not in (key, "active", *values)]
    a, b = old.drop("active").alias("a"), new.dropDuplicates([key]).withColumn("_here", F.lit(True)).alias("b")
    joined = a.join(b, key, "full_outer")
    old_has = set(old.columns)
    picked = [F.when(F.col("_here"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}") if c in old_has else F.lit(None)).alias(c) for c in values]
    return joined.select(key, *picked, *(F.col(f"a.{c}") for c in only_old), F.coalesce("_here", F.lit(False)).alias("active"))


def query_batch(spark: SparkSession, statements: dict[str, str], views: dict[str, DataFrame] | None = None, **params) -> dict[str, DataFrame]:
    """Several queries by name, none of them run yet."""
    return {name: query(spark, sql, views, **params) for name, sql in statements.items()}


def first_row(df: DataFrame) -> dict | None:
    row = df.head()
    return None if row is None else row.asDict(recursive=True)


def changed(df: DataFrame, where: Column, **values) -> tuple[DataFrame, int]:
    """The table after an update, and the number of rows it changes; the caller writes it over the partition it read."""
    hit = F.coalesce(where, F.lit(False))
    picked = [F.when(hit, F.lit(values[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns]
    return df.select(*picked), df.where(hit).count()


def jdbc_table(spark: SparkSession, url: str, name: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database table; ``split`` (column, least, most, parts) reads it in ranges, and filters go to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split:
        column, least, most, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=least, upperBound=most, numPartitions=parts)
    return reader.load()


def ordered_children(parents: DataFrame, key: str, children: str) -> DataFrame:
    """The rows of an array column, numbered from 0: what is written in place of a parent's former children."""
    return parents.select(key, F.posexplode(children).alias("position", "child"))


def text_with_fallback(files: DataFrame, first: Callable, second: Callable, quality: Callable, enough: float) -> DataFrame:
    """path, text, quality, extractor and error of binary files (``path``, ``content``).

    ``first`` and ``second`` make text of bytes, ``quality`` a number of text. Text below ``enough`` is extracted by the
    second as well and the better one is kept, at equal quality the first. An extractor that raises has no text.
    """

    def tried(extract: Callable, name: str, content: bytes | None) -> tuple:
        try:
            text = extract(content or b"")
            return text, None if text is None else float(quality(text)), name, None
        except Exception as e:  # whatever a library makes of a broken file
            return None, None, name, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worth = lambda found: float("-inf") if found[1] is None else found[1]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                best = tried(first, "first", content)
                if worth(best) < enough:
                    other = tried(second, "second", content)
                    best = other if worth(other) > worth(best) else best
                out.append((path, *best))
            yield pd.DataFrame(out, columns=["path", "text", "quality", "extractor", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, quality double, extractor string, error string")


def model_answers(requests: Column, make_client: Callable[[], Callable[[list], list]]) -> Column:
    """Answers of a service: ``make_client`` is called once a task, its result with a list of requests for each Arrow batch."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for batch in batches:
            answers = client([None if pd.isna(x) else x for x in batch])
            if len(answers) != len(batch):
                raise ValueError(f"{len(answers)} answers to {len(batch)} requests")
            yield pd.Series(answers, dtype=object)

    return ask(requests)


def _patched(old, patch):
    if not isinstance(patch, dict):
        return patch
    kept = dict(old) if isinstance(old, dict) else {}
    for key, value in patch.items():
        if value is None:
            kept.pop(key, None)
        else:
            kept[key] = _patched(kept.get(key), value)
    return kept


def merge_patch(old: Column, patch: Column) -> Column:
    """JSON merge patch (RFC 7396) of nested objects, as text: null without a patch or where one of the two is no JSON; no ``old`` is {}."""

    @F.pandas_udf("string")
    def merged(olds: pd.Series, patches: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return None if pd.isna(b) else json.dumps(_patched({} if pd.isna(a) else json.loads(a), json.loads(b)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return pd.Series([one(a, b) for a, b in zip(olds, patches)], dtype=object)

    return merged(old, patch)


_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _listed(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets, in order, and the parts that hold them."""
    read = lambda name: ElementTree.fromstring(book.read(name))
    targets = {e.get("Id"): e.get("Target") for e in read("xl/_rels/workbook.xml.rels")}
    sheets = [e for e in read("xl/workbook.xml").iter() if _local(e) == "sheet"]
    links = [targets[next(v for k, v in e.attrib.items() if k.endswith("}id"))].lstrip("/") for e in sheets]
    return [(e.get("name", ""), t if t.startswith("xl/") else f"xl/{t}") for e, t in zip(sheets, links)]


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return [name for name, _ in _listed(book)]


def sheet_rows(content: bytes, number: int) -> tuple[str, list[list[str]]]:
    """Name and rows of one sheet. A row ends with its last filled cell; rows without one are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) == "t")
        part = "xl/sharedStrings.xml"
        shared = [text(e) for e in ElementTree.fromstring(book.read(part))] if part in book.namelist() else []
        name, target = _listed(book)[number]
        rows = []
        for row in (e for e in ElementTree.fromstring(book.read(target)).iter() if _local(e) == "row"):
            values: dict[int, str] = {}
            last = -1
            for cell in row:
                at = _CELL.fullmatch(cell.get("r", ""))
                column = functools.reduce(lambda n, c: n * 26 + ord(c) - 64, at[1], 0) - 1 if at else last + 1
                last = column
                value = next((e.text or "" for e in cell if _local(e) == "v"), "")
                kind = cell.get("t")
                value = shared[int(value)] if kind == "s" and value else text(cell) if kind == "inlineStr" else value
                if value.strip():
                    values[column] = value.strip()
            if values:
                rows.append([values.get(k, "") for k in range(max(values) + 1)])
        return name, rows


def _sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    for number in range(len(sheet_names(content))):
        yield sheet_rows(content, number)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of the workbooks under ``path``: file, sheet, row, cells. A file that is no workbook has an ``error``."""
    schema = "file string, sheet string, row long, cells array<string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                out = []
                try:
                    for sheet, rows in _sheets(content):
                        out.extend((file, sheet, n, cells, None) for n, cells in enumerate(rows))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, IndexError, ValueError) as e:
                    out = [(file, None, None, None, type(e).__name__)]
                if out:
                    yield pd.DataFrame(out, columns=["file", "sheet", "row", "cells", "error"]).astype({"row": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def with_header(rows: DataFrame, required: list[str]) -> DataFrame:
    """The rows of each file's first sheet below its header, as columns of ``required`` names found by folded header text.

    A file without one of them, or that is no workbook, has one row with an ``error``.
    """
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    first = rows.where("error IS NULL").groupBy("file").agg(F.min(F.struct("row", "sheet")).alias("h"))
    sheets = rows.where("row = 0").select("file", "sheet", F.transform("cells", fold).alias("header"))
    heads = sheets.join(first.select("file", F.col("h.sheet").alias("sheet")), ["file", "sheet"])
    places = [F.array_position("header", fold(F.lit(c))) for c in required]
    missing = F.array_compact(F.array(*(F.when(p == 0, F.lit(c)) for p, c in zip(places, required))))
    heads = heads.select("file", "sheet", missing.alias("missing"), *(p.cast("int").alias(f"_{k}") for k, p in enumerate(places)))
    body = rows.where("row > 0").join(heads.where(F.size("missing") == 0), ["file", "sheet"])
    good = body.select("file", "row", *(F.nullif(F.try_element_at("cells", F.col(f"_{k}")), F.lit("")).alias(c) for k, c in enumerate(required)), F.lit(None).cast("string").alias("error"))
    bad = heads.where(F.size("missing") > 0).select("file", F.concat(F.lit("missing: "), F.array_join("missing", ", ")).alias("error"))
    bad = bad.unionByName(rows.where("error IS NOT NULL").select("file", "error"))
    return good.unionByName(bad, allowMissingColumns=True)
