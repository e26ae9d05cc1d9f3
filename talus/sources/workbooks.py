"""Workbooks as a registered data source with one partition a sheet, and sheets folded by headings of the caller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row long, cells array<string>"


@dataclass
class Sheet(InputPartition):
    file: str
    number: int


class WorkbookReader(DataSourceReader):
    """Lists sheets where the plan is made, and reads one in each task, through Arrow's file systems (any URI that they know)."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a workbook source needs a path")
        self.path = options["path"]

    def _open(self, file: str) -> bytes:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(file) if "://" in file or file.startswith("file:") else (fs.LocalFileSystem(), file)
        with system.open_input_stream(name) as stream:
            return stream.read()

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: -len(name)] if self.path.endswith(name) else ""
        info = system.get_file_info(name)
        found = system.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".xlsx"))

    def partitions(self) -> list[Sheet]:
        from talus.sources import sheet_names

        return [Sheet(file, n) for file in self._files() for n in range(len(sheet_names(self._open(file))))] or [Sheet("", 0)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        from talus.sources import sheet_rows

        if partition.file:
            name, rows = sheet_rows(self._open(partition.file), partition.number)
            for n, cells in enumerate(rows):
                yield partition.file, name, n, cells


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: file, sheet, row, cells of the sheets of all workbooks under a path."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def folded(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def numberless(text: Column) -> Column:
    """Without a list number or mark in front: 1. 2) (3) a. - * and bullets."""
    return F.trim(F.regexp_replace(text, r"^\s*(?:\(?(?:\d{1,3}|[A-Za-z])[.)]|[-*•●▪–])\s+", ""))


def structured(rows: DataFrame, headings: dict[str, list[str]], labels: dict[str, list[str]]) -> DataFrame:
    """A row for each sheet: file, sheet, a text column for each of ``labels`` and an array column for each of ``headings``.

    Names are given with the spellings that stand for them; text is compared by its letters and digits. A heading is a
    row whose first filled cell is one of its spellings: its section holds the filled cells of the rows below, in order, up to the next
    heading, without list numbers; what else stands in the heading's own row opens its section. A label's value is the next filled
    cell of its row, or else the cell below it; the first one found in a sheet holds. A row with a label is in no section.
    A sheet has some million rows at most, which bounds the windows by sheet.
    """
    known = lambda x, names: F.coalesce(*(F.when(x.isin(*{_plain(s) for s in spellings}), F.lit(name)) for name, spellings in names.items()), F.lit(None).cast("string"))
    sheet = Window.partitionBy("file", "sheet").orderBy("row")
    rows = rows.withColumn("below", F.lead("cells").over(sheet))
    filled = F.filter("cells", lambda c: F.coalesce(c != "", F.lit(False)))
    rows = rows.withColumn("filled", filled)
    places = F.transform("cells", lambda c, i: F.struct(known(folded(c), labels).alias("name"), i.alias("at")))
    after = lambda p: F.get(F.filter(F.slice("cells", p["at"] + 2, F.size("cells")), lambda c: F.coalesce(c != "", F.lit(False))), F.lit(0))
    value = lambda p: F.coalesce(after(p), F.nullif(F.get("below", p["at"]), F.lit("")))
    found = F.filter(F.transform(places, lambda p: F.struct(p["name"].alias("name"), value(p).alias("value"))), lambda v: v["name"].isNotNull())
    rows = rows.withColumn("found", found)
    picked = rows.select("file", "sheet", "row", F.posexplode("found").alias("at", "f")).where("f.value IS NOT NULL")
    firsts = picked.groupBy("file", "sheet").agg(*(F.min_by(F.when(F.col("f.name") == n, F.col("f.value")), F.when(F.col("f.name") == n, F.struct("row", "at"))).alias(n) for n in labels))
    rows = rows.withColumn("heading", F.when(F.size("found") == 0, known(folded(F.get("filled", F.lit(0))), headings)))
    current = F.last("heading", ignorenulls=True).over(sheet.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.withColumn("section", current).where("section IS NOT NULL AND size(found) = 0")
    own = F.when(F.col("heading").isNotNull(), F.slice("filled", 2, F.greatest(F.size("filled") - 1, F.lit(0)))).otherwise(F.col("filled"))
    entries = inside.select("file", "sheet", "section", "row", F.posexplode(own).alias("at", "text")).withColumn("text", numberless(F.col("text"))).where("text <> ''")
    lists = entries.groupBy("file", "sheet").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == n, F.struct("row", "at", "text")))), lambda e: e["text"]).alias(n) for n in headings))
    sheets = rows.select("file", "sheet").distinct().join(firsts, ["file", "sheet"], "left").join(lists, ["file", "sheet"], "left")
    none = F.array().cast("array<string>")
    return sheets.select("file", "sheet", *labels, *(F.coalesce(n, none).alias(n) for n in headings))


def _plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())
