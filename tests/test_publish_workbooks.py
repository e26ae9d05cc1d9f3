"""Tables replaced as a whole, with failures midway; workbooks as a source and folded by headings."""

import pytest
from pyspark.sql import functions as F

from talus import sources
from talus.sources import replacing as publish
from talus.sources import workbooks
from tests.test_helpers import workbook


def test_a_table_is_replaced_by_what_reads_it(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.range(5), path)
    publish.publish(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    broken = spark.read.parquet(path).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_a_call_that_died_between_its_renames_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    publish.recovered(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(9).write.parquet(f"{path}.old")
    publish.recovered(spark, path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.old").exists()


def test_update_counts_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "k long, s string, n int"), path)
    assert publish.update_table(spark, path, F.col("n") > 4, s="z", n=F.col("n") * 2) == 2
    assert publish.update_table(spark, path, F.col("s") == "none", n=0) == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", None), (2, "z", 10), (3, "z", 14)]


def test_children_are_replaced_in_order(spark, tmp_path):
    path = str(tmp_path / "c")
    make = lambda rows: spark.createDataFrame(rows, "k long, c array<string>")
    publish.replace_children(make([(1, ["a", "b"]), (2, ["x"])]), "k", "c", path)
    publish.replace_children(make([(1, ["c", "a", "a"]), (3, []), (2, None)]), "k", "c", path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 0, "c"), (1, 1, "a"), (1, 2, "a")]


def test_versions_are_whole_or_made_again(spark, tmp_path):
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    read = lambda n, *v, **more: publish.cached_version(lambda: make(n), str(tmp_path), *v, **more).count()
    assert (read(2, "a", "1"), read(9, "a", "1"), read(3, "a", "2")) == (2, 2, 3) and calls == [2, 3]
    half = next(p for p in tmp_path.iterdir() if (p / "_SUCCESS").exists() and len(list(p.glob("*.parquet"))))
    (half / "_SUCCESS").unlink()
    assert {read(5, "a", "1"), read(6, "a", "2")} & {5, 6} and len(calls) == 3
    assert read(8, "a", "3", purge=True) == 8
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    assert read(4, "a", "1") == 4


def cells(*rows):
    out = ""
    for n, row in enumerate(rows, 1):
        out += f'<row r="{n}">' + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{x}</t></is></c>' for k, x in enumerate(row) if x) + "</row>"
    return out


def test_a_partition_for_each_sheet(spark, tmp_path):
    workbook(tmp_path / "one.xlsx", {"first": cells(["a", "", "b"], [], ["c"]), "empty": "", "last": cells(["d"])})
    (tmp_path / "deep").mkdir()
    workbook(tmp_path / "deep" / "two.xlsx", {"s": cells(["e"])})
    workbooks.register(spark)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("workbook").load(path)
        found = {(r.file.rsplit("/", 1)[-1], r.sheet, r.row, tuple(r.cells)) for r in rows.collect()}
        assert found == {("one.xlsx", "first", 0, ("a", "", "b")), ("one.xlsx", "first", 1, ("c",)), ("one.xlsx", "last", 0, ("d",)), ("two.xlsx", "s", 0, ("e",))}
        assert rows.rdd.getNumPartitions() == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbook").load(str(tmp_path / "none")).count() == 0


def test_sheets_by_headings_and_labels(spark):
    rows = [
        (0, ["Form 7"]), (1, ["Title:", "", "Chief of Maps"]), (2, ["Place", "", "Grade"]), (3, ["Oslo", "", "B"]), (4, ["What you do"]), (5, ["1. Draw maps", "2) Check them"]),
        (6, ["", "- walk (b) far"]), (7, ["WHAT YOU BRING", "a. Boots"]), (8, ["• A pen"]), (9, ["Title", "second title is not taken"]), (10, ["3) More"]),
    ]
    table = spark.createDataFrame([("f", "s", n, c) for n, c in rows] + [("f", "other", 0, ["text only"])], "file string, sheet string, row long, cells array<string>")
    got = {r.sheet: r for r in workbooks.structured(table, {"duties": ["what you do"], "needs": ["What you bring", "needs"]}, {"title": ["title"], "place": ["Place"], "grade": ["grade"]}).collect()}
    r = got["s"]
    assert (r.title, r.place, r.grade) == ("Chief of Maps", "Grade", "B")
    assert r.duties == ["Draw maps", "Check them", "walk (b) far"] and r.needs == ["Boots", "A pen", "More"]
    assert tuple(got["other"])[2:] == (None, None, None, [], [])
