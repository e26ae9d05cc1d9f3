"""Sources, scalar helpers and streaming on small rows."""

import datetime as dt
import time

from pyspark.sql import functions as F

from talus import functions as fn
from talus import sources, streaming


def test_rounding_ordinals_and_sets(spark):
    rows = spark.createDataFrame([(2.5, 11, ["a", "b"], ["b"]), (-2.5, 22, [], [])], "x double, n int, a array<string>, b array<string>")
    got = rows.select(fn.round_js(F.col("x")), fn.ordinal(F.col("n")), fn.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(3, "11th", 0.5), (-2, "22nd", 0.0)]


def test_filters(spark):
    rows = spark.createDataFrame([("Ab", "x"), ("c", "y"), (None, "z")], "p string, q string")
    assert rows.where(fn.contains_any("AB", "p", "q")).count() == 1
    assert rows.where(fn.optional_filters(p="all", q="y")).count() == 1
    assert rows.where(fn.optional_filters(p=None)).count() == 3


def test_upsert_sync_and_json(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in sources.upsert(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in sources.insert_missing(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    synced = sources.sync_children(old, new, "k").collect()
    assert sorted((r.k, r.v, r.active) for r in synced) == [(1, "a", False), (2, "c", True), (3, "d", True)]
    bad = spark.createDataFrame([('{"k": 1}',), ("oops",)], "j string")
    assert [r.j and r.j.k for r in sources.json_column(bad, "j", "k int").collect()] == [1, None]


def test_ties_repeats_and_old_columns(spark):
    old = spark.createDataFrame([(1, "a", 1, "o"), (2, "b", 1, "o")], "k int, v string, at int, extra string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 1), (4, "x", None), (4, "y", None)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in sources.upsert(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "d"), (4, "y")]
    assert sorted(r.k for r in sources.insert_missing(old, new, ["k"]).collect()) == [1, 2, 4]
    synced = {r.k: (r.extra, r.active) for r in sources.sync_children(old, new, "k").collect()}
    assert synced == {1: ("o", False), 2: ("o", True), 4: (None, True)}
    table, n = sources.changed(old, F.col("k") == 2, v="z")
    assert n == 1 and {(r.k, r.v) for r in table.collect()} == {(1, "a"), (2, "z")}


def test_queries_with_parameters(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "k int, c array<string>")
    got = sources.query_batch(spark, {"one": "SELECT k FROM {t} WHERE k = :k", "all": "SELECT k FROM {t}"}, {"t": rows}, k=2)
    assert sources.first_row(got["one"]) == {"k": 2} and got["all"].count() == 2 and sources.first_row(rows.where("k = 9")) is None
    assert [(r.k, r.position, r.child) for r in sources.ordered_children(rows, "k", "c").collect()] == [(1, 0, "x"), (1, 1, "y")]
    made = []
    for _ in range(2):
        assert sources.cached_version(lambda: made.append(1) or rows, str(tmp_path / "cache"), "table", "v1").count() == 2
    assert made == [1]
    sources.replace_all(rows.where("k = 1"), str(tmp_path / "all"))
    sources.replace_all(rows.where("k = 2"), str(tmp_path / "all"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "all")).collect()] == [2]


def workbook(path, sheets):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Full </t><t>Name</t></si></sst>')
        for k, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Day-No</t></is></c></row>'
    body = '<row r="2"><c r="A2" t="inlineStr"><is><t>Ann</t></is></c><c r="C2"><v>7</v></c><c r="D2"/></row><row r="3"><c r="A3"/></row>'
    workbook(tmp_path / "good.xlsx", {"first": head + body, "empty": ""})
    workbook(tmp_path / "short.xlsx", {"first": '<row><c t="inlineStr"><is><t>full name</t></is></c></row>'})
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    rows = sources.workbook_rows(spark, str(tmp_path))
    found = {(r.file.rsplit("/", 1)[-1], r.sheet, r.row): r.cells for r in rows.collect()}
    assert found["good.xlsx", "first", 0] == ["Full Name", "", "Day-No"] and found["good.xlsx", "first", 1] == ["Ann", "", "7"] and len(found) == 4
    got = {r.file.rsplit("/", 1)[-1]: (r["Full Name"], r["day no"], r.error) for r in sources.with_header(rows, ["Full Name", "day no"]).collect()}
    assert got["good.xlsx"] == ("Ann", "7", None) and got["short.xlsx"][2] == "missing: day no" and got["bad.xlsx"][2] == "BadZipFile"


def test_similar_sets_by_brute_force(spark, tmp_path):
    """Long names, so that sets meet by several words: no pair is lost and none comes twice."""
    import itertools
    import random

    from talus.operators.lookups import similar_within_key

    draw = random.Random(4)
    names = [" ".join(draw.choices("abcdefghijklmnop", k=draw.randint(0, 12))) for _ in range(160)] + ["a b c"] * 3 + [None]
    rows = [(f"Brand#{k % 3}", n) for k, n in enumerate(names)]
    spark.createDataFrame(rows, "p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    sets = {(brand, tuple(sorted(set(name.split())))) for brand, name in rows if name}
    for least in (0.3, 0.5, 0.8):
        wanted = set()
        for (brand, a), (other, b) in itertools.combinations(sorted(sets), 2):
            similarity = len({*a} & {*b}) / len({*a} | {*b})
            if brand == other and similarity >= least:
                wanted.add((brand, *sorted([" ".join(a), " ".join(b)]), round(similarity, 4)))
        got = [(r.p_brand, r.left_words, r.right_words, r.similarity) for r in similar_within_key(spark, str(tmp_path), least).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_text_with_fallback(spark):
    files = spark.createDataFrame([("good", b"fine text"), ("poor", b"x"), ("broken", b"!"), ("both", b"!!"), ("none", None)], "path string, content binary")

    def first(content):
        if content.startswith(b"!"):
            raise ValueError(content)
        return content.decode()

    def second(content):
        if content == b"!!":
            raise KeyError(content)
        return "a better text" if content else ""

    rows = sources.text_with_fallback(files, first, second, len, 5).collect()
    assert {r.path: (r.text, r.extractor, r.error) for r in rows} == {
        "good": ("fine text", "first", None), "poor": ("a better text", "second", None), "broken": ("a better text", "second", None),
        "both": (None, "first", "ValueError"), "none": ("", "first", None),
    }


def test_model_answers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, q string")
    make = lambda: lambda asked: [None if x is None else x + "!" for x in asked]
    assert {r.k: r.a for r in rows.select("k", sources.model_answers(F.col("q"), make).alias("a")).collect()} == {1: "a!", 2: None, 3: "!"}


def test_merge_patch(spark):
    cases = [
        ('{"a":{"b":1,"c":2},"d":3}', '{"a":{"b":null,"e":{"f":null,"g":1}},"d":[1]}', '{"a":{"c":2,"e":{"g":1}},"d":[1]}'),
        ('{"a":"b"}', '["c"]', '["c"]'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), (None, '{"a":null,"é":1}', '{"é":1}'),
        ('{"a":1}', None, None), ("oops", "{}", None), ('{"a":1}', "oops", None), ('{"a":{"b":1}}', '{"a":7}', '{"a":7}'),
    ]
    rows = spark.createDataFrame(cases, "o string, p string, w string")
    assert all(r.got == r.w for r in rows.select(sources.merge_patch(F.col("o"), F.col("p")).alias("got"), "w").collect())


def test_strict_json_fails(spark):
    import pytest

    bad = spark.createDataFrame([("oops",)], "j string")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.json_column(bad, "j", "k int", strict=True).collect()


def test_csv_export(spark, tmp_path):
    sources.export_csv(spark.createDataFrame([('say "hi"', 1)], "a string, b int").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert text == b'"a","b"\r\n"say ""hi""","1"\r\n'


def test_windowed_counts_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 1), "b"), (at(9, 0), "z")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def follow(stream, timeout):
    allowed = {"pending": {"parsing"}, "parsing": {"scoring", "failed"}, "scoring": {"completed", "failed"}, "failed": {"pending"}}
    return streaming.follow_status(stream, allowed, "pending", {"parsing", "scoring"}, timeout)


def test_order_holds_over_arrow_batches(spark, tmp_path):
    """One key with more rows than an Arrow batch, in reverse: they are taken in the order of time."""
    steps = ["parsing", "scoring", "completed"]
    rows = [(1, dt.datetime(2024, 1, 1, 0, k), s) for k, s in enumerate(steps)]
    spark.createDataFrame(rows[::-1], "id long, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    stream = spark.readStream.schema("id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    running = follow(stream, 1_800_000).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while spark.table("ordered").count() < 3 and time.time() < until:
        time.sleep(0.5)
    running.stop()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.status, r.valid) for r in spark.table("ordered").collect()] == [(s, True) for s in steps]


def test_silent_requests_time_out(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), "parsing")]
    spark.createDataFrame(rows, "id long, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    running = follow(stream, 500).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while spark.table("silent").count() < 2 and time.time() < until:
        time.sleep(0.5)
    running.stop()
    assert [(r.status, r.valid) for r in spark.table("silent").collect()] == [("parsing", True), ("pending", True)]


def test_intake_takes_a_request_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at), ("a", at + dt.timedelta(hours=1)), ("b", at)]
    spark.createDataFrame(rows, "request string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request string, ts timestamp").parquet(str(tmp_path / "in"))
    query = streaming.once_each(stream, "request").writeStream.format("memory").queryName("once").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.request for r in spark.table("once").collect()) == ["a", "b"]


def test_upkeep_of_a_queue(spark):
    now = F.lit("2024-04-01 00:00:00").cast("timestamp")
    at = lambda day, s=0: dt.datetime(2024, 3, day, 0, 0, s)
    jobs = spark.createDataFrame([(1, "scoring", 0.5, at(1)), (2, "scoring", 0.7, at(31)), (3, None, None, None)], "id long, status string, score double, ts timestamp")
    got = {r.id: (r.status, r.score) for r in streaming.requeued(jobs, streaming.stale("ts", now, 86400 * 2), "status", "pending", ["score"]).collect()}
    assert got == {1: ("pending", None), 2: ("scoring", 0.7), 3: (None, None)}
    assert {r.id for r in streaming.half_queued(jobs, jobs.where("id = 1"), "id", "ts", now, 60).collect()} == {2}
    assert {r.id for r in streaming.unexpired(jobs, "ts", now, 10).collect()} == {2, 3}
    assert [r.id for r in streaming.oldest_first(jobs.where("ts IS NOT NULL"), 1, "ts", "id").collect()] == [1]
    failed = spark.createDataFrame([(429, 0), (503, None), (503, 1), (404, 0), (None, 0)], "code int, tries int")
    assert [r.retry for r in streaming.with_retries(failed, "code", "tries", [0, 408, 429]).collect()] == [True, True, False, False, False]
    moves = spark.createDataFrame([(1, "new", "done"), (2, "done", "done"), (3, None, "odd")], "id long, old_status string, status string")
    assert {(r.id, r.action) for r in streaming.derived_events(moves, "status", {"done": "closed"}).collect()} == {(1, "closed"), (3, "updated")}
    kept = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, n long, v string")
    assert {(r.v, r.current) for r in streaming.archived(kept, "k", "n").collect()} == {("a", False), ("b", True), ("c", True)}
    assert streaming.fan_out(kept, ["x", "y"]).count() == 6


def test_status_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, k), s) for k, s in enumerate(["parsing", "completed", "scoring", "completed"])]
    spark.createDataFrame(rows, "id long, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    query = follow(stream, 1_800_000).writeStream.format("memory").queryName("status").outputMode("append")
    running = query.option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60  # timeouts by the clock keep such a query running
    while spark.table("status").count() < 4 and time.time() < until:
        time.sleep(0.5)
    running.stop()
    got = [(r.status, r.valid) for r in spark.table("status").collect()]
    assert got == [("parsing", True), ("parsing", False), ("scoring", True), ("completed", True)]
