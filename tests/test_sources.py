import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimark.sources import feeds, files, sessions
from sedimark.streaming import feeds as streams


def test_sessions(spark, tmp_path):
    def write(name, *records):
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))

    write("a.jsonl", {"type": "session", "id": "s", "cwd": "/x"}, "broken {", {"type": "message", "id": "m1", "parentId": "s", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user"}}, {"type": "session_info", "name": "n"}, {"type": "session_info", "name": None})
    write("b.jsonl", {"type": "message", "id": "m"}, {"type": "session", "id": "t"})
    entries = sessions.read_sessions(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1] for r in entries.collect()} == {"a.jsonl"}
    (got,) = sessions.session_list(entries).collect()
    assert (got.messages, got.first_user_id, got.name, got.cwd) == (1, "m1", None, "/x")


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    """Numbers run through blocks; carriage returns and empty files don't count."""
    want = {"a.jsonl": [f"line {k} " + "x" * (k % 90) for k in range(3000)], "b.jsonl": ["é", "", "end"], "c.jsonl": []}
    for name, lines in want.items():
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() if name == "a.jsonl" else "".join(x + "\n" for x in lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = sessions.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in want.items():
        assert [r.value for r in sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.line_no)] == lines
        assert sorted(r.line_no for r in rows if r.file.endswith(name)) == list(range(len(lines)))


def test_filings(spark):
    good = {"accessionNumber": ["1", "2", "1"], "filingDate": ["2026-01-02", "2026-02-02", "2026-01-02"], "form": ["10-K", "8-K", "10-K"], "primaryDocument": ["a", "b", "a"]}
    bad = {**good, "form": ["10-K"]}
    raw = spark.createDataFrame([("x", json.dumps(good)), ("y", json.dumps(bad)), ("z", "no")], "issuer string, json string")
    got = feeds.filings(raw, ["10-K"], "2026-01-01", "2026-12-31").collect()
    assert [(r.issuer, r.external_id, r.filed) for r in got] == [("x", "1", dt.date(2026, 1, 2))]


def test_tables_and_catalogs(spark):
    page = spark.createDataFrame([(1, "<table><TR><td>a <b>b</b></td><th>c</th></TR><tr><td>d</td></tr></table>")], "id int, html string")
    assert [(r.row_no, r.cells) for r in feeds.html_rows(page).orderBy("row_no").collect()] == [(0, ["a b", "c"]), (1, ["d"])]
    catalog = spark.createDataFrame([(json.dumps({"p": {"models": {"m": {"name": "M", "limit": {"context": 5}, "cost": {"input": 1.5}}}}}),)], "json string")
    assert [tuple(r) for r in feeds.model_catalog(catalog).collect()] == [("p", "m", "M", 5, 1.5, None)]
    market = spark.createDataFrame([(json.dumps({"columns": ["date", "close"], "data": [["2026-01-02", "10.5"], ["2026-01-03", "x"]]}),), (json.dumps({"columns": ["date", "a"], "data": [["2026-01-02"]]}),)], "json string")
    assert [(r.field, r.value) for r in feeds.market_table(market).orderBy("date").collect()] == [("close", 10.5), ("close", None)]
    wide = spark.createDataFrame([("FY2026", 1.0, None)], "period string, revenue double, profit double")
    assert [tuple(r) for r in feeds.long_facts(wide, ["period"]).collect()] == [("FY2026", "revenue", 1.0)]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S 1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Net </t><t>profit</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>SUM(C1:D1)</f><v>3</v></c></row><row r="2"><c r="AA2" t="inlineStr"><is><t>in</t></is></c><c r="C2"><f>A1</f></c><c r="D2" t="e"><v>#REF!</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    cells = files.read_workbooks(spark, str(tmp_path))
    assert [(r.cell_ref, r.row_index, r.col_index, r.formula, r.value) for r in cells.orderBy("row_index", "col_index").collect()] == [("A1", 1, 1, None, "Net profit"), ("B1", 1, 2, "=SUM(C1:D1)", "3"), ("C2", 2, 3, "=A1", None), ("D2", 2, 4, None, "#REF!"), ("AA2", 2, 27, None, "in")]
    (summary,) = files.workbook_summary(cells).collect()
    assert (summary.cells, summary.formulas, summary.errors, summary.uncached, summary["columns"]) == (5, 2, 1, 1, 27)
    assert [r.cell_ref for r in files.workbook_search(cells, "PROFIT").collect()] == ["A1"]


def test_attachments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1;h2\n1;2\n3\n")
    (tmp_path / "b.md").write_text("intro\n# A\ntext\n```\n# no heading\n```\n## B\nmore\n")
    (tmp_path / "c.txt").write_bytes("中文行\nzwei".encode("gb18030"))
    got = {}
    for r in files.read_attachments(spark, str(tmp_path)).orderBy("path", "chunk_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.heading, r.text))
    assert got["a.csv"] == [(1, "", "h1 | h2\n1 | 2\n3 | ")]
    assert got["b.md"] == [(1, "", "intro"), (3, "A", "text\n```\n# no heading\n```"), (8, "A > B", "more")]
    assert got["c.txt"] == [(1, "", "中文行\nzwei")]


def test_word(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    assert [(r.block_no, r.text) for r in files.read_word(spark, str(tmp_path)).collect()] == [(0, "one two")]


def test_streams_take_each_row_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id string, at timestamp_ntz"
    moment = dt.datetime(2026, 1, 1)

    def land(*ids):
        spark.createDataFrame([(i, moment) for i in ids], schema).write.mode("append").parquet(source)

    def run():
        stream = streams.deduplicated(streams.read_stream(spark, source, schema, "at"), ["id"], "at")
        streams.drained(stream, streams.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"))

    land("a", "a", "b")
    run()
    land("b", "c")
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_outbox_jobs_and_bars(spark):
    box = spark.createDataFrame([(1, "pending", 0, 0), (2, "pending", 2, 0), (3, "pending", 0, 999)], "id int, status string, attempts int, next_attempt_at long")
    assert [r.id for r in streams.due(box, 10).collect()] == [1, 2]
    results = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    assert {r.id: (r.status, r.attempts, r.next_attempt_at) for r in streams.delivered(box, results, 10).collect()} == {1: ("delivered", 1, 0), 2: ("pending", 3, 240_010), 3: ("pending", 0, 999)}
    jobs = spark.createDataFrame([(1, "running", 5, 1), (2, "running", 5, 3), (3, "running", 50, 1)], "id int, status string, lease_until long, attempts int")
    assert {r.id: r.status for r in streams.requeued(jobs, 10).collect()} == {1: "retry_wait", 2: "failed", 3: "running"}
    bars = lambda *x: spark.createDataFrame(x, "date string, close double")
    got = streams.merged_bars(bars(("1", 1.0), ("2", 2.0)), bars(("1", 9.0), ("2", 9.0), ("3", 3.0)), "2")
    assert {r.date: r.close for r in got.collect()} == {"1": 1.0, "2": 9.0, "3": 3.0}


@pytest.mark.parametrize("have", [[], ["deleted_at"], ["is_current", "lifecycle_state"]])
def test_active_predicate_adapts(spark, have):
    from sedimark.operators.catalog import active

    df = spark.range(1).select("id", *[F.lit(None).cast("string").alias(c) for c in have])
    assert df.filter(active(df)).count() == 1
