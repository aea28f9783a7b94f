import json
import zipfile
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sylvaspark.operators.refresh import rate_limited
from sylvaspark.sources import files, office
from sylvaspark.streaming import events

REL = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>'
BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="计划" sheetId="1" r:id="rId1"/></sheets></workbook>'


def workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">' + "".join(cell(i, c, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", REL)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["某专业培养方案"], ["课程类别", "课程代码", "课程 名称", "学分", None, "开课学期"], [None, None, None, "理论", "实践"], ["必修", "AB0001", "甲", "2", "1", "3"], [None, "AB0002 AB0003", "乙", "2", None, "1-6"], ["选修", "AB0004", "丙", "1", None, "/"]])
    workbook(tmp_path / "none.xlsx", [["没有表头"], ["x"]])
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    workbook(tmp_path / "~$a.xlsx", [["课程代码", "课程名称"], ["ZZ0001", "x"]])
    cells = office.read_workbooks(spark, str(tmp_path))
    head = office.header_rows(cells).collect()
    assert len(head) == 1 and head[0]["row"] == 2 and head[0]["first"] == 4 and head[0]["names"][3:5] == ["学分-理论", "实践"]
    got = {r["course_code"]: (r["category"], r["course_name"], r["semester"]) for r in office.plan_courses(cells).collect()}
    assert got == {"AB0001": ("必修", "甲", "3"), "AB0002": ("必修", "乙", "1-6"), "AB0003": ("必修", "乙", "1-6"), "AB0004": ("选修", "丙", "/")}


def test_document(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = "<w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("周次", "周次", "内容")) + "</w:tr>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('第一章 绪论', 'Heading1')}{p('正文')}<w:tbl>{row}{row}</w:tbl></w:body></w:document>")
    got = [tuple(r)[1:] for r in office.read_documents(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, "paragraph", "Heading1", "第一章 绪论"), (1, "paragraph", "", "正文"), (2, "row", "", "周次 | 内容"), (3, "row", "", "周次 | 内容")]
    assert office.to_markdown(office.read_documents(spark, str(tmp_path))).first()["table"] == "| 周次 | 内容 |\n| 周次 | 内容 |"


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/idx"
    assert files.publish(spark.range(3), root, "course") == "course_v1" and files.publish(spark.range(5), root, "course", {"mrr": 0.5}) == "course_v2"
    assert files.active(spark, root, "course").count() == 5
    assert files.publish_if_better(spark.range(9), root, "course", {"mrr": 0.5}, {"mrr": 0.4}) is None and files.active(spark, root, "course").count() == 5
    for _ in range(52):
        files.point(spark, root, "course", "course_v1")
    assert len(files.record(spark, root, "course")["history"]) == 50 and files.active(spark, root, "course").count() == 3
    log = f"file://{tmp_path}/log"
    assert files.read_jsonl(spark, log, "a int").count() == 0
    files.append_jsonl(spark.range(2).withColumnRenamed("id", "a"), log)
    files.append_jsonl(spark.range(1).withColumnRenamed("id", "a"), log)
    assert files.read_jsonl(spark, log, "a int").count() == 3


def test_rate_limit_batch_equals_stream(spark, tmp_path):
    times = [1_000_000_020 + t for t in (0, 10, 20, 30, 61, 62, 81, 200)]
    rows = [(u, t) for u in ("a", "b") for t in times]
    df = spark.createDataFrame(rows, "user_id string, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    batch = {(r["client"], r["at"].timestamp()): r["allowed"] for r in rate_limited(df, "user_id", "ts").collect()}
    assert [batch["a", float(t)] for t in times] == [True, True, True, False, True, False, True, True]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"user_id": u, "ts": datetime.fromtimestamp(t, timezone.utc).isoformat(), "event_type": "x"}) for u, t in rows))
    stream = events.read_log(spark, str(tmp_path / "in"), "user_id string, ts timestamp, event_type string")
    q = events.rate_limit(stream).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["client"], r["at"].timestamp()): r["allowed"] for r in spark.table("limited").collect()}
    assert got == batch
    c = events.window_counts(events.read_log(spark, str(tmp_path / "in"), "user_id string, ts timestamp, event_type string"), width="1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert c.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("counted").collect()) == 16
    a = events.append_log(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert a.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 16
