"""Workbooks and documents as rows of cells and paragraphs.

Files are read as binary rows and unzipped in Arrow batches; everything after the extraction of cells and paragraphs is DataFrame work."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

CELLS = "path string, sheet string, row int, cells array<string>"
BLOCKS = "path string, pos int, kind string, style string, text string"
# Words of header cells.
CODE_WORDS, NAME_WORDS, CREDIT_PARTS = ["课程代码", "课程编号", "课号"], ["课程名称", "课程名", "中文名称"], ["理论", "实践", "实验", "上机"]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = rels[s.get(f"{_R}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for i, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{_S}row")):
            cells: list[str | None] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                v, kind = c.find(f"{_S}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else v.text if v is not None else None
                cells.append(shared[int(text)] if kind == "s" and text is not None else text)
            yield s.get("name"), int(row.get("r") or i + 1), cells


def document_blocks(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(kind, style, text) of a document's paragraphs and table rows, in order; cells of a row are apart by ' | ', merged ones once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            yield "paragraph", style.get(f"{_W}val") if style is not None else "", text(e)
        elif e.tag == f"{_W}tbl":
            for r in e.iter(f"{_W}tr"):
                yield "row", "", " | ".join(dict.fromkeys(text(c).strip() for c in r.iter(f"{_W}tc")))


def files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Binary files below a folder, without temporary ones."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return f.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def archives(f: DataFrame) -> DataFrame:
    """Files that begin as ZIP archives, of any size."""
    return f.where(F.hex(F.substring("content", 1, 4)) == "504B0304")


def valid_uploads(f: DataFrame, largest: int = 50 << 20) -> DataFrame:
    """Uploads of allowed size that begin as ZIP archives. What is stored already is read whatever its size."""
    return archives(f.where((F.col("length") > 0) & (F.col("length") <= largest)))


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all sheets of all workbooks; a file that is no workbook gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, *r) for r in sheet_rows(bytes(content))], columns=["path", "sheet", "row", "cells"])

    return archives(files(spark, folder, ".xlsx")).select("path", "content").mapInPandas(run, CELLS)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and table rows of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, i, *r) for i, r in enumerate(document_blocks(bytes(content)))], columns=["path", "pos", "kind", "style", "text"])

    return archives(files(spark, folder, ".docx")).select("path", "content").mapInPandas(run, BLOCKS)


def holds(cells, words: list[str]):
    """Whether a cell, without white space, contains one of the words."""
    return F.exists(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "").rlike("|".join(words)))


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, names, first): the header of each sheet, the first row with a code and a name word. If the next row splits credits or hours, names are joined with it and rows begin after it. Sheets without a header have no row."""
    w = Window.partitionBy("path", "sheet").orderBy("row")
    c = cells.withColumn("below", F.lead("cells").over(w)).where(holds(F.col("cells"), CODE_WORDS) & holds(F.col("cells"), NAME_WORDS))
    h = c.groupBy("path", "sheet").agg(F.min_by(F.struct("row", "cells", "below"), "row").alias("h")).select("path", "sheet", "h.*")
    two = F.coalesce(holds(F.col("below"), CREDIT_PARTS), F.lit(False))
    tidy = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")
    filled = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cells"), F.size("below"))), lambda i: F.array_join(F.filter(F.array(tidy(F.try_element_at("cells", i)), tidy(F.try_element_at("below", i))), lambda x: x != ""), "-"))
    return h.select("path", "sheet", "row", F.when(two, filled).otherwise(F.transform("cells", tidy)).alias("names"), (F.col("row") + F.when(two, 2).otherwise(1)).alias("first"))


def column_index(names, candidates: list[str]):
    """Place (from 1) of the first candidate that equals a name, else of the first that a name contains, else null."""
    out = F.lit(None).cast("int")
    for word in reversed(candidates):
        out = F.coalesce(F.nullif(F.array_position(F.transform(names, _contains(word)), True), F.lit(0)).cast("int"), out)
    for word in reversed(candidates):
        out = F.coalesce(F.nullif(F.array_position(names, word), F.lit(0)).cast("int"), out)
    return out


def _contains(word: str):
    return lambda x: x.contains(word)


FIELDS = {"course_code": CODE_WORDS, "course_name": NAME_WORDS, "category": ["课程类别", "课程性质"], "subcategory": ["课程子类", "课程模块"], "credits": ["学分"], "hours": ["总学时", "学时"], "semester": ["开课学期", "学期"], "instructor": ["任课教师", "教师", "负责人"]}


def plan_courses(cells: DataFrame) -> DataFrame:
    """One row per course code of each plan sheet: attributes by header, categories filled from above, cells with several codes taken apart."""
    from sylvaspark.operators.programs import forward_fill

    h = header_rows(cells).withColumnRenamed("row", "_h")
    at = {k: column_index(F.col("names"), w).alias(f"_{k}") for k, w in FIELDS.items()}
    rows = cells.join(h.select("path", "sheet", "first", *at.values()), ["path", "sheet"]).where("row >= first")
    values = rows.select("path", "sheet", "row", *[F.nullif(F.trim(F.try_element_at("cells", F.col(f"_{k}"))), F.lit("")).alias(k) for k in FIELDS])
    filled = forward_fill(values, ["path", "sheet"], ["row"], "category", "subcategory")
    codes = F.regexp_extract_all(F.upper("course_code"), F.lit(r"([A-Z]{2,}[0-9]{4,})"), 1)
    return filled.withColumn("course_code", F.explode(codes))


def to_markdown(rows: DataFrame) -> DataFrame:
    """(path, table): table rows as markdown, a table being consecutive rows."""
    r = rows.where("kind = 'row'").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("path").orderBy("pos")))
    line = F.concat(F.lit("| "), F.col("text"), F.lit(" |"))
    return r.groupBy("path", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("table")).drop("run")
