"""Oversized texts cut into pieces at natural boundaries.

A text is read as a tree of spans: sections under headings, paragraphs, lines (list items and table rows), sentences, clauses, words, characters. Sibling subtrees are merged from the bottom up as far as the limit allows, and only a node over the limit is opened. Spans are offsets into the text as stored, so all pieces without their overlap, put together, are the text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaspark.common import first_by, table

LIMIT, OVERLAP = 750, 80

Span = tuple[int, int]

# Marks of headings, with their levels.
HEADINGS = [
    (1, regex.compile(r"#(?!#)|<h1|第[一二三四五六七八九十百\d]+[部篇]")),
    (2, regex.compile(r"##(?!#)|<h2|第[一二三四五六七八九十百\d]+章|Chapter\s+\d+|[一二三四五六七八九十]+、")),
    (3, regex.compile(r"#{3,6}\s|<h[3-6]|第[一二三四五六七八九十百\d]+节|[（(][一二三四五六七八九十]+[)）]|Section\s+\d+|\d+\.\d+\s")),
]
LINE = regex.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|$)")
PARAGRAPH = regex.compile(r"(?:\r\n|[\r\n])[ \t　]*(?:\r\n|[\r\n])\s*")
SENTENCE = regex.compile(r"(?:[。！？!?…；;]+|\.(?=\s|$|[\"'”’)]))[”’」』》）)\"'\]]*\s*")
CLAUSE = regex.compile(r"[，、：,:—]+\s*|(?:</[a-z]+>|\|)\s*")
WORD = regex.compile(r"\s+")
GRAPHEME = regex.compile(r"\X")
#: Lines longer than this are no headings.
HEADING_CHARS = 60


def cuts(pattern: regex.Pattern, text: str, span: Span) -> list[Span]:
    """The span cut after each match."""
    out, at = [], span[0]
    for m in pattern.finditer(text, *span):
        if at < m.end() < span[1]:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, span[1]))
    return out


def heading_level(line: str) -> int:
    t = line.strip()
    if not t or len(t) > HEADING_CHARS or regex.search(r"[。！？；!?;]$", t):
        return 0
    return next((n for n, p in HEADINGS if p.match(t)), 0)


def sections(text: str, span: Span) -> list[tuple[int, Span]]:
    """Lines gathered under headings: (level of the heading or 0, span)."""
    out: list[tuple[int, Span]] = []
    at = span[0]
    while at < span[1]:
        m = LINE.match(text, at, span[1])
        end = max(m.end(), at + 1)
        n = heading_level(text[at:end])
        if n or not out:
            out.append((n, (at, end)))
        else:
            out[-1] = (out[-1][0], (out[-1][1][0], end))
        at = end
    return out


def children(text: str, kind: str, span: Span) -> tuple[str, list[Span]]:
    """The parts of a node and their kind; always at least two parts, or single characters."""
    if kind in ("text", "part1", "part2", "part3"):
        depth = 1 if kind == "text" else int(kind[-1]) + 1
        for n in range(depth, 4):
            parts: list[Span] = []
            for level, s in sections(text, span):
                if parts and not 0 < level <= n:
                    parts[-1] = (parts[-1][0], s[1])
                else:
                    parts.append(s)
            if len(parts) > 1:
                return f"part{n}", parts
        kind = "section"
    for of, pattern, made in (("section", PARAGRAPH, "paragraph"), ("paragraph", LINE, "line"), ("line", SENTENCE, "sentence"), ("sentence", CLAUSE, "clause"), ("clause", WORD, "word")):
        if kind == of:
            parts = cuts(pattern, text, span)
            if len(parts) > 1:
                return made, parts
            kind = made
    return "character", cuts(GRAPHEME, text, span)


def tree_pack(text: str, limit: int, kind: str = "text", span: Span | None = None, glue: bool = True) -> list[Span]:
    """Consecutive spans of at most `limit` characters that cover the text. `glue`: whether headings are moved to what they head."""
    span = span or (0, len(text))
    if span[1] - span[0] <= limit:
        return [span]
    made, parts = children(text, kind, span)
    if len(parts) == 1:  # one character of more than `limit` code points, such as a run of combining marks
        return [(i, min(i + limit, span[1])) for i in range(span[0], span[1], limit)]
    out: list[Span] = []
    for p in parts:
        for s in tree_pack(text, limit, made, p, glue) if p[1] - p[0] > limit else [p]:
            if out and s[1] - out[-1][0] <= limit:
                out[-1] = (out[-1][0], s[1])
            else:
                out.append(s)
    i = 0
    while glue and i < len(out) - 1:  # a heading goes with what it heads, or with its first sentences
        start, end = out[i]
        line = start + text[start:end].rstrip().rfind("\n") + 1
        if end - line <= limit // 2 and heading_level(text[line:end]):
            rest = (line, out[i + 1][1])
            made_of = [rest] if rest[1] - line <= limit else tree_pack(text, limit, "line", rest, False)
            if made_of[0][1] > end:
                out[i : i + 2] = [(start, line), *made_of] if line > start else made_of
                if line == start:
                    continue
        i += 1
    return out


def tail(text: str, span: Span, overlap: int) -> int:
    """Where the repeated end of a piece begins: at the earliest sentence, else clause, else word, that starts within the last `overlap` characters, else exactly there."""
    start = max(span[0], span[1] - overlap)
    if start == span[0]:
        return start
    for pattern in (SENTENCE, CLAUSE, WORD):
        for m in pattern.finditer(text, max(span[0], start - 8), span[1]):
            if start <= m.end() < span[1]:
                return m.end()
    while start < span[1] and regex.match(r"\p{M}|‍|\p{Variation_Selector}", text[start]):
        start += 1
    return start


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece: text[start:end], of which text[start:body start] repeats the end of the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    spans = tree_pack(text, limit - overlap)
    out = [(spans[0][0], spans[0][0], spans[0][1])]
    for before, s in zip(spans, spans[1:]):
        out.append((tail(text, before, overlap), *s))
    return out


def split(df: DataFrame, key: str = "node_id", text: str = "text", carry: tuple[str, ...] = ("chunk_ids",), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, start, overlap, piece, *carry) of every text over the limit, piece_no from 1.

    Null, empty and short texts give no rows. Rows of one key are alike but for their arrival and count once; of rows that differ, the one with the smallest text stays. `carry` columns may be null. `overlap` counts the characters that repeat the piece before."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    long = first_by(df.where(F.length(text) > limit).select(key, text, *carry), [key], F.col(text))
    schema = T.StructType([df.schema[key], *[T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "start", "overlap")], T.StructField("piece", T.StringType()), *[df.schema[c] for c in carry]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                t, rest = row[1], row[2:]
                found = split_text(t, limit, overlap)
                rows += [(row[0], i + 1, len(found), s, body - s, t[s:e], *rest) for i, (s, body, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=schema.names)

    return long.mapInPandas(run, schema)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are cut."""
    return split(table(spark, sf_dir, "blocks"), carry=()).where("piece_no = 1 and n_pieces > 1").select("node_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all blocks over 750 characters, with the chunks of their block."""
    return split(table(spark, sf_dir, "blocks"))


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block that is cut, put together again: the hash of its pieces without what they repeat, and whether all keep to the limit and the overlap."""
    p = p5_pieces(spark, sf_dir)
    body = F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]), "")  # the pieces of one text
    fits = F.bool_and((F.length("piece") <= LIMIT) & (F.col("overlap") <= OVERLAP) & (F.length("piece") > F.col("overlap")))
    return p.groupBy("node_id").agg(F.sha2(text, 256).alias("text_hash"), fits.alias("fits"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined}
SQL = {
    "p5_found": "select distinct node_id from blocks where length(text) > 750",
    "p5_rejoined": "select distinct node_id, sha256(text) as text_hash, true as fits from blocks where length(text) > 750",
}
