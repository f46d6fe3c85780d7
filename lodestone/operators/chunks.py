"""Markdown as arrays of block boundaries, and chunks as spans found on them: whole texts, one Arrow pass, no shuffle.

A text is scanned once for its lines; blocks and pieces are rows of numpy arrays (kind, level, from, to). Since pieces lie in
order, their ends are running sizes, so the end of a chunk is a binary search, and a chunk with what it carries over from the one before
is one slice of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens at which a heading may end a chunk, most tokens of a chunk, tokens carried over, tokens at which even a fence is cut.
ENOUGH, MOST, CARRIED, HARD = 500, 800, 50, 6000
#: Characters of a token, least characters of a chunk, deepest heading that starts a section, tokens below which a fence stays with what precedes it.
CHARS, LEAST, SECTION, LEAD = 4, 20, 2, 120
#: Texts whose rows are made at once: a worker holds no more of a batch than these.
SLICE = 100
KINDS = ("blank", "paragraph", "table", "heading", "fence")
BLANK, PARAGRAPH, TABLE, HEADING, FENCE = range(5)
#: What a line begins with, if it is not a paragraph's: nothing, a fence (also as an item of a list), a title, a row of a table.
_LINE = re.compile(r"(?P<blank>[^\S\n]*$)|[^\S\n]*(?:(?:[-*+]|\d+[.)])[^\S\n]+)?(?P<mark>`{3,}|~{3,})(?P<info>[^\n]*)|[ ]{0,3}(?P<title>#{1,6})[^\S\n]+\S|[^\S\n]*(?P<row>\|)")
_MARK = "(?m)^[ \\t]*(?:(?:[-*+]|[0-9]+[.)])[ \\t]+)?(?:`{3}|~{3})"


class Blocks(NamedTuple):
    """Kind, level of a heading, and the span of each block of a text."""

    text: str
    kind: np.ndarray
    level: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(chars):
    return -(-chars // CHARS)


def _fenced(marks: list[tuple[int, str, bool]], lines: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines from an opening mark to the next bare one of its kind and at least its length; without one, to the end."""
    free = 0
    for place, (line, mark, _) in enumerate(marks):
        if line >= free:
            closing = (at for at, other, bare in marks[place + 1 :] if bare and other.startswith(mark))
            free = next(closing, lines - 1) + 1
            yield line, free


def split(text: str) -> Blocks:
    text = re.sub(r"\r\n?", "\n", text)
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    first, last = np.r_[0, breaks + 1], np.r_[breaks, len(text)]
    found = [_LINE.match(text, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    what = {None: PARAGRAPH, "blank": BLANK, "info": FENCE, "title": HEADING, "row": TABLE}
    kind = np.array([what[m and m.lastgroup] for m in found], np.int64)
    level = np.array([len(m["title"]) if m and m["title"] else 0 for m in found], np.int64)
    marks = [(k, found[k]["mark"], not found[k]["info"].strip() and found[k].start("mark") == found[k].end() - len(found[k][0].lstrip())) for k in np.flatnonzero(kind == FENCE)]
    run = np.zeros(len(kind), np.int64)
    for number, (a, b) in enumerate(_fenced(marks, len(kind))):
        kind[a:b], run[a:b], level[a:b] = FENCE, number + 1, 0
    begins = (kind != BLANK) & np.r_[True, (kind[1:] != kind[:-1]) | (run[1:] != run[:-1]) | (kind[1:] == HEADING)]
    ends = (kind != BLANK) & np.r_[(kind[1:] != kind[:-1]) | (run[1:] != run[:-1]) | (kind[1:] == HEADING), True]
    head = np.flatnonzero(begins)
    start, end = first[head], last[np.flatnonzero(ends)]
    for k in np.flatnonzero(np.isin(kind[head], (HEADING, FENCE))):  # a title without its margins, an open fence without empty lines at its end
        body = text[start[k] : end[k]]
        start[k] += len(body) - len(body.lstrip()) if kind[head[k]] == HEADING else 0
        end[k] -= len(body) - len(body.rstrip(None if kind[head[k]] == HEADING else "\n"))
    return Blocks(text, kind[head], level[head], start, end)


def _pieces(found: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, start and end of each piece: blocks longer than a chunk (fences and tables: than HARD) end at a line, else a word, else anywhere."""
    rows = []
    for k, (kind, a, b) in enumerate(zip(found.kind.tolist(), found.start.tolist(), found.end.tolist(), strict=True)):
        room = CHARS * (HARD if kind in (FENCE, TABLE) else MOST - CARRIED)
        while a < b:
            to = b
            if b - a > room:
                to = next((p for p in (found.text.rfind(c, a + 1, a + room + 1) for c in "\n ") if p > 0), a + room)
            rows.append((k, a, to))
            a = to
            while a < b and found.text[a] in " \n":
                a += 1
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def _carry(found: Blocks, at: int) -> int:
    """Where the words begin that end at this place and are carried over; the place itself if they touch a fence or a table."""
    least = max(0, at - CARRIED * CHARS)
    space = re.compile(r"\s+").search(found.text, least, at)
    begin = space.end() if space and least else at
    held = slice(int(np.searchsorted(found.end, begin, side="right")), int(np.searchsorted(found.start, at)))
    return at if np.isin(found.kind[held], (FENCE, TABLE)).any() else begin


def spans(found: Blocks) -> Iterator[tuple[int | None, int, int]]:
    """Block of the section's heading (or None), start and end of each chunk."""
    block, start, end = _pieces(found)
    atomic = np.isin(found.kind[block], (FENCE, TABLE))
    titles = np.flatnonzero((found.kind[block] == HEADING) & (found.level[block] <= SECTION))
    i, begin = 0, int(start[0]) if len(start) else 0
    while i < len(start):
        if tokens(end[i] - begin) > MOST:
            begin = start[i]
        j = max(i + 1, int(np.searchsorted(end, begin + MOST * CHARS, side="right")))
        if j < len(end) and atomic[j] and tokens(end[j - 1] - begin) < LEAD:
            j += 1
        enough = max(i + 1, int(np.searchsorted(end, begin + (ENOUGH - 1) * CHARS, side="right")) + 1)
        title = np.searchsorted(titles, enough)
        if title < len(titles):
            j = min(j, int(titles[title]))
        above = np.searchsorted(titles, i, side="right") - 1
        yield int(block[titles[above]]) if above >= 0 else None, int(begin), int(end[j - 1])
        begin, i = _carry(found, int(end[j - 1])), j
        if i < len(start) and not found.text[begin : start[i]].strip():
            begin = start[i]


def chunks(text: str) -> Iterator[tuple[str | None, str]]:
    """Heading and text of each chunk."""
    found = split(text)
    for k, a, b in spans(found):
        yield None if k is None else found.text[found.start[k] : found.end[k]].lstrip("# ").strip(), found.text[a:b]


def carried(text: Column) -> Column:
    """The last words of a text within CARRIED tokens; nothing if the text is no longer than that, or if they touch a fence or a table."""
    size = F.char_length(text)
    tail = F.trim(F.regexp_extract(F.right(text, F.lit(CARRIED * CHARS)), "(?s)^\\S*\\s+(.*)$", 1))
    open_ = F.regexp_count(F.left(text, size - F.char_length(tail)), F.lit(_MARK)) % 2 == 1
    touches = open_ | (F.regexp_count(tail, F.lit(_MARK)) > 0) | (F.regexp_count(tail, F.lit("(?m)^[ \\t]*\\|")) > 0)
    return F.when((size <= CARRIED * CHARS) | touches, "").otherwise(tail)


def chunk(docs: DataFrame) -> DataFrame:
    """One row per chunk of docs (doc_id, text): doc_id, position, heading, text, tokens, id.

    Null and empty texts have no chunks; a chunk shorter than LEAST characters is left out and positions count on;
    equal rows give equal chunks; other columns are ignored.
    """

    def rows(text: str) -> list[tuple]:
        return [(k, heading, body, tokens(len(body))) for k, (heading, body) in enumerate(chunks(text)) if len(body.strip()) >= LEAST]

    made = _by_text(docs, rows, (("position", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("tokens", pa.int32())))
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit("section"), "position", "text"))
    return made.withColumn("id", key)


def block_rows(docs: DataFrame) -> DataFrame:
    """One row per block of docs (doc_id, text): doc_id, position, kind, level, chars."""

    def rows(text: str) -> list[tuple]:
        found = split(text)
        return [(k, KINDS[kind], level, chars) for k, (kind, level, chars) in enumerate(zip(found.kind.tolist(), found.level.tolist(), (found.end - found.start).tolist(), strict=True))]

    return _by_text(docs, rows, (("position", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("chars", pa.int32())))


def _by_text(docs: DataFrame, rows, columns: tuple) -> DataFrame:
    """doc_id and the rows that a function makes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            made = [rows(t or "") for t in batch.column(1).to_pylist()]
            place = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            values = list(zip(*(r for m in made for r in m), strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), *(pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True))], names=["doc_id", *(c for c, _ in columns)])

    kinds = {pa.int32(): "int", pa.string(): "string"}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} {kinds[t]}" for c, t in columns)]))


#: Tags and what stands for them in Markdown; all other tags are dropped.
_TAGS = ((r"(?i)<h([12])[^>]*>", "\n\n## "), (r"(?i)<h[3-6][^>]*>", "\n\n### "), (r"(?i)<tr[^>]*>", "\n| "), (r"(?i)</?pre[^>]*>", "\n```\n"), (r"(?i)</?(?:p|div|h[1-6]|ul|ol|table)[^>]*>", "\n\n"), (r"(?i)<li[^>]*>", "\n- "), (r"<[^>]*>", ""))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: headings, rows of tables, items of lists and code from their tags."""
    text = F.coalesce("html", F.lit(""))
    for pattern, made in _TAGS:
        text = F.regexp_replace(text, pattern, made)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), text.alias("text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


QUERIES = {
    "grf23_chunks": lambda spark, sf_dir: chunk(_texts(spark, sf_dir)),
    "grf23_page_chunks": lambda spark, sf_dir: chunk(_markdown(spark, sf_dir)),
    "str15_blocks": lambda spark, sf_dir: block_rows(_markdown(spark, sf_dir)),
    "str15_paragraphs": lambda spark, sf_dir: block_rows(_texts(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("chars").alias("chars")),
}
_SQL = "coalesce(html, '')"
for _pattern, _made in _TAGS:
    _SQL = f"regexp_replace({_SQL}, '{_pattern}', '{_made}', 'g')"
QUERIES["str17_markdown"] = lambda spark, sf_dir: _markdown(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))
ORACLES = {"str17_markdown": f"SELECT page_id, md5({_SQL}) AS digest, CAST(length({_SQL}) AS BIGINT) AS chars FROM pages"}
QUERIES["str16_overlap"] = lambda spark, sf_dir: _texts(spark, sf_dir).select("doc_id", carried(F.coalesce("text", F.lit(""))).alias("carried"))
_RIGHT = f"trim(regexp_extract(right(t, {CARRIED * CHARS}), '(?s)^\\S*\\s+(.*)$', 1))"
ORACLES["str16_overlap"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, {_RIGHT} AS tail FROM d),
n AS (SELECT *, len(regexp_extract_all(left(t, length(t) - length(tail)), '{_MARK}')) AS before, len(regexp_extract_all(tail, '{_MARK}')) AS inside FROM c)
SELECT doc_id, CASE WHEN length(t) <= {CARRIED * CHARS} OR before % 2 = 1 OR inside > 0 OR regexp_matches(tail, '(?m)^[ \\t]*\\|') THEN '' ELSE tail END AS carried FROM n"""
#: Lines as rows; in these pages a fence is opened and closed by bare marks, so an odd number of marks so far means inside.
ORACLES["str15_blocks"] = f"""
WITH p AS (SELECT page_id AS doc_id, string_split(regexp_replace({_SQL}, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT doc_id, ls[k] AS line, k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM p) q),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS marks, regexp_matches(line, '^\\s*```') AS mark FROM l),
c AS (SELECT *, CASE WHEN mark OR marks % 2 = 1 THEN 'fence' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s+\\S') THEN 'heading' WHEN ltrim(line)[1] = '|' THEN 'table' ELSE 'paragraph' END AS kind,
      (marks + 1) // 2 AS fence FROM m),
s AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER w OR (kind = 'fence' AND fence IS DISTINCT FROM lag(fence) OVER w) THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM s),
b AS (SELECT doc_id, run, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY k) AS body FROM r WHERE kind <> 'blank' GROUP BY doc_id, run)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS position, kind,
       CAST(CASE WHEN kind = 'heading' THEN length(regexp_extract(body, '#+')) ELSE 0 END AS INTEGER) AS level,
       CAST(length(CASE kind WHEN 'heading' THEN trim(body, ' ' || chr(9) || chr(11) || chr(12)) WHEN 'fence' THEN rtrim(body, chr(10)) ELSE body END) AS INTEGER) AS chars FROM b"""
