"""Table functions for SQL: SELECT ... FROM documents, LATERAL md_blocks(text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from lodestone.functions.names import CITED
from lodestone.operators import chunks

_TOKEN = re.compile(r"\[([^\[\]\n]{1,80})\](?!\()")


@udtf(returnType="position int, kind string, level int, body string")
class Blocks:
    """The Markdown blocks of a text; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        found = chunks.split(text or "")
        for k, (kind, level, a, b) in enumerate(zip(found.kind.tolist(), found.level.tolist(), found.start.tolist(), found.end.tolist(), strict=True)):
            yield k, chunks.KINDS[kind], level, found.text[a:b]


@udtf(returnType="position int, heading string, body string")
class Chunks:
    """The chunks of a text, short ones too."""

    def eval(self, text: str) -> Iterator[tuple]:
        for k, (heading, body) in enumerate(chunks.chunks(text or "")):
            yield k, heading, body


@udtf(returnType="position int, token string, kind string")
class Citations:
    """Bracketed tokens outside code fences that are no links, with their kind."""

    def eval(self, text: str) -> Iterator[tuple]:
        found = chunks.split(text or "")
        open_ = "\n".join(found.text[a:b] for kind, a, b in zip(found.kind, found.start, found.end, strict=True) if kind != chunks.FENCE)
        tokens = [t for t in (m[1].strip() for m in _TOKEN.finditer(open_)) if t]
        for k, token in enumerate(tokens):
            yield k, token, next((name for name, pattern in CITED if re.search(pattern, token)), "other")


FUNCTIONS = {"md_blocks": Blocks, "md_chunks": Chunks, "md_citations": Citations}


def register(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, made)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents by kind, through SQL."""
    register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT b.kind, count(*) AS blocks, sum(length(b.body)) AS chars FROM {docs} d, LATERAL md_blocks(d.text) b GROUP BY b.kind", docs=docs)


QUERIES = {"str15_outline": outline}
ORACLES: dict[str, str] = {}
