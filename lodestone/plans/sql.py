"""Queries given as SQL: one text for Spark, its twin for DuckDB where a function's name or form differs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLE = re.compile(r"\{(\w+)\}")


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose tables stand in braces."""
    names = sorted(set(_TABLE.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    return run


def twin(text: str) -> str:
    return _TABLE.sub(r"\1", text)


def register(both: dict[str, str], pairs: dict[str, tuple[str, str]]) -> tuple[dict, dict]:
    queries = {k: query(v) for k, v in both.items()} | {k: query(v[0]) for k, v in pairs.items()}
    oracles = {k: twin(v) for k, v in both.items()} | {k: twin(v[1]) for k, v in pairs.items()}
    return queries, oracles
