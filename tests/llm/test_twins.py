"""The corpus queries that SQL can express against their DuckDB twins on the smallest data set."""

from pathlib import Path

import duckdb
import pytest

from lodestone.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    mine, twin = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(twin.columns)
    assert sorted(mine.columns) == columns and len(mine) == len(twin) > 0

    def rows(frame):
        frame = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted(map(repr, frame.itertuples(index=False, name=None)))

    assert rows(mine) == rows(twin)
