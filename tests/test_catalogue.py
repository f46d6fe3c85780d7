"""Every query of the catalogue against its DuckDB twin on the smallest data set."""

from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    mine, twin = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    columns = sorted(twin.columns)
    assert sorted(mine.columns) == columns
    assert rows(mine, columns) == rows(twin, columns)
