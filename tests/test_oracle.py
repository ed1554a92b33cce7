"""Every query of the engine against the SQL that says the same."""

import math
from pathlib import Path

import duckdb
import pytest

from tarnwick.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equal(name, spark, duck):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert rows_of(got) == rows_of(want)
