"""Every registered query runs, and equals its SQL where it has some."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.jobs import catalog, designs, geometry, studies  # noqa: F401


def plain(value):
    """Missing values as None, numbers as floats of seven digits."""
    if pd.isna(value):
        return None
    if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)):
        return float(f"{float(value):.7g}") + 0.0
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    (columns, got), (expected_columns, expected) = rows_of(catalog.QUERIES[name](spark, sf_dir).toPandas()), rows_of(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())
    assert columns == expected_columns
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-8) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
