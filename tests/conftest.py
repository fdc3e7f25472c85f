"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _text(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return "[" + ",".join(map(_text, v)) + "]"
    if v is None or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(df) -> list[tuple[str, ...]]:
    """Rows of a pandas table as sorted tuples of text, columns by name."""
    return sorted(tuple(_text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
