"""Every registered query against its statement, at the smallest scale."""

import math
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no sample tables")
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_statement(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    own = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert own == sorted(repr([plain(row[i]) for i in places]) for row in result.fetchall())


def test_entry_runs(spark):
    if not DATA.exists():
        pytest.skip("no sample tables")
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_optional_subpackage():
    root = Path(entry.__file__).parent / "panelforge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "panelforge.llm" not in path.read_text() and "from .llm" not in path.read_text()
