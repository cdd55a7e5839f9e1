"""Every query runs on whole tables, and equals its SQL."""

import duckdb
import pytest

import __spark_entry__
from paperloom import queries as catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = plain(map(tuple, got.select(*columns).collect()))
    if name in catalog.ORACLES:
        found = db.execute(catalog.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == plain(tuple(r[k] for k in order) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_operators():
    import re
    from pathlib import Path

    root = Path(catalog.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
