"""Every query of the catalog runs, and gives the rows of its SQL where it has one."""

import math
import os

import duckdb
import pytest

from pagemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if isinstance(value, float):
        return repr(round(value, 5)) if value != int(value) else str(int(value))
    return str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    rows = frame.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in frame.columns) for r in result.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == want


def test_no_query_reads_the_corpus_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "pagemill")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "pagemill.llm" not in text.read(), f
