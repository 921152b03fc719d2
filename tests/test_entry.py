import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q for q in entry.queries() if q.startswith("q_")))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    assert sorted(repr([r[c] for c in sorted(names)]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 50 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
