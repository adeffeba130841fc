"""Driver contract: smoke entry, and every registered query against its
DuckDB oracle on the smallest driver tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.sources.tables import TABLES, path_of

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "revenue", "prev_month_rev", "mom_growth"]
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_plain_queries_load_without_the_optional_folders(tmp_path, with_pipeline):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "ledgerline"), tmp_path / "ledgerline",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        if os.path.exists(os.path.join(here, f)):
            shutil.copy(os.path.join(here, f), tmp_path)
    from ledgerline.plans import catalog
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))], out.stderr


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path_of(SF, t)}')")
    return c


def _norm(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return v.isoformat() if hasattr(v, "isoformat") else repr(v)
    return sorted(tuple(n(r[i]) for i in order) for r in rs)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = df.columns
    assert len(set(cols)) == len(cols), "duplicate output column names"
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    dcols = rel.columns
    assert sorted(cols) == sorted(dcols)
    duck_types = dict(zip(dcols, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert duck_types[f.name] == SPARK_TO_DUCK.get(st, st.upper()), (f.name, st)
    assert _norm(cols, srows) == _norm(dcols, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0
