"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from glyphgrid import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, float) else x if isinstance(x, (str, bool)) else int(x)
    return sorted((tuple(clean(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    own, other = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


def test_entry_without_the_training_subpackage(tmp_path):
    """The rest imports and registers its queries where llm and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "glyphgrid", tmp_path / "glyphgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(queries.QUERIES)
