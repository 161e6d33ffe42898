"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math
import os
import random
import shutil
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from frameloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF).toArrow().to_pandas()
    if name in registry.SQL:
        want = oracle.sql(registry.SQL[name]).to_arrow_table().to_pandas()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


@pytest.mark.parametrize("kind", ["threshold", "odd"])
def test_suppression_equals_its_sql(spark, tmp_path, kind):
    """``threshold``: one pair whose overlap is 0.45 of the union, by a product but not by a quotient. ``odd``: nulls, not-a-number, empty boxes."""
    odd = [1.0, 4.0, 4.0, 25.0, -20.0, -25.0, -30.0, None, math.nan, math.inf]
    draw = random.Random(5)
    lines = [(1, 0, 33, 1, 4.0, 0.0), (1, 9, 55, 2, 4.0, 0.05)]
    if kind == "odd":
        lines = [(k // 8 if k // 8 % 9 else None, draw.choice([0, 9, 3, 6, 51, None]), draw.choice([33, 55, 0, None]), k, draw.choice(odd), draw.choice([0.0, 0.05, None, math.nan])) for k in range(4000)]
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
    columns = {n: pa.array(v, t) for n, v, t in zip(names, zip(*lines, strict=True), kinds, strict=True)}
    pq.write_table(pa.table(columns | {"l_extendedprice": pa.array([1.0] * len(lines))}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = rows_of(registry.QUERIES["top_nms"](spark, str(tmp_path)).toArrow().to_pandas())
    assert got == rows_of(con.sql(registry.SQL["top_nms"]).to_arrow_table().to_pandas())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_removable_parts(tmp_path, gone):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    assert out.stdout.split() == [str(len(registry.QUERIES)), "False", "True"]
