import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def own():
    return {k: v for k, v in __spark_entry__.queries().items() if k != "pipeline" and not (k.startswith("op") and k[2].isdigit())}


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(own()) >= 70


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 10


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(own()) & set(__spark_entry__.oracle_sql())))
def test_queries_equal_their_sql(spark, duck, name):
    got = own()[name](spark, DATA)
    cols = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(f'\"{x}\"' for x in cols)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, expected))


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy of the repository without both folders and the pipeline still offers all other queries."""
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: {n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse")})
    say = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == sorted(own())
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout


@pytest.mark.parametrize("name", ["bank_inflows_fiscal_year", "runway_asof", "bm25_topk", "evidence_quote_valid"])
def test_plans_have_no_cartesian_products(spark, name):
    plan = own()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
