"""Registered queries against DuckDB on the smallest tables, plans that scale, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from evalloom.plans import queries, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    # an index that finds most of what is near has no SQL; its recall is tested
    assert set(queries.QUERIES) == set(sql.ORACLE) | {"vector_search"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "n", "relevance_rate", "hallucination_rate", "len_avg", "len_p50"]


def test_filters_and_columns_reach_the_scan(spark):
    df = queries._t(spark, SF, "documents").where("lang = 'de'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "text" not in plan.split("ReadSchema")[1]
    for name in ("upper_median_by_type", "outcome_class", "keyword_frequency", "groups_satisfied", "global_and_grouped"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_rest_works_without_the_text_operators(tmp_path, with_pipeline):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/evalloom", f"{tmp_path}/evalloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if with_pipeline:
        if not os.path.exists(f"{root}/corpus_pipeline.py"):
            pytest.skip("the pipeline isn't here")
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{root}/tests", f"{tmp_path}/tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(sql.ORACLE))], out.stderr
    tests = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_reference.py", "-k", "limits or paths or verdicts or outcomes"], cwd=tmp_path, capture_output=True, text=True)
    assert tests.returncode == 0, tests.stdout


def test_other_missing_modules_are_errors(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/evalloom", f"{tmp_path}/evalloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode and "no_such_module" in out.stderr
