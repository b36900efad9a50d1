import ast
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def spelled(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", PLAIN)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(spelled(r[c]) for c in cols) for r in df.collect())
    if name not in entry.oracle_sql():
        assert rows or name in ("audit_verify",)
        return
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(spelled(r[i]) for i in at) for r in got.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_optional_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(f"{root}/sievemark"):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                for node in ast.walk(ast.parse(open(f"{folder}/{n}").read())):
                    if isinstance(node, ast.ImportFrom):
                        assert "llm" not in (node.module or "").split(".")


def test_entry_imports_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run(["cp", "-r", f"{root}/sievemark", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/sievemark/llm"], check=True)
    code = "import __spark_entry__ as e; assert 'history_search' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
