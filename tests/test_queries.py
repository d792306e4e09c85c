"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import engine_queries as Q
import engine_queries_more  # noqa: F401  adds its queries to the others

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    return None if v is None or v != v else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, db, name):
    df = Q.QUERIES[name](spark, sf)
    other = db.execute(Q.ORACLES[name])
    columns = sorted(c[0] for c in other.description)
    assert sorted(df.columns) == columns
    names = [c[0] for c in other.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in other.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want and got


def test_entry_has_the_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "entries", "bytes"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folder(tmp_path):
    """The rest imports and registers its queries if the folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in ("__spark_entry__.py", "engine_queries.py", "engine_queries_more.py", "fixture_writers.py"):
        shutil.copy(root / f, tmp_path)
    shutil.copytree(root / "burrow", tmp_path / "burrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert out.strip() == f"{len(Q.QUERIES)} []"


def test_a_broken_llm_folder_is_an_error(tmp_path):
    """Only an absent folder is passed over; what can't be imported, or an empty folder left behind, isn't the same."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in ("__spark_entry__.py", "engine_queries.py", "engine_queries_more.py", "fixture_writers.py"):
        shutil.copy(root / f, tmp_path)
    shutil.copytree(root / "burrow", tmp_path / "burrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "burrow" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("run = ORACLE_SQL = None")

    def imported():
        return subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)

    assert imported().returncode == 0
    (tmp_path / "burrow" / "llm" / "__init__.py").write_text("")
    (tmp_path / "burrow" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in imported().stderr
