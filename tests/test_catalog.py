"""Every statement against DuckDB on the smallest tables."""

import json
import shutil
import subprocess
import sys

import duckdb
import pyarrow as pa
import pytest
from pyarrow import parquet

import __spark_entry__ as entry
from conftest import DATA, ROOT
from tidemark.plans import catalog
from tidemark.sources import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    expected = duck.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    places = [list(expected.columns).index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(shown(r[p]) for p in places) for r in expected.fetchall())


def rows_of(frame, columns):
    return sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())


#: Tables that the logical inputs read.
READ = sorted(set(views.TABLES.values()))


@pytest.fixture(scope="module")
def bare(tmp_path_factory):
    """The stored tables without rows."""
    folder = tmp_path_factory.mktemp("bare")
    for t in READ:
        parquet.write_table(parquet.read_table(f"{DATA}/{t}.parquet").slice(0, 0), folder / f"{t}.parquet")
    return str(folder)


def test_empty_tables(spark, bare):
    connection = duckdb.connect()
    for t in READ:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{bare}/{t}.parquet'")
    for name in sorted(catalog.QUERIES):
        frame = catalog.QUERIES[name](spark, bare)
        columns = sorted(frame.columns)
        got = rows_of(frame, columns)
        if name in catalog.ORACLES:
            expected = connection.sql(catalog.ORACLES[name])
            places = [list(expected.columns).index(c) for c in columns]
            assert got == sorted(tuple(shown(r[p]) for p in places) for r in expected.fetchall()), name
        else:
            assert got == [], name


@pytest.fixture(scope="module")
def holes(tmp_path_factory):
    """Some rows, some of them twice, rows with nulls in all columns but the first or in each of them, and one of nulls alone."""
    folder = tmp_path_factory.mktemp("holes")
    for t in READ:
        rows = parquet.read_table(f"{DATA}/{t}.parquet").slice(0, 30)
        n = len(rows.schema)
        held = rows.to_pylist()
        held += held[:3] + [{c: (v if k in keep else None) for k, (c, v) in enumerate(held[0].items())} for keep in ({0}, set(), *({*range(n)} - {k} for k in range(n)))]
        parquet.write_table(pa.Table.from_pylist(held, rows.schema), folder / f"{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("part", range(4))
def test_nulls_and_repeated_rows_do_not_crash(spark, holes, part):
    for name in sorted(catalog.QUERIES)[part::4]:
        if not name.startswith("case_"):
            catalog.QUERIES[name](spark, holes).collect()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    """The package without ``llm``, with and without the pipeline and the leftovers of compiled modules."""
    hidden = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=hidden)
    asked = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    for step in ("pipeline left", "caches left", "pipeline gone"):
        if step == "caches left":
            (tmp_path / "repo/tidemark/llm/__pycache__").mkdir(parents=True)
        if step == "pipeline gone":
            (tmp_path / "repo/corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-c", asked], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert json.loads(out.stdout) == [sorted(catalog.QUERIES), sorted(catalog.ORACLES)], step
