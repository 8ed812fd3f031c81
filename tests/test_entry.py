"""Every query with SQL beside it gives the same rows on the smallest data set."""

import math
import shutil
import subprocess
import sys
from collections import Counter
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

from linksift.plans import queries
from linksift.plans.oracles import oracles

ORACLES = oracles()


@pytest.fixture(autouse=True)
def short_fits(monkeypatch):
    """What the rows of the model queries say does not depend on how long the fits are."""
    small = dict(trees=20, tree_depth=8, rounds=4, boost_depth=4, landmarks=32, svm_iter=20, max_iter=100)
    for name in ("RUN", "PAGES", "SCORER"):
        monkeypatch.setattr(queries, name, replace(getattr(queries, name), **small))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    have = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(
        tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()
    )
    assert have == want


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["id", "feature", "value", "severity"]
    assert df.count() > 0


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_subpackage(tmp_path, left):
    """A copy of the library without that subpackage still has all its own queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "linksift", tmp_path / "linksift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *left]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    told = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["True", str(len(queries.QUERIES))]
