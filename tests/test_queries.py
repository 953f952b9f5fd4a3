"""Every query that has SQL against DuckDB on the smallest tables."""

import ast
import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def tidy(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return int(v) if hasattr(v, "__int__") and not isinstance(v, str) and float(v).is_integer() and not isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([tidy(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = con.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(theirs)
    number = lambda v: float(v) if type(v).__name__ in ("Decimal", "int") and not isinstance(v, bool) else v
    left = rows(df.columns, [[number(v) for v in r] for r in df.collect()])
    right = rows(theirs, [[number(v) for v in r] for r in got.fetchall()])
    assert left == right


def test_every_query_has_a_schema(spark):
    for name, f in registry.queries().items():
        if name not in registry.oracle_sql():
            assert f(spark, SF).columns, name


def test_findings_are_made_once_for_a_query(spark, monkeypatch):
    """Validation and explanation made episodes and findings for themselves and for the ranking again."""
    from emberlens.operators import detect, segment

    made = []
    for where, name in ((detect, "findings"), (segment, "episodes")):
        whole = getattr(where, name)
        monkeypatch.setattr(where, name, lambda *a, _f=whole, _n=name, **k: (made.append(_n), _f(*a, **k))[1])
    for query in ("val_validate", "val_explain"):
        made.clear()
        registry.queries()[query](spark, "/root/testdata/sf0.001")
        assert sorted(made) == ["episodes", "findings"]


def test_no_name_is_given_twice():
    """A helper of three queries was replaced by a later one of the same name in its module."""
    for path in sorted(Path(registry.__file__).parents[1].rglob("*.py")):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
        assert sorted(names) == sorted(set(names)), path


def _of_one_kind(spark, kind, sf=SF):
    """Rows of the query of one kind of findings, and those of that kind among all findings."""
    from emberlens.operators import detect
    from emberlens.plans import flow

    got = registry.queries()[f"det_{kind.lower()}"](spark, sf)
    whole = detect.findings(flow._members(spark, sf), flow.C).where(F.col("type") == kind).select(*got.columns)
    return [sorted(map(repr, d.collect())) for d in (got, whole)]


def test_findings_of_divergence(spark):
    got, whole = _of_one_kind(spark, "DIVERGENCE")
    assert got and got == whole


def test_findings_of_timing(spark):
    """The smallest tables have none."""
    got, whole = _of_one_kind(spark, "TIMING", "/root/testdata/sf0.01")
    assert got and got == whole


def test_findings_of_truncation(spark):
    got, whole = _of_one_kind(spark, "TRUNCATION")
    assert got and got == whole
