"""Every query with SQL gives DuckDB's rows on the smallest tables; without the optional parts, too."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["src_ip", "blocked"]


def test_without_optional_parts(tmp_path):
    """The entry point imports without the subpackage and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("__spark_entry__.py", "logloom"):
        subprocess.run(["cp", "-r", f"{root}/{part}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/logloom/llm"], check=True)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_coerce_timestamp_has_every_order(spark, duck):
    """29 February, too; without its year it is 1 March of 2023."""
    got = {r["o_orderkey"]: r for r in QUERIES["coerce_timestamp"](spark, DIR).collect()}
    days = duck.execute("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), strftime(o_orderdate, '%m-%d') FROM orders").fetchall()
    assert len(got) == len(days) and any(day == "02-29" for _, _, day in days)
    for key, text, day in days:
        r = got[key]
        assert {r["iso"], r["blank"], r["epoch"], r["millis"]} == {text}
        assert r["yearless"] == f"2023-{'03-01' if day == '02-29' else day}{text[10:]}"


def test_queries_without_sql(spark):
    """Scores have none: the first of each field's three candidates are those that the best-mapping query has."""
    assert set(QUERIES) - set(ORACLES) == {"map_fields_scored"}
    scored = QUERIES["map_fields_scored"](spark, DIR).collect()
    best = {r["field"]: r["path"] for r in QUERIES["map_fields_best"](spark, DIR).collect()}
    assert {r["field"]: r["path"] for r in scored if r["rank"] == 1} == best and all(0 <= r["score"] <= 1 for r in scored) and len(scored) == 3 * len(best)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_admission_parses_a_line_once(spark):
    """Checks of canonical columns don't repeat how these are made: the parser's pattern stands there for keys and values only."""
    from logloom.operators import normalize
    from logloom.queries import _broken

    events = _broken(spark, DIR)
    assert optimized(QUERIES["export_admission"](spark, DIR)).count(r"\G[") == 2
    taken, left = normalize.admitted(events), normalize.refused(events)
    assert "violations" not in taken.columns and "violations" in left.columns
    assert optimized(left).count(r"\G[") == 2
    assert taken.count() + left.count() == events.count() and taken.where("event_id % 5 <> 4").count() == 0


def test_templates_parse_a_line_once(spark):
    """The header's pattern stands there for one match only, with its eight groups as the way out; the line itself is rendered once."""
    from logloom.operators import source_profile
    from logloom.queries import _source

    lines = _source(spark, DIR)
    plan = optimized(source_profile.templates(source_profile.records(lines, source_profile.Format("CEF", 1.0)), most=None).select("template", "n"))
    assert plan.count(r"^CEF:\s*") == 10 and plan.count("CEF:0|broken|") == 1
