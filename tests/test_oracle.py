"""Every registered query with a SQL twin equals DuckDB on sf0.001; the
entry point runs; rows-only queries run."""
import pytest

import __spark_entry__ as E
from paths import SF0001
from tools.oracle_check import digest, duck

SQL = E.oracle_sql()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(SQL[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]
    # column types agree too
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == duck_types


def test_every_query_has_sql_or_is_model_backed():
    rows_only = set(E.queries()) - set(E.LLM_QUERIES) - set(SQL)
    assert rows_only == {"score_recovery", "risk_score", "score_anomaly", "anomaly_rate",
                         "event_intelligence", "event_intelligence_for_ids", "event_analysis_report"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "failure_rate" in df.columns
