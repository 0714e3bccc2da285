"""Feeds and API answers against their SQL on tables whose times tie, fall, or end within a payload."""

import duckdb
import pytest

from corpusloom.plans import registry
from tests.test_queries import SF, rows


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables and DuckDB over it: three events a second, then equal times, then falling ones; of the last ten items three."""
    d, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    micros = "CASE WHEN event_id < 60 THEN event_id * 300000 WHEN event_id < 120 THEN 60000000 ELSE (1000 - event_id) * 1000000 END"
    made = {"events": f"* REPLACE (TIMESTAMP '2024-01-05' + to_microseconds(CAST({micros} AS BIGINT)) AS ts)", "documents": "*", "labels": "*"}
    for t, columns in made.items():
        con.execute(f"COPY (SELECT {columns} FROM read_parquet('{SF}/{t}.parquet') {'WHERE doc_id < 193' if t == 'documents' else ''}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return str(d), con


@pytest.mark.parametrize("name", ["a6_flatten_feed", "a7_flatten_api_json"])
def test_visits_whatever_the_times(spark, odd, name):
    d, con = odd
    assert rows(registry.queries()[name](spark, d).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())
