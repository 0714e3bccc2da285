"""Citations in answers whose lines are long and end without a mark, against their SQL."""

import time

import duckdb

from corpusloom.plans import registry
from tests.test_queries import rows


def test_citations_of_long_lines(spark, tmp_path):
    long = "word and more, " * 2000
    texts = [f"{long}[E3]\n{long}\n{long}", f"{long} [E4]! Short one [E4]? {long}\n\n! [E1] ?? [E2]。{long}", "a [E1]\nb [E1]! c\n", "[E5]!?\r\nx [E5]\r", "One. Two [E9]！three [E9]", "", "\n\n"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'assistant', ?)", [(k, k % 7, texts[k % len(texts)]) for k in range(42)])
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    began = time.time()
    got = registry.queries()["g20_extract_citations"](spark, str(tmp_path)).toPandas()
    assert time.time() - began < 15
    assert rows(got) == rows(con.execute(registry.oracle_sql()["g20_extract_citations"]).df()) and len(got) > 42
