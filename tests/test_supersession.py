"""Requests whose numbers repeat, against the SQL."""

from collections import Counter

import duckdb

NAME = "jon_14_set_supersession"


def test_requests_of_repeated_numbers_equal_sql(spark, sf, tmp_path):
    from notegrid.plans.registry import oracle_sql, queries

    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS doc_id, 't' AS text, 'en' AS lang, 's' AS source, 1::BIGINT AS n_chars FROM range(104000)) TO '{tmp_path}/documents.parquet'")
    con.sql(f"COPY (SELECT * FROM read_parquet('{sf}/events.parquet')) TO '{tmp_path}/events.parquet'")
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.sql(oracle_sql()[NAME])
    got = queries()[NAME](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
