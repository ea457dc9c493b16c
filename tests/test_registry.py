"""Every registered query that SQL can express, against DuckDB on the small tables."""

import datetime
import math

import duckdb
import pytest

from docweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([value(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_requests_hold_whole_texts(spark, duck, tmp_path):
    """Texts beyond the limits, which the tables don't have, by brute force and by the SQL."""
    texts = ["a" * 1900, "a" * 8000, "a" * 8001, "€" * 5000, "€" * 6000, "é" * 8100, "a" * 17000, " \n", "\u00a0"]
    rows = [(5 * c, t, "user", text) for c, text in enumerate(texts) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def codes(turn, text):
        message = "\n " if turn == 3 else text
        found = ["body_too_large"] if len(message.encode()) > 16_384 - 60 else []
        found += [[], ["unknown_field"], ["bad_version"], ["bad_conversation_id"]][turn]
        return ",".join(found + (["bad_message"] if not 1 <= len(message.strip()) <= 8000 else []))

    got = {r.request_id: r.codes for r in registry.QUERIES["validate_requests"](spark, str(tmp_path)).collect()}
    assert got == {c * 1000 + t: codes(t, text) for c, t, _, text in rows}
    sql = registry.ORACLES["validate_requests"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert dict(duck.execute(sql).fetchall()) == got
