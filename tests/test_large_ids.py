"""Queries on events whose users have large numbers, against their SQL."""

from datetime import datetime, timedelta

import pytest

from fluxwarden import plans

FIRST = datetime(2024, 1, 1)


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")


def many(first_user):
    """A flow to an inner host every minute, by four sources in turn; ports change with each round."""
    return [(i, FIRST + timedelta(minutes=i), first_user + i % 4, ("click", "view", "error", "purchase", "click")[i % 5], 50.0 + i % 40, f'{{"k": {i // 4 % 6 + 40}}}') for i in range(400)]


def differences(spark, path, name):
    """Rows of the query, and how many rows only it or only the SQL gives."""
    import duckdb

    got = plans.queries()[name](spark, str(path))
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    con.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]})").fetchall()
    return len(rows), len(set(rows) ^ set(map(tuple, want))), len(want)


@pytest.mark.parametrize("name", ["lateral_alerts", "alerts_in_order", "ransomware_from_detectors"])
@pytest.mark.parametrize("first_user", [10, 65_534])
def test_sources_beyond_the_last_address(spark, tmp_path, name, first_user):
    events(spark, tmp_path, many(first_user))
    n, differ, want = differences(spark, tmp_path, name)
    assert n == want > 0 and differ == 0
