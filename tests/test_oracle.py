"""Every query of the library proper against its SQL in another engine."""

import math

import duckdb
import pytest

from marlspike.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, other, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = other.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_debounce_with_gaps_just_below_the_window(spark, tmp_path):
    """Gaps of 3599.4 to 3600 seconds: those that round to 3600 move the moment that the next gap counts from, though they aren't accepted."""
    con = duckdb.connect()
    gaps = "[0, 3599400000, 600000, 3599500000, 3599400000, 600000, 3599999999, 1, 3600000000, 1000]"
    con.execute(f"CREATE TABLE gaps AS SELECT k, i, {gaps}[(i + k) % 10 + 1] AS gap FROM range(12) a(k), range(40) b(i)")
    con.execute("CREATE TABLE events AS SELECT k * 40 + i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(sum(gap) OVER (PARTITION BY k ORDER BY i)::BIGINT) AS ts, k AS user_id, 'click' AS event_type, 0.5 AS value, '{}' AS props FROM gaps")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = registry.QUERIES["debounce_events"](spark, str(tmp_path)).select("key", "event_id", "ts").collect()
    wanted = con.execute(registry.ORACLE_SQL["debounce_events"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(wanted) and 100 < len(wanted) < 480
