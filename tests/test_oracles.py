"""Every query of the engine against its DuckDB oracle."""

import decimal
import os

import duckdb
import pytest

from tidewatch import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    return c


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLES:
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall()), key=repr)


def test_loads_hold_events_of_any_number(spark, tmp_path):
    """Numbers below zero, missing and with fractions, in both loads."""
    events = "SELECT {} AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 20 MINUTE * id AS ts, 'view' AS event_type, id % 4 AS user_id, 1.5::DOUBLE AS value, '{{}}' AS props FROM range(90) t(id)"
    for k, number in enumerate(("id - 50", "CASE WHEN id % 3 > 0 THEN id END", "id / 4.0::DOUBLE - 3", "CASE WHEN id % 5 = 0 THEN 'nan'::DOUBLE ELSE id END")):
        (tmp_path / str(k)).mkdir()
        c = duckdb.connect()
        c.execute(f"COPY ({events.format(number)}) TO '{tmp_path}/{k}/events.parquet'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{k}/events.parquet'")
        want = sorted(c.execute(catalog.ORACLES["rollup_incremental"]).fetchall())
        got = catalog.QUERIES["rollup_incremental"](spark, f"{tmp_path}/{k}").select("hour", "name", "cnt", "uid")
        assert len(want) == 30 and sorted(map(tuple, got.collect())) == want


def test_partitions_make_no_difference(spark, sf):
    results = []
    for n in ("1", "2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, catalog.QUERIES["rule_sequence_3step"](spark, sf).collect())) + sorted(map(repr, catalog.flagship(spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
