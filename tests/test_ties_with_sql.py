"""Values on a threshold or between two digits, where the last bit of a number decides: query and SQL agree there too."""

import duckdb
import pytest

from clearspan.plans import catalogue


def both(spark, folder, table, name):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    found = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def coarse(tmp_path_factory):
    """Heights in steps of 0.02 m: one drop in a hundred is the threshold of 0.3 m but for its last bit."""
    folder = tmp_path_factory.mktemp("coarse")
    duckdb.sql(f"copy (select * replace (CAST(event_id * 7919 % 41 + 25 AS DOUBLE) as value) from '/root/testdata/sf0.01/events.parquet') to '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["w6_cluster_low_events", "a24_event_features", "j18_flanks", "j14_event_pairs"])
def test_drops_on_the_threshold(spark, coarse, name):
    ours, theirs = both(spark, coarse, "events", name)
    assert ours == theirs and ours


@pytest.fixture(scope="module")
def heights(tmp_path_factory):
    """Fixes whose heights lie between two tenths, or round to nought from below."""
    folder = tmp_path_factory.mktemp("heights")
    duckdb.sql(f"copy (select k as s_suppkey, 'n' as s_name, CAST(k % 25 AS INTEGER) as s_nationkey, CASE WHEN k % 2 = 0 THEN 10.0 * (k % 900) + 5 ELSE -1.0 * (k % 7) END::DOUBLE as s_acctbal from range(2000) t(k)) to '{folder}/supplier.parquet'")
    return folder


@pytest.mark.parametrize("name", ["p12_round_trip", "p7_p10_formats"])
def test_heights_between_digits(spark, heights, name):
    ours, theirs = both(spark, heights, "supplier", name)
    assert ours == theirs and ours
