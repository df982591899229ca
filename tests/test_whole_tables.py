"""Queries over whole tables against their SQL, at a larger size than the catalogue's test."""

import duckdb
import pytest

from geoframe.plans import catalog
from tests.test_catalog import TABLES, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck_larger():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    return sorted(out.columns), sorted(repr(tuple(plain(r[c]) for c in sorted(out.columns))) for r in out.collect())


def rows_of_sql(duck, sql):
    r = duck.execute(sql)
    have = [d[0] for d in r.description]
    return sorted(have), sorted(repr(tuple(plain(x[have.index(c)]) for c in sorted(have))) for x in r.fetchall())


NAMES = "join_nullsafe idw distance_raster where_within where_disjoint where_distance sjoin_contains_keepall sjoin_disjoint spatial_stats connect_lines closest_point morphology_edge clip_raster".split()


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, duck_larger, name):
    got = rows_of(spark, name)
    assert got[1] and got == rows_of_sql(duck_larger, catalog.ORACLES[name])


def test_every_customer_reaches_the_join(spark, duck_larger):
    got = catalog.QUERIES["join_nullsafe"](spark, SF)
    assert got.count() == got.select("c_custkey").distinct().count() == 1500
    assert {r[0] for r in got.where("k IS NULL").select("p_partkey").collect()} == {7}


def test_every_customer_is_in_the_statistics(spark, duck_larger):
    cus = "SELECT count(*), round(sum(c_acctbal), 2) FROM cus, zon WHERE x > x1 AND x < x2 AND y > y1 AND y < y2"
    want = duck_larger.execute(catalog.cte("cus", "zon") + cus).fetchone()
    got = catalog.QUERIES["spatial_stats"](spark, SF).collect()
    assert (sum(r["n"] or 0 for r in got), round(sum(r["total"] or 0 for r in got), 2)) == want
