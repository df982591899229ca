"""Streams in order of time equal batch windows, over restarts and late rows."""

import pandas as pd
from pyspark.sql import functions as F

from geoframe.streaming import ordered

SCHEMA = "k string, ts timestamp, zone string, v double"


def at(minute):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)


def put(spark, path, rows):
    spark.createDataFrame([(k, at(m).to_pydatetime(), z, v) for k, m, z, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, made, out):
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


FIRST = [("a", 5, "x", 2.0), ("a", 1, "x", 1.0), ("b", 2, None, 5.0), ("a", 9, "y", None), ("b", 30, "y", 7.0)]
#: A late row that is in time, one that is not, and one that lets all others pass.
SECOND = [("a", 25, None, 3.0), ("a", 40, "y", 4.0), ("a", 3, "z", 99.0), ("b", 31, "y", 1.0), ("c", 500, "x", 0.0)]


def test_moves_and_last_rows_go_on_after_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    seen = []
    for part in (FIRST, SECOND):
        put(spark, source, part)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        moves = run(spark, ordered.moves(stream, "k", "ts", "zone"), str(tmp_path / "moves"))
        last = run(spark, ordered.last_rows(stream, "k", "ts", "v", 2), str(tmp_path / "last"))
        seen.append((sorted((r.k, r.ts, r.move, r.zone) for r in moves.collect()), sorted((r.k, r.ts, r.rows, r.total, r.least, r.most) for r in last.collect())))
    t = lambda m: at(m).to_pydatetime()
    early = [("a", t(1), "enter", "x"), ("a", t(9), "enter", "y"), ("a", t(9), "leave", "x")]
    assert seen[0][0] == early
    assert seen[1][0] == sorted([*early, ("a", t(25), "leave", "y"), ("a", t(40), "enter", "y"), ("b", t(30), "enter", "y")])
    assert seen[1][1] == sorted([("a", t(1), 1, 1.0, 1.0, 1.0), ("a", t(5), 2, 3.0, 1.0, 2.0), ("a", t(9), 2, 2.0, 2.0, 2.0), ("a", t(25), 2, 3.0, 3.0, 3.0), ("a", t(40), 2, 7.0, 3.0, 4.0), ("b", t(2), 1, 5.0, 5.0, 5.0), ("b", t(30), 2, 12.0, 5.0, 7.0), ("b", t(31), 2, 8.0, 1.0, 7.0)])
    assert spark.read.parquet(source).where(F.col("v") == 99).count() == 1


def test_objects_share_states(spark, tmp_path):
    """A call of Python and a state for each object cost far more than its rows; a null key beside large numbers changes none of them."""
    source = str(tmp_path / "in")
    big = 2**60
    rows = [(big + k if k < 300 else None, at(m).to_pydatetime(), z) for k in range(301) for m, z in ((2, "y"), (1, "x"))]
    spark.createDataFrame([*rows, (0, at(99).to_pydatetime(), None)], "k long, ts timestamp, zone string").coalesce(1).write.parquet(source)
    made = ordered.moves(spark.readStream.schema("k long, ts timestamp, zone string").parquet(source), "k", "ts", "zone", states=8)
    out = str(tmp_path / "out")
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 9
    got = sorted(((r.k is None, r.k or 0, r.ts, r.move, r.zone) for r in spark.read.schema(made.schema).parquet(out).collect()))
    t = [at(m).to_pydatetime() for m in range(3)]
    keys = [(False, big + k) for k in range(300)] + [(True, 0)]
    assert got == [(*k, *told) for k in keys for told in ((t[1], "enter", "x"), (t[2], "enter", "y"), (t[2], "leave", "x"))]
