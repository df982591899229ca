"""Streams per object in the order of their event times: what an object enters and leaves, and statistics of its last rows.

Rows wait in the state until the watermark has passed them, then they are taken in order. The state is what waits (as much as comes within the time
that rows may be late) and what the operator remembers; a timer takes rows on when an object sends no more. Spark keeps it in the query's checkpoint, so a restarted
query goes on where it was.

Objects share a state by the hash of their key, as a call of Python for each of them costs far more than its rows do. A batch rewrites the states that it
has rows for, so a stream of small batches over very many objects takes more of them.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an operator remembers of an object and its next values give what it remembers then, and the columns of rows to tell: the place of the value that each is for, and the made ones.
Step = Callable[[object, list], tuple[object, list[list]]]

#: States of a stream, unless it says otherwise; those of null keys are one more. Rows told at once.
STATES, TOLD = 1024, 10_000


def _plain(column: pd.Series) -> list:
    """Python values, None for nulls; equal texts as one object, which a state holds once."""
    values = column.astype(object).where(column.notna(), None).tolist()
    return [sys.intern(v) if type(v) is str else v for v in values]


def in_order(stream: DataFrame, key: str, time: str, value: str, late: str, step: Step, made: str, states: int = STATES) -> DataFrame:
    """key, time and the columns of made: step over each key's values by time (ties by value, nulls first). Null keys are an object of their own; rows without a
    time, and those that come when the watermark has passed them, take no part. states: how many states the keys share, the same after a restart."""
    rows = stream.select(F.col(key).alias("__key"), F.col(time).cast("timestamp").alias("__time"), F.col(value).alias("__value")).where("__time IS NOT NULL")
    rows = rows.withWatermark("__time", late).withColumn("__t", F.unix_micros("__time"))
    # Null keys are apart: among others they would make floats of whole numbers.
    rows = rows.withColumn("__of", F.when(F.col("__key").isNotNull(), F.pmod(F.xxhash64("__key"), F.lit(states))))
    names = [c.split()[0] for c in made.split(",")]
    schema = f"__key {rows.schema['__key'].dataType.simpleString()}, __t long, {made}"

    def told(columns: list[list]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(["__key", "__t", *names], (pd.Series(c, dtype=object) for c in columns), strict=True)))

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memo, *waiting = pickle.loads(state.get[0]) if state.exists else ({}, [], [], [])
        keys, times, values = waiting
        for p in batches:
            keys += _plain(p["__key"])
            times += p["__t"].tolist()
            values += _plain(p["__value"])
        mark = state.getCurrentWatermarkMs()
        by_key: dict = {}
        open_ = ([], [], [])
        for row in zip(keys, times, values, strict=True):
            if row[1] <= mark * 1000:
                by_key.setdefault(row[0], []).append(row[1:])
            else:
                for c, v in zip(open_, row, strict=True):
                    c.append(v)
        out: list[list] = [[] for _ in range(2 + len(names))]
        for k, ready in by_key.items():
            ready.sort(key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))
            memo[k], (places, *columns) = step(memo.get(k), [v for _, v in ready])
            for c, more in zip(out, ([k] * len(places), [ready[i][0] for i in places], *columns), strict=True):
                c += more
            if len(out[0]) >= TOLD:
                yield told(out)
                out = [[] for _ in out]
        state.update((pickle.dumps((memo, *open_)),))
        if open_[1]:
            state.setTimeoutTimestamp(max(min(open_[1]) // 1000, mark) + 1)
        yield told(out)

    met = rows.groupBy("__of").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return met.select(F.col("__key").alias(key), F.timestamp_micros("__t").alias(time), *names)


def moves(stream: DataFrame, key: str, time: str, zone: str, late: str = "10 minutes", states: int = STATES) -> DataFrame:
    """key, time, move (enter or leave) and zone (a string column of the stream, null outside of all zones) wherever an object's zone changes; remembers its last zone."""

    def step(last, zones):
        found = [(i, m, z) for i, (a, b) in enumerate(zip([last, *zones], zones)) if a != b for m, z in (("leave", a), ("enter", b)) if z is not None]  # noqa: B905
        return zones[-1], [[f[c] for f in found] for c in range(3)]

    return in_order(stream, key, time, zone, late, step, "move string, zone string", states)


def last_rows(stream: DataFrame, key: str, time: str, value: str, n: int, late: str = "10 minutes", states: int = STATES) -> DataFrame:
    """key, time, rows, total, least and most of the value over each row and the n - 1 before it of its key (nulls count as rows only); remembers n - 1 values."""

    def step(last, values):
        known = [*(last or []), *values]
        windows = [known[max(0, i - n + 1) : i + 1] for i in range(len(known) - len(values), len(known))]
        real = [[v for v in w if v is not None] for w in windows]
        tell = lambda f: [float(f(r)) if r else None for r in real]
        return known[max(0, len(known) - n + 1) :] if n > 1 else [], [list(range(len(values))), [len(w) for w in windows], tell(sum), tell(min), tell(max)]

    return in_order(stream, key, time, value, late, step, "rows long, total double, least double, most double", states)
