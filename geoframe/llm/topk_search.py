"""Exact top-k by inner product with a pivot-distance index.

Every vector x gets a further component sqrt(M^2 - |x|^2), M being the largest norm, and every query a zero: among vectors
of one norm M the larger inner product is the smaller distance.  A vector's key is its nearest pivot and its distance from
it, cut into annuli (rings); rings are cut again into parts of a bounded number of rows, so that a hot ring (equal vectors, say) is
many tasks.  Search expands annuli in two steps.  First each query scans the rings that its own distances from the pivots
point to, one after another until these hold k rows, which bounds the distance of its k-th neighbour.  Then it scans every other
ring that the triangle inequality leaves within that bound, and no more.  In both scans the queries that ask for a ring are dealt to
blocks, and the ring's rows are sent to those blocks only: what nobody asks for is not shuffled, and what is grows with the number of
(query, ring) pairs asked for over BLOCK_QUERIES.  The k best of the pieces are merged.

Pivots are fitted on a bounded sample (PIVOT_SAMPLE rows of smallest hash); every row is indexed.  There are so many pivots and rings that a
ring holds about RING_ROWS rows, but no more than PIVOTS and RINGS.

Defined results: vectors that are null or empty, or hold components that are null or not finite (also once multiplied), take no part, as
queries or candidates; vectors are compared with those of their own length, length by length; ties go to the smaller id; every row is a query and a candidate of
its own, so repeated ids are asked once each, and only the query's own row is no candidate of it; fewer candidates than k
give fewer rows; an empty table gives an empty table; further columns are ignored.  Inner products are exact and ranked exactly, whatever
their size; only a score that does not fit a long is shown as the largest (or smallest) long.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm.common import delete_written, written
from geoframe.llm.vectors import matrix

#: Pivots and rings of each at most, rows of a ring aimed at, rows that pivots and ring borders are fitted on, rows of a part and queries of a block.
PIVOTS, RINGS, RING_ROWS, PIVOT_SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 32, 16, 256, 8192, 4096, 512
LONG = 1 << 63


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id long, v array<double>: floor(scale * x) of each component, which a double holds as it is; row, a number of the row. Rows that take
    no part are left out. Kept as a table, so that rows keep their numbers."""
    x = F.transform(F.col("x").cast("array<double>"), lambda c: c * F.lit(float(scale)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).where((F.size("x") > 0) & F.col("id").isNotNull())
    rows = rows.select("id", x.alias("x")).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    # floor() gives longs: beyond 2^53 doubles are whole anyway.
    whole = F.transform("x", lambda c: F.when(F.abs(c) < F.lit(float(1 << 53)), F.floor(c).cast("double")).otherwise(c))
    return written(rows.select("id", whole.alias("v"), F.monotonically_increasing_id().alias("row")), "topk-rows")


def _fit(rows: DataFrame, unit: float, total: int, pivots: int, rings: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The unit, the largest norm in it, pivots (farthest-first over the sample) and ring borders."""
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / unit) * (c / unit)))).first()[0]
    norm = float(top or 0.0) ** 0.5
    wanted = max(1, -(-total // RING_ROWS))
    pivots = max(1, min(pivots, wanted))
    rings = max(1, min(rings, -(-wanted // pivots)))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).toPandas()
    points = np.array(sample["v"].tolist(), np.float64).reshape(len(sample), -1) / unit
    points = np.c_[points, np.sqrt(np.maximum(0, norm**2 - (points**2).sum(1)))]
    chosen, near = [0], np.full(len(points), np.inf)
    for _ in range(min(pivots, len(points)) - 1):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(near.argmax()))
    centres = points[chosen]
    d = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T))
    own, least = d.argmin(1), d.min(1)
    borders = np.array([np.quantile(least[own == p], np.linspace(0, 1, rings + 1)[1:-1]) if (own == p).any() else np.zeros(rings - 1) for p in range(len(centres))])
    return unit, norm, centres, borders.reshape(len(centres), rings - 1)


def _distances(v: np.ndarray, pivots: np.ndarray, norm: float, query: bool) -> np.ndarray:
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, norm**2 - (v**2).sum(1)))
    full = np.c_[v, last]
    return np.sqrt(np.maximum(0, (full**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * full @ pivots.T))


def index(rows: DataFrame, fitted: tuple[float, float, np.ndarray, np.ndarray]) -> DataFrame:
    """row, id, v, ring (pivot * rings + number of the annulus) and d, the distance from that pivot."""
    unit, norm, pivots, borders = fitted
    rings = borders.shape[1] + 1

    def run(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(matrix(b.column(2)) / unit, pivots, norm, False)
                own = d.argmin(1)
                least = d[np.arange(len(d)), own]
                ring = own * rings + (least[:, None] > borders[own]).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring.astype(np.int32)), pa.array(least)], names=["row", "id", "v", "ring", "d"])

    return rows.select("row", "id", "v").mapInArrow(run, "row long, id long, v array<double>, ring int, d double")


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, exact: doubles where these cannot round, longs where these hold them, else Python's integers."""
    most = float(np.abs(q).max()) * float(np.abs(v).max()) * v.shape[1]
    if most < 2**53:
        return q @ v.T
    if most < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = [[int(c) for c in x] for x in v.tolist()]
    return np.array([[sum(a * b for a, b in zip(map(int, x), y, strict=True)) for y in whole] for x in q.tolist()], object)


def _best(q: np.ndarray, own: np.ndarray, least: np.ndarray, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q, places in v and products of the k best of v for each of q, ties to the smaller id and row; own: the row that q is itself;
    least: what a product must reach to matter (-LONG: anything does)."""
    order = np.lexsort((rows, ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = []
    step = max(1, (1 << 21) // len(v))
    for s in range(0, len(q), step):
        scores = _products(q[s : s + step], v)
        floor = least[s : s + step, None]
        # Both are longs here, or doubles that hold them; a floor that no double holds is rounded to one that may be a little higher, so it is lowered.
        fine = (own[s : s + step, None] != rows[None]) & ((floor == -LONG) | (scores >= (floor if scores.dtype != np.float64 else floor - (np.abs(floor) >> 50))))
        if len(v) > k + 1 and scores.dtype != object:
            # With the query's own row there may be one too many, never one too few.
            fine &= scores >= np.partition(scores, len(v) - k - 1, axis=1)[:, len(v) - k - 1, None]
        i, j = np.nonzero(fine.astype(bool))
        x = scores[i, j]
        ranked = np.lexsort((place[j], -x, i)) if x.dtype != object else np.array(sorted(range(len(x)), key=lambda t: (i[t], -x[t], place[j[t]])), np.int64)
        i, j, x = i[ranked], j[ranked], x[ranked]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[rank < k] + s, j[rank < k], x[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _over(x) -> str:
    """A text that sorts as the integer x does if it does not fit a long, else ''."""
    if -LONG < x < LONG:
        return ""
    digits = f"{abs(x):0700d}"
    return digits if x > 0 else "".join(chr(ord("9") - int(c) + ord("0")) for c in digits)


def _scan(cells: DataFrame, queries: DataFrame, wanted: DataFrame, k: int, parts: DataFrame) -> DataFrame:
    """query (a row), query_id, row, id, score, over: the k best of each part of a wanted ring for each query, if they reach what is known to
    be reached. wanted: query, ring, least."""
    # One line for each ring; rings that nobody asks for have none, and their rows stay where they are.
    blocks = wanted.groupBy("ring").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")).join(F.broadcast(parts), "ring")
    block = F.pmod(F.xxhash64("query", "ring"), F.col("blocks")).cast("int").alias("block")
    asked = wanted.join(F.broadcast(blocks), "ring").select("query", "ring", "least", block, "parts")
    asked = asked.join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q")), "query")
    asked = asked.select("query", "query_id", "q", "least", "ring", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    offered = cells.join(F.broadcast(blocks), "ring").select("row", "id", "v", "ring", F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts")).cast("int").alias("part"), "blocks")
    offered = offered.select("row", "id", "v", "ring", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("query_id", "int64"), ("row", "int64"), ("id", "int64"), ("score", "int64"), ("over", "str"))})
        own, ids, rows = left["query"].to_numpy(), right["id"].to_numpy(), right["row"].to_numpy()
        i, j, x = _best(np.stack(left["q"].to_numpy()), own, left["least"].to_numpy(np.int64), np.stack(right["v"].to_numpy()), rows, ids, k)
        score = np.array([max(-LONG, min(LONG - 1, s)) for s in x], np.int64) if x.dtype == object else x.astype(np.int64)
        over = [_over(s) for s in x] if x.dtype == object else ""
        return pd.DataFrame({"query": own[i], "query_id": left["query_id"].to_numpy()[i], "row": rows[j], "id": ids[j], "score": score, "over": over})

    key = ["ring", "part", "block"]
    return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(best, "query long, query_id long, row long, id long, score long, over string")


def search(queries: DataFrame, rows: DataFrame, k: int = 10, pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest inner products among the other rows. Both are of quantized(): queries
    are some of the rows, told by their number, or rows of another table with numbers that the rows have not."""
    spark = rows.sparkSession
    # One line for each length of vectors.
    per = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("total"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("largest"))
    per = per.join(queries.select(F.size("v").alias("n")).distinct(), "n").orderBy("n").collect()
    found = [_search(*(x.where(F.size("v") == r["n"]) for x in (queries, rows)), r["total"], r["largest"], k, pivots, rings) for r in per]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search(queries: DataFrame, rows: DataFrame, total: int, largest: float, k: int, pivots: int, rings: int) -> DataFrame:
    """search() among vectors of one length."""
    spark = rows.sparkSession
    # Distances are taken in units of a power of two, so that squares of large components stay finite; products are not.
    unit = float(2.0 ** np.ceil(np.log2(largest))) if 0 < largest < 2.0**1023 else 2.0**1023 if largest else 1.0
    fitted = _fit(rows, unit, total, pivots, rings)
    _, norm, centres, borders = fitted
    per = borders.shape[1] + 1
    cells = written(index(rows, fitted), "topk-cells")
    # One line for each ring: at most pivots * rings of them, whatever the input.
    stats = cells.groupBy("ring").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("ring").toPandas()
    parts = spark.createDataFrame([(int(r), int(max(1, -(-n // BLOCK_ROWS)))) for r, n in zip(stats["ring"], stats["n"], strict=True)], "ring int, parts int")
    ring, n, lo, hi = (stats[c].to_numpy() for c in ("ring", "n", "lo", "hi"))
    slack = 1e-6 * max(1.0, norm)  # distances near 0 are known to about 1e-8 of the norm

    def gaps(v: np.ndarray) -> np.ndarray:
        d = _distances(v, centres, norm, True)[:, ring // per]
        return np.maximum(0, np.maximum(lo - d, d - hi))

    def first(batches):
        """The nearest annuli of each query until they hold k rows besides its own."""
        for b in batches:
            if b.num_rows:
                order = np.argsort(gaps(matrix(b.column(1)) / unit), axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                take = np.minimum((held < k + 1).sum(1) + 1, len(ring))
                at = np.repeat(np.arange(len(take)), take)
                which = np.concatenate([order[i, :t] for i, t in enumerate(take)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ring[which].astype(np.int32)), pa.array(np.full(len(at), -LONG))], names=["query", "ring", "least"])

    def rest(batches):
        """The annuli that may hold a row as good as the k-th so far and were not scanned."""
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1)) / unit
                least, seen = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_pylist()
                # Without k rows so far nothing is bounded, and a score that does not fit a long bounds nothing.
                unknown = (least == -LONG) | (least == LONG - 1)
                reach = np.sqrt(np.maximum(0, (v**2).sum(1) + norm**2 - 2 * (least.astype(float) / unit / unit))) + slack
                near = gaps(v) <= np.where(unknown, np.inf, reach)[:, None]
                for i, s in enumerate(seen):
                    near[i, np.isin(ring, s)] = False
                at, which = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ring[which].astype(np.int32)), b.column(2).take(pa.array(at))], names=["query", "ring", "least"])

    asked = queries.select("row", "id", "v")
    wanted = written(asked.select("row", "v").mapInArrow(first, "query long, ring int, least long"), "topk-first")
    near = written(_scan(cells, asked, wanted, k, parts), "topk-near")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("over"), "id", "row")
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("score").alias("kth"))
    seen = wanted.groupBy("query").agg(F.collect_list("ring").alias("seen"))
    todo = asked.join(seen, asked["row"] == seen["query"]).drop("query").join(kth, F.col("row") == kth["query"], "left")
    more = written(todo.select("row", "v", F.coalesce("kth", F.lit(-LONG)).alias("kth"), "seen").mapInArrow(rest, "query long, ring int, least long"), "topk-more")
    found = written(near.unionByName(_scan(cells, asked, more, k, parts)), "topk-found")
    delete_written(cells, wanted, near, more)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def oracle_sql(every: int = 100, k: int = 10) -> str:
    """DuckDB SQL that compares every query with every row."""
    return f"""
WITH ok AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, o.r AS o, o.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * o.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok o ON q.r <> o.r AND len(q.v) = len(o.v) AND q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
