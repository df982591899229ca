"""Near-duplicate embeddings by cross-polytope hashing.

Unit vectors are rotated at random (three rounds of random signs and a fast Hadamard transform); the hash is the axis, with
sign, that the rotated vector is nearest to.  A table's bucket is made of HASHES(n) such axes; each vector is put into the
bucket of its nearest axes and into the next best ones (multiprobe).  Only numbers of vectors are put into buckets; buckets of one vector
go at once, and a vector is sent once to each block that it is compared in.  Pairs that meet in a bucket are compared exactly in
blocks of bounded size, so a hot bucket is many tasks.  A pair is counted only in the first bucket that the two share, which is
told from the buckets of the few vectors that have links, made anew there; a block returns a row for each vector that has links in it, never its pairs: the
number of links, and the smallest id that it is connected with inside the block.  Equal vectors are one before all this.

Defined results: links need equal labels, not null, and equal lengths; vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing and are their own component; repeated ids are rows of their own that share n_links
and component; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import written
from geoframe.operators.components import components
from geoframe.llm.vectors import lists, matrix

#: Tables, buckets that a vector is put into in each, rows of a bucket aimed at, and rows of a block.
TABLES, PROBES, BUCKET_ROWS, BLOCK_ROWS, SEED = 8, 2, 512, 2048, 20240229


def hashes_for(rows: int, width: int) -> int:
    """Axes that a bucket is made of, so that buckets stay near BUCKET_ROWS as the largest label grows."""
    return max(1, math.ceil(math.log(max(1, rows * PROBES / BUCKET_ROWS)) / math.log(2 * width) - 0.5))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def buckets(unit: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """rows x tables x probes: the numbers of the best `probes` buckets in each table."""
    n, dim = unit.shape  # a row's buckets do not depend on the other rows
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    rng, out = np.random.default_rng(SEED), np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        codes, costs = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            r = padded
            for _ in range(3):
                r = hadamard(r * rng.choice((-1.0, 1.0), width))
            both = np.concatenate((r, -r), axis=1)
            near = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            cost = both.max(1)[:, None] - np.take_along_axis(both, near, 1)
            codes = (codes[:, :, None] * (2 * width) + near[:, None, :]).reshape(n, -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
            best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
        out[:, t, : codes.shape[1]] = codes
        out[:, t, codes.shape[1] :] = codes[:, :1]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of norm 1. The largest component becomes 1 first, so that no square overflows or vanishes whatever the components' size."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pairs(v: np.ndarray, left: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of a block; left marks the first side of a pair of blocks, None: one block."""
    cos = v @ v.T if left is None else v[left] @ v[~left].T
    i, j = np.nonzero(cos >= least)
    if left is None:
        return i[i < j], j[i < j]
    return np.flatnonzero(left)[i], np.flatnonzero(~left)[j]


def _told(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray, codes: np.ndarray, table: int, bucket: int):
    """ids, links and smallest connected id for the rows of a block with links (i, j). codes: rows x tables x probes; a pair counts where it meets first."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    label[order] = np.arange(len(ids))
    while True:  # the smallest id spreads along the links
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        same = codes[i, t][:, :, None] == codes[j, t][:, None, :]
        if t == table:
            same &= codes[i, t][:, :, None] < bucket
        first &= ~same.any((1, 2))
    i, j = i[first], j[first]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    touched = (links > 0) | (label != np.argsort(order, kind="stable"))
    return ids[touched], links[touched].astype(np.int64), ids[order][label[touched]]


def links(classes: DataFrame, hashes: int, least: float) -> DataFrame:
    """id, n, low: for vectors (cls, label, id, v, copies), how many links were counted in a block and the smallest id in reach there."""

    def hashed(batches):
        for whole in batches:
            lengths = np.asarray(pc.list_value_length(whole.column(2)))
            for n in np.unique(lengths).tolist():  # vectors of one length at a time
                b = whole.take(pa.array(np.flatnonzero(lengths == n)))
                v = _unit(matrix(b.column(2)))
                for s in range(0, len(v), 4096):
                    part = b.slice(s, 4096)
                    codes = buckets(v[s : s + 4096], hashes)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(codes.reshape(part.num_rows, -1), pa.int64())], names=["cls", "label", "codes"])

    codes = classes.select("cls", "label", "v").mapInArrow(hashed, "cls long, label string, codes array<long>")
    codes = written(codes, "embedding-codes")
    posted = codes.select("cls", "label", F.explode(F.array_distinct(F.transform("codes", lambda c, i: F.struct((i / PROBES).cast("int").alias("table"), c.alias("bucket"))))).alias("b"))
    posted = posted.select("cls", "label", "b.table", "b.bucket")
    key = ["label", "table", "bucket"]
    sizes = posted.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    placed = posted.join(sizes, key).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("a"), F.greatest(F.col("own"), o).alias("b")))
    dealt = placed.withColumn("pair", F.explode(pairs)).select(*key, F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "own", "cls")
    dealt = dealt.join(classes.select("cls", "id", "copies", "v"), "cls").drop("cls")
    by = [*key, "a", "b"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)

    def found(batches):
        held: list[pa.RecordBatch] = []
        waiting: list[tuple] = []  # blocks with links, whose rows' buckets are made for many blocks at a time

        def compared(done):
            t = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            a, b = t.column(3)[0].as_py(), t.column(4)[0].as_py()
            v = _unit(matrix(t.column(8)))
            i, j = _pairs(v, None if a == b else t.column(5).to_numpy() == a, least)
            if not len(i):
                return
            some = np.unique(np.concatenate((i, j)))
            ids, copies = t.column(6).to_numpy()[some], t.column(7).to_numpy()[some]
            if waiting and (waiting[-1][0].shape[1] != v.shape[1] or sum(len(w[0]) for w in waiting) >= 8192 or sum(len(w[3]) for w in waiting) >= 1 << 20):
                yield from flush()
            waiting.append((v[some], ids, copies, np.searchsorted(some, i), np.searchsorted(some, j), t.column(1)[0].as_py(), t.column(2)[0].as_py()))

        def flush():
            codes = buckets(np.concatenate([w[0] for w in waiting]), hashes, 1 + max(w[5] for w in waiting))
            ends = np.cumsum([len(w[0]) for w in waiting])
            for (v, ids, copies, i, j, table, bucket), end in zip(waiting, ends.tolist(), strict=True):
                got = _told(ids, copies, i, j, codes[end - len(v) : end], table, bucket)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["id", "n", "low"])
            waiting.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in range(5)]
            change = np.zeros(batch.num_rows, bool)
            for c in keys:
                x = np.asarray(c.to_numpy(zero_copy_only=False))
                change[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                key_now = tuple(c[s].as_py() for c in keys)
                if held and key_now != last:
                    yield from compared(held)
                    held = []
                last = key_now
                held.append(batch.slice(s, e - s))
        if held:
            yield from compared(held)
        if waiting:
            yield from flush()

    return dealt.mapInArrow(found, "id long, n long, low long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """id_col, n_links, component_id, kept: a row for each row of df."""
    x, kind = F.col("v"), "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = rows.withColumn("fine", F.coalesce((F.size("v") > 0) & fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    # The length is part of the label: only vectors of one length can be compared.
    label = F.concat_ws(":", F.size("v").cast("string"), "label")
    keyed = rows.where("fine").select(label.alias("label"), "id", "v", F.sha2(F.concat_ws(",", F.transform("v", lambda c: (c + F.lit(0.0)).cast("string"))), 256).alias("same"))
    classes = keyed.groupBy("label", "same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "embedding-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).agg(F.max("n"), F.max("w")).first()
    hashes = hashes_for(largest[0] or 1, largest[1] or 1)
    counted = written(links(classes, hashes, least), "embedding-links")
    per = counted.groupBy("id").agg(F.sum("n").alias("n"))
    linked = components(counted.select(F.col("id").alias("a"), F.col("low").alias("b")))
    told = classes.select("label", "same", "copies", F.col("id").alias("rep")).join(per.withColumnRenamed("id", "rep"), "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("label", "same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    whole = keyed.select("id", "label", "same").join(told, ["label", "same"]).select("id", "n_links", "component_id")
    whole = whole.unionByName(rows.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return whole.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def oracle_sql(least: float = 0.98) -> str:
    """DuckDB SQL that compares all pairs of a label and walks the links."""
    return f"""
WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
tops AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS top FROM fine),
ok AS (SELECT vec_id, label, list_transform(v, lambda x: x / top) AS v FROM tops),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {least}),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM reach r JOIN pairs p ON p.a = r.id WHERE p.b > r.c),
low AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT e.vec_id, CAST((SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN low ON low.id = e.vec_id"""
