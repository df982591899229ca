"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is put into a random but repeatable order and cut into blocks of BLOCK rows.  Weights are whole numbers w that add up to W.  A
source's block number j (from 0) is released at slot floor(j*W/w) and due by slot ceil((j+1)*W/w); each slot goes to the released block that
is due first (ties: the source that sorts first).  On one processor this order meets every deadline, so before a source runs out, at any
slot, it is less than one block away from its weight's share of the slots so far.  A source that has run out leaves its slots empty; the
others go on in the ratio of their weights, and no row is dropped or repeated.

Weights given as numbers are taken to six decimals, exactly.  Slots are scheduled as far as the stream goes, or as far as they repeat, which
they do after W slots (less, if the weights have a common divisor).  Should both be more than SLOTS, the weights are rounded to whole slots of
SLOTS (largest remainders after one each), which then repeat: the mix is off its target by a block after SLOTS slots at the earliest.

The order inside a source is a rank by hash, made in levels: rows are counted by (source, leading hash digits), counts are added up along
the first half of the digits and then along the rest, and rows are ranked inside such a group only; a hot source is as many groups as it needs.  A
group takes along the slots of its own blocks.

Defined results: a null source is the source ''; weights not given are the square roots of the sources' row counts (a
temperature of 2), to three decimals; where weights are given, sources without one get a thousandth of their sum, as do those with weight 0; repeated
rows get places of their own; an empty table gives an empty table; columns of df named as the new ones are replaced.

The slots are scheduled by one fold, whose work is their number (SLOTS at most) times the sources: it is made for up to some thousands of sources, whatever their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, slots scheduled at most, slots of a chunk of the fold, rows aimed at in a group that is ranked, and the order's seed.
BLOCK, SLOTS, CHUNK, GROUP_ROWS, SEED = 16, 1 << 20, 1024, 2000, "mix-1"
#: Slots' dues and sources' numbers are compared as one number: there are fewer sources than this.
MOST_SOURCES = 1 << 20
NEW = ("mix_block", "mix_slot", "mix_position")


def digits_for(most: int) -> int:
    """Leading hash digits that cut the largest source into groups of about GROUP_ROWS rows."""
    k = 1
    while 16**k * GROUP_ROWS < most:
        k += 1
    return k


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, without a detour by doubles."""
    return F.call_function("div", a, b)


def shares(counts: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, most: int = SLOTS) -> DataFrame:
    """source, n, i (its number), w, total (the sum of all w), slots (how many have to be scheduled). counts: source, n."""
    every = Window.partitionBy()
    if weights is None:
        w = F.floor(F.sqrt(F.col("n").cast("double")) * 1000)
    else:
        given = [x for s, v in weights.items() for x in (F.lit(s), F.lit(int(round(v * 1_000_000))))]
        w = F.coalesce(F.create_map(*given)[F.col("source")], F.lit(0)) if given else F.lit(0)
    rows = counts.withColumn("w", w.cast("long")).withColumn("sum_w", F.sum("w").over(every))
    rows = rows.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.greatest(F.lit(1), _div(F.col("sum_w"), F.lit(1000)))))
    common = F.reduce(F.collect_list("w").over(every), F.lit(0).cast("long"), _divisor)
    rows = rows.withColumn("common", common).withColumn("w", _div(F.col("w"), F.col("common"))).withColumn("total", F.sum("w").over(every))
    blocks = F.ceil(F.col("n") / block)
    # Up to the slot by which the last block of all is due, or up to where all begins anew.
    last = F.max(F.ceil(blocks.cast("double") * F.col("total") / F.col("w")) + 1).over(every)
    rows = rows.withColumn("slots", F.least(F.col("total"), last)).withColumn("s", F.count("*").over(every))
    # Too many: whole slots of `most`.
    rows = rows.withColumn("part", F.expr(f"decimal({most} - s) * w")).withColumn("base", 1 + F.expr("part div total")).withColumn("rest", F.expr("part % total"))
    rows = rows.withColumn("left", most - F.sum("base").over(every)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), "source")))
    many = F.col("slots") > most
    w, total, slots = F.when(many, F.col("base") + (F.col("place") <= F.col("left")).cast("long")).otherwise(F.col("w")), F.when(many, F.lit(most)).otherwise(F.col("total")), F.when(many, F.lit(most)).otherwise(F.col("slots"))
    return rows.select("source", "n", (F.row_number().over(Window.orderBy("source")) - 1).alias("i"), w.alias("w"), total.cast("long").alias("total"), slots.cast("long").alias("slots"))


def _divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor, by as many steps as numbers of 64 bits can need."""
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.reduce(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def slots(share: DataFrame) -> DataFrame:
    """i, k, slot: the slot of each source's block number k, by earliest deadline first, in one fold over chunks of slots."""
    one = share.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w"), F.max("total").alias("total"), F.max("slots").alias("slots"))
    total, number = F.col("total"), F.lit(MOST_SOURCES)

    def step(state: Column, t: Column) -> Column:
        due = F.transform(F.col("w"), lambda w, i: F.when(_div(state["c"][i] * total, w) <= t, _div((state["c"][i] + 1) * total + w - 1, w) * number + i))
        # An array of one, as what a lambda names is computed once.
        chosen = F.array(F.pmod(F.array_min(due), number))
        given = lambda i: F.transform(state["c"], lambda c, k: c + (k == i).cast("long"))
        return F.get(F.transform(chosen, lambda i: F.struct(given(i).alias("c"), F.concat(state["order"], F.array(i)).alias("order"))), 0)

    def chunk(state: Column, k: Column) -> Column:
        # Chunks keep short what is copied at each slot.
        own = F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, F.col("slots")) - 1)
        told = F.reduce(own, F.struct(state["c"].alias("c"), F.array().cast("array<bigint>").alias("order")), step)
        joined = F.transform(F.array(told), lambda v: F.struct(v["c"].alias("c"), F.concat(state["order"], v["order"]).alias("order")))
        return F.get(joined, 0)

    start = F.struct(F.transform("w", lambda _: F.lit(0).cast("long")).alias("c"), F.array().cast("array<bigint>").alias("order"))
    chunks = F.sequence(F.lit(0).cast("long"), _div(F.col("slots") - 1, F.lit(CHUNK)))
    placed = one.where("size(w) > 0").select(F.posexplode(F.reduce(chunks, start, chunk, lambda s: s["order"])).alias("slot", "i"))
    return placed.select("i", (F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1).cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK, files: int | None = None) -> DataFrame:
    """df with mix_block (number of the row's block in its source), mix_slot (the slot that the block got) and mix_position
    (slot * block + place in the block): the order of the mixed stream. With files, the rows are also dealt into so many
    partitions by position and sorted, so that what is written can be read as the stream."""
    kept = [c for c in df.columns if c not in NEW]
    rows = df.select(*kept, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("__hash"))
    counts = rows.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n"))
    digits = digits_for(counts.agg(F.max("n")).first()[0] or 0)
    rows = rows.withColumn("__group", F.substring("__hash", 1, digits))
    grouped = rows.groupBy(F.col("__source").alias("source"), F.col("__group").alias("group")).agg(F.count("*").alias("n"))
    before = lambda by, along: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = grouped.withColumn("top", F.substring("group", 1, digits // 2))
    tops = grouped.groupBy("source", "top").agg(F.sum("n").alias("n")).select("source", "top", before(["source"], "top").alias("above"))
    starts = grouped.withColumn("own", before(["source", "top"], "group")).join(tops, ["source", "top"])
    starts = starts.select("source", "group", "n", (F.col("above") + F.col("own")).alias("start"))
    share = shares(counts, weights, block)
    # Each group takes along the slots of the blocks it has rows of.
    blocks = starts.join(share.select("source", "i", "w", "total"), "source").withColumn("first", F.floor(F.col("start") / block))
    blocks = blocks.withColumn("j", F.explode(F.sequence("first", F.floor((F.col("start") + F.col("n") - 1) / block)))).withColumn("k", F.col("j") % F.col("w"))
    at = F.struct("j", (_div(F.col("j"), F.col("w")) * F.col("total") + F.col("slot")).alias("slot"))
    given = blocks.join(slots(share), ["i", "k"]).groupBy("source", "group", "start", "first").agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["slot"]).alias("at"))
    plan = given.select(F.col("source").alias("__source"), F.col("group").alias("__group"), "start", "first", "at")
    by = ["__source", "__group"]
    rank = F.col("start") + F.row_number().over(Window.partitionBy(*by).orderBy("__hash", id_col)) - 1
    out = rows.join(plan, by).withColumn("__rank", rank).withColumn("__block", F.floor(F.col("__rank") / block))
    slot = F.get(F.col("at"), (F.col("__block") - F.col("first")).cast("int"))
    out = out.select(*kept, F.col("__block").alias("mix_block"), slot.alias("mix_slot"), (slot * block + F.col("__rank") % block).alias("mix_position"))
    return out.repartitionByRange(files, "mix_position").sortWithinPartitions("mix_position") if files else out


def oracle_sql(block: int = BLOCK) -> str:
    """DuckDB SQL for mix(documents) with the weights that are not given, as far as SLOTS goes."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counts AS (SELECT source, count(*) AS n, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS w, row_number() OVER (ORDER BY source) AS i FROM docs GROUP BY source),
one AS (SELECT list(w ORDER BY i) AS w, CAST(sum(w) AS BIGINT) AS t, CAST(sum((n + {block - 1}) // {block}) AS BIGINT) AS blocks FROM counts),
most AS (SELECT max(((n + {block - 1}) // {block}) * t // w) + 2 AS last FROM (SELECT n, counts.w, t FROM counts, one)),
edf(slot, c, chosen) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM one
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(c) + 1), lambda i: c[i] + CAST(i = k AS BIGINT)), k FROM (
    SELECT slot, c, list_min(list_transform(range(1, len(c) + 1), lambda i:
      CASE WHEN (c[i] * t) // w[i] <= slot + 1 THEN (((c[i] + 1) * t + w[i] - 1) // w[i]) * {MOST_SOURCES} + i END)) % {MOST_SOURCES} AS k
    FROM edf, one, most WHERE slot < last)),
spots AS (SELECT chosen AS i, slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS j FROM edf WHERE slot >= 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS r FROM docs)
SELECT doc_id, ranked.source, CAST(r // {block} AS BIGINT) AS mix_block, slot AS mix_slot, CAST(slot * {block} + r % {block} AS BIGINT) AS mix_position
FROM ranked JOIN counts USING (source) JOIN spots ON spots.i = counts.i AND spots.j = r // {block}"""
