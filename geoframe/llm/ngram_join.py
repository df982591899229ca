"""N-gram Jaccard join by grouped prefix join.

Documents link when the Jaccard similarity of their sets of word shingles reaches a threshold.  If a global order of the shingles is
fixed, two linked documents share a shingle among the first n - ceil(t * n) + 1 of each, its prefix.  The order here is: shingles
not known to be frequent, then frequent ones by how frequent they are (in powers of two), each by hash, so that prefixes avoid shared passages.
What is frequent is counted over all texts, and only guides the order: links are exact whatever is in that list, so it may be bounded.

Documents with equal sets are one node; nodes with equal prefixes and sizes are one group.  The prefixes of the groups are
joined on their shingles; pairs of groups are filtered by size, by the place of the shared shingle in either prefix, and by how much
the whole prefixes share; what is left is expanded to pairs of members, and these are verified on their whole sets.

What would make many pairs makes a job instead: the groups of a shingle that more than SMALL hold (those known to be HOT go there at once, so that
no task has to count them), the nodes of one large group, two groups that make more than PAIRS pairs of members.  A job's nodes are dealt to blocks of bounded
weight by size class and hash; only blocks of classes that can link are compared, as matrices, and a pair of blocks returns a spanning part of its
links.  A job of many blocks is compared in two steps: first each node with one block of each class.  Nodes that then are in the job's commonest
component need no comparison with each other any more, so only the others are compared with all: near copies of one text cost work in proportion to
their number.  Components of the links are the classes.

Sets are of 64-bit hashes of shingles: two sets of 10,000 that are compared have a false match with odds of 5e-12. Nodes and groups are told
by 64 bits, and second hashes of as many tell if that was not enough: then all is done again under other hashes.

Defined results: a null or empty text, or one of white space only, has no shingles and links with nothing; with fewer words than a
shingle the whole sequence is one; repeated rows are equal sets; two texts under one id are two nodes; an empty
table gives an empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import delete_written, release, sliced, text_batches, written
from geoframe.operators.components import components
from geoframe.llm.shingles import forget, shingles

#: Groups of a shingle that still make pairs, pairs of members that two groups may make, rows of a block, shingles counted at a time, repeats that
#: are told among them, how often a shingle must be told to be frequent, and how many such are kept (5 MB of them). Counted are the upper halves of
#: the hashes. HOT: the power of two of its count from which on a shingle makes a job at once.
SMALL, PAIRS, BLOCK, COUNTED, TOLD, FREQUENT, MOST_FREQUENT, HOT = 64, 4096, 768, 3_000_000, 2, 4, 1 << 20, 13
#: Shingles that a row of a block counts for at least: blocks hold BLOCK rows of so many, or fewer longer ones.
TYPICAL = 512
#: Bits of the map that tells a scan which rows may be wanted; more wanted rows let more others through, and nothing else.
BITS = 1 << 26
#: Bits that tell nodes and groups, in one attempt after another.
TOLD_BY = (64, 64, 64, 64)
#: What names a job: its kind (a shingle's groups, a group's nodes, two groups) and one or two numbers.
JOB = ["kind", "ja", "jb"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _half(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def frequent(df: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles told to be frequent, sorted, and the power of two of their count. Each task counts COUNTED shingles of different
    texts at a time and tells those that repeat."""

    def count(batches):
        held, size, seen = [], 0, set()

        def flush():
            x = np.concatenate(held)
            x.sort()
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            n = np.diff(np.r_[start, len(x)])
            often = n >= TOLD
            return pa.RecordBatch.from_arrays([pa.array(x[start[often]].astype(np.int64)), pa.array(n[often])], names=["token", "n"])

        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                x = shingles(text, width)
                key = xxhash.xxh3_64_intdigest(x)
                if len(x) and key not in seen:
                    seen.add(key)
                    held.append(_half(x))
                    size += len(x)
                if size >= COUNTED:
                    yield flush()
                    held, size, seen = [], 0, set()
        if held:
            yield flush()
        forget()
        held = None
        release()

    told = text_batches(df.select(text_col)).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = told.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    tokens = most["token"].to_numpy(np.int64).astype(np.uint32)
    order = np.argsort(tokens)
    return tokens[order], np.log2(np.maximum(1, most["n"].to_numpy(np.float64)[order])).astype(np.uint8)


def prefix(x: np.ndarray, known: np.ndarray, power: np.ndarray, percent: int, hot: int) -> tuple[np.ndarray, int]:
    """The first n - ceil(percent * n / 100) + 1 of the sorted shingles x in the global order, and how many of them come before those known to be hot."""
    n = len(x)
    size = n - -(-percent * n // 100) + 1
    if len(known):
        half = _half(x)
        at = np.minimum(np.searchsorted(known, half), len(known) - 1)
        rank = np.where(known[at] == half, power[at], 0)
        if rank.any():
            order = np.argsort(rank, kind="stable")[:size]
            return x[order], int(np.searchsorted(rank[order], hot))
    return x[:size], min(size, n)


def prepared(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, known: np.ndarray, power: np.ndarray, attempt: int = 0) -> DataFrame:
    """For each row of df: id, n (size of the set), node (of equal sets), grp (of equal prefixes and sizes), their second hashes node2 and grp2,
    prefix, and cold, how many of the prefix come before those known to be hot."""
    id_type = df.schema[id_col].dataType.simpleString()
    gone, hot = np.uint64(64 - TOLD_BY[attempt]), HOT

    def run(batches):
        for b in sliced(batches):
            n, node, grp, node2, grp2, pre, cold = ([] for _ in range(7))
            for text in b.column(1).to_pylist():
                x = shingles(text, width)
                p, before = prefix(x, known, power, percent, hot) if len(x) else (x, 0)
                whole, part = x.tobytes(), p.tobytes() + len(x).to_bytes(8, "little")
                n.append(len(x))
                node.append(xxhash.xxh3_64_intdigest(whole, 4 * attempt + 1))
                grp.append(xxhash.xxh3_64_intdigest(part, 4 * attempt + 2))
                node2.append(xxhash.xxh3_64_intdigest(whole, 4 * attempt + 3))
                grp2.append(xxhash.xxh3_64_intdigest(part, 4 * attempt + 4))
                pre.append(p.view(np.int64))
                cold.append(before)
            told = [np.array(node, np.uint64) >> gone, np.array(grp, np.uint64) >> gone, np.array(node2, np.uint64), np.array(grp2, np.uint64)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), *map(_signed, told), pa.array(cold, pa.int32()), pa.array(pre, pa.list_(pa.int64()))],
                names=["id", "n", "node", "grp", "node2", "grp2", "cold", "prefix"],
            )
        forget()
        release()

    rows = text_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"id {id_type}, n int, node long, grp long, node2 long, grp2 long, cold int, prefix array<long>")


def _may(n1, p1, n2, p2, percent: int):
    """Whether a pair can link if its first shared shingle has places p1, p2 in sets of n1, n2."""
    ahead = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * ahead >= percent * (n1 + n2))


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """From (token, item, n, p, hot): pairs (a, b) of items that share a token in at most SMALL items, and for the others, the items with
    the token: (b null, a, token, n, p). Rows of one token stream by; no more than SMALL are held. Those of hot tokens are such at once, wherever they are."""
    names = ["a", "b", "token", "n", "p"]

    def rows(a, b, token, n, p) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        other = [pa.array(x, t) if x is not None else pa.nulls(len(a), t) for x, t in ((token, pa.int64()), (n, pa.int32()), (p, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), *other], names=names)

    def run(batches):
        tail, large = None, None  # rows of the last token so far; the token if it is known to be large
        for b in batches:
            cols, hot = [np.asarray(c) for c in b.columns[:4]], np.asarray(b.column(4).to_numpy(zero_copy_only=False), bool)
            if hot.any():
                t, i, n, p = (c[hot] for c in cols)
                yield rows(i, None, t, n, p)
                cols = [c[~hot] for c in cols]
            if not len(cols[0]):
                continue
            if large is not None:
                same = int(np.searchsorted(cols[0] != large, True)) if (cols[0] != large).any() else len(cols[0])
                if same:
                    t, i, n, p = (c[:same] for c in cols)
                    yield rows(i, None, t, n, p)
                    cols = [c[same:] for c in cols]
                if not len(cols[0]):
                    continue
                large = None
            if tail is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(tail, cols, strict=True)]
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            ends = np.r_[starts[1:], len(cols[0])]
            last = slice(starts[-1], ends[-1])
            tail = [c[last] for c in cols]
            yield from closed(cols, starts[:-1], ends[:-1])
            if len(tail[0]) > SMALL:
                t, i, n, p = tail
                large = int(t[0])
                yield rows(i, None, t, n, p)
                tail = None
        if tail is not None:
            yield from closed(tail, np.array([0]), np.array([len(tail[0])]))

    def closed(cols, starts, ends):
        t, i, n, p = cols
        length = ends - starts
        for s, e in zip(starts[length > SMALL].tolist(), ends[length > SMALL].tolist(), strict=True):
            yield rows(i[s:e], None, t[s:e], n[s:e], p[s:e])
        for size in np.unique(length[(length > 1) & (length <= SMALL)]).tolist():
            x, y = np.triu_indices(size, 1)
            first = starts[length == size]
            for s in range(0, len(first), max(1, 200_000 // len(x))):
                at = first[s : s + max(1, 200_000 // len(x))][:, None]
                u, v = (at + x).ravel(), (at + y).ravel()
                ok = _may(n[u].astype(np.int64), p[u], n[v].astype(np.int64), p[v], percent) & (i[u] != i[v])
                u, v = i[u[ok]], i[v[ok]]
                if len(u):
                    both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
                    yield rows(both[:, 0], both[:, 1], None, None, None)

    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("item"), F.lit(1 << 16))).otherwise(0)
    dealt = postings.select("token", "item", "n", "p", "hot").repartition("token", spread).sortWithinPartitions("hot", "token")
    return dealt.mapInArrow(run, "a long, b long, token long, n int, p int")


def dealt_to_blocks(members: DataFrame, percent: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of JOB, u, v, block, a, n, p: each node (kind, ja, jb, side, open, a, n, p) with every pair of blocks that it is compared in. Sides 1 and 2
    are compared with each other, side 0 with itself. first: only with part 0 of each class; else only pairs of which one is open. Beside them, the jobs
    of which a class has several parts."""
    # A little wider than what can link, so that rounding cannot put two that link more than one class apart.
    width = float(np.log(100 / percent)) * 1.0001
    rows = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    key = [*JOB, "side", "open", "class"]
    parts = rows.groupBy(*key).agg(F.count("*").alias("k"), F.greatest(F.lit(1), F.ceil(F.sum(F.greatest(F.col("n"), F.lit(TYPICAL))) / (BLOCK * TYPICAL))).cast("int").alias("parts"))
    parts = written(parts, "join-parts")
    # A line for each class of a job: with its neighbours they say which blocks meet.
    other = parts.select(*JOB, *(F.col(c).alias(f"{c}2") for c in ("side", "open", "class", "parts", "k")))
    meets = (F.abs(F.col("class") - F.col("class2")) <= 1) & ((F.col("side") + F.col("side2")).isin(0, 3))
    own = (F.col("side") == F.col("side2")) & (F.col("open") == F.col("open2")) & (F.col("class") == F.col("class2"))
    meets = meets & (~own | (F.col("k") > 1))
    if not first:
        meets = meets & (F.col("open") | F.col("open2"))
    met = parts.join(other, JOB).where(meets).groupBy(*key, "parts").agg(F.collect_list(F.struct("side2", "open2", "class2", "parts2")).alias("others"))

    def number(side: Column, is_open: Column, size: Column, part: Column) -> Column:
        return ((side.cast("long") * 2 + is_open.cast("long")) * 1024 + size) * F.lit(1 << 40) + part

    placed = rows.join(met, key).withColumn("part", F.pmod(F.xxhash64("a", *JOB), F.col("parts")).cast("long"))
    placed = placed.withColumn("block", number(F.col("side"), F.col("open"), F.col("class"), F.col("part"))).withColumn("o", F.explode("others"))
    last = F.col("o.parts2").cast("long") - 1
    along = F.sequence(F.lit(0).cast("long"), F.when((F.col("part") > 0) & F.lit(first), F.lit(0).cast("long")).otherwise(last))
    placed = placed.withColumn("block2", F.explode(F.transform(along, lambda j: number(F.col("o.side2"), F.col("o.open2"), F.col("o.class2"), j))))
    placed = placed.select(*JOB, F.least("block", "block2").alias("u"), F.greatest("block", "block2").alias("v"), "block", "a", "n", "p")
    return placed, parts.where("parts > 1").select(*JOB).distinct()


def block_links(dealt: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning links of the pairs of blocks of dealt_to_blocks(), as matrices; sets_of: node, x."""

    def compare(key, frame):
        import pandas as pd

        frame = frame.sort_values("a", kind="stable").drop_duplicates("a")
        n, p, node = frame["n"].to_numpy(np.int64), frame["p"].to_numpy(np.int64), frame["a"].to_numpy()
        left = (frame["block"] == key[-2]).to_numpy()
        one = key[-2] == key[-1]
        r, c = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(r) or not len(c):
            return empty
        may = _may(n[r][:, None], p[r][:, None], n[c][None], p[c][None], percent)
        if not may.any():
            return empty
        flat = np.concatenate(frame["x"].tolist())
        owner = np.repeat(np.arange(len(n)), n)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.zeros((len(r), len(c)), np.float32)
        row_of, col_of = np.full(len(n), -1), np.full(len(n), -1)
        row_of[r], col_of[c] = np.arange(len(r)), np.arange(len(c))
        often = np.flatnonzero(count > 1)
        place = np.full(len(count), -1)
        for s in range(0, len(often), 4096):
            place[:] = -1
            place[often[s : s + 4096]] = np.arange(len(often[s : s + 4096]))
            k = place[token]
            inside = k >= 0
            sides = []
            for of in (row_of, col_of):
                take = inside & (of[owner] >= 0)
                m = np.zeros((of.max() + 1, min(4096, len(often) - s)), np.float32)
                m[of[owner[take]], k[take]] = 1
                sides.append(m)
            shared += sides[0] @ sides[1].T
        link = may & (100 * shared >= percent * (n[r][:, None] + n[c][None] - shared))
        i, j = np.nonzero(link)
        i, j = r[i], c[j]
        i, j = i[i != j], j[i != j]
        label = np.arange(len(n))  # nodes are sorted: the smallest place is the smallest node
        while len(i):
            new = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == label).all():
                break
            label = new
        touched = np.flatnonzero(label != np.arange(len(n)))
        return pd.DataFrame({"a": node[touched], "b": node[label[touched]]})

    rows = dealt.join(sets_of.select(F.col("node").alias("a"), "x"), "a")
    return rows.groupBy(*JOB, "u", "v").applyInPandas(compare, "a long, b long")


def job_links(members: DataFrame, sets_of: DataFrame, pair_links: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components are those of pair_links and of all links inside the jobs of members."""
    dealt, large = dealt_to_blocks(members.withColumn("open", F.lit(True)), percent, True)
    links = written(pair_links.unionByName(block_links(dealt, sets_of, percent)), "join-links")
    if large.isEmpty():
        return links
    # In jobs of several parts only nodes outside of the commonest component are open.
    found = components(links)
    some = members.join(large, JOB, "left_semi").join(found.select(F.col("id").alias("a"), "component"), "a", "left")
    some = written(some, "join-large-members")
    common = some.where("component IS NOT NULL").groupBy(*JOB, "component").agg(F.count("*").alias("k")).groupBy(*JOB).agg(F.max_by("component", F.struct("k", "component")).alias("common"))
    some = some.join(common, JOB, "left").withColumn("open", ~F.coalesce(F.col("component") == F.col("common"), F.lit(False))).drop("component", "common")
    more = block_links(dealt_to_blocks(some, percent, False)[0], sets_of, percent)
    return written(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "join-links")


def wanted_test(key: str, wanted: DataFrame):
    """A column, and a function of its values that tells the rows whose key is in wanted, and some others, without a shuffle: by a map of
    BITS bits, made on the executors, of which at most BITS / 64 numbers come together, however many keys are wanted."""
    spot = F.pmod(F.xxhash64(key), F.lit(BITS))
    words = wanted.select(spot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")).toPandas()
    bits = np.zeros(BITS // 64 if len(words) else 1, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    bits, size = bits.view(np.uint8), BITS if len(words) else 64

    def test(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy() % size
        return pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return spot, test


def let_through(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in wanted, and some others (see wanted_test)."""
    (spot, test), names = wanted_test(key, wanted), rows.columns

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(test(b.column(b.num_columns - 1)))

    return rows.withColumn("__spot", spot).mapInArrow(run, rows.schema)


def linked(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, n, node (of equal sets), root (of a class) and low (the smallest id of the class), a row for each row of df; root is null without shingles."""
    known, power = frequent(df, text_col, width)
    for attempt in range(len(TOLD_BY)):
        rows = written(prepared(df, id_col, text_col, width, percent, known, power, attempt), "join-rows")
        full = rows.where("n > 0")
        nodes = full.groupBy("node").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.min("id").alias("id"), F.min("grp2").alias("grp2"), (F.min("node2") == F.max("node2")).alias("sure"))
        nodes = written(nodes, "join-nodes")
        sizes = written(nodes.groupBy("grp").agg(F.count("*").alias("k"), (F.min("grp2") == F.max("grp2")).alias("sure")).where("k > 1 OR NOT sure"), "join-sizes")
        if nodes.where("NOT sure").isEmpty() and sizes.where("NOT sure").isEmpty():
            break
        delete_written(rows, nodes, sizes)
    else:
        raise RuntimeError("sets could not be told apart by their hashes")
    groups = full.groupBy("grp").agg(F.first("n").alias("n"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix"))
    postings = groups.select("grp", "n", "cold", F.posexplode("prefix").alias("p", "token")).select("token", F.col("grp").alias("item"), "n", "p", (F.col("p") >= F.col("cold")).alias("hot"))
    met = written(candidates(postings, percent), "join-met")
    # Groups of several nodes are met inside, too: there the whole prefix is shared.
    several = nodes.join(sizes, "grp").select(F.col("grp").alias("token"), F.col("node").alias("item"), "n", F.lit(0).alias("p"), (F.col("k") > SMALL).alias("hot"))
    inside = written(candidates(several, percent), "join-inside")
    # x has at most n - alpha shingles that y has not. If x's prefix ends first, the others in it are all in y's prefix.
    close = written(met.where("b IS NOT NULL").select("a", "b").distinct(), "join-met-pairs")
    some = let_through(full.select("grp", "n", "prefix"), "grp", close.select(F.explode(F.array("a", "b")).alias("grp")))
    some = some.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    ends = [some.select(F.col("grp").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab"]
    close = close.join(ends[0], "a").join(ends[1], "b")
    close = close.withColumn("alpha", F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)))
    least = F.least(F.size("pa") - F.col("na"), F.size("pb") - F.col("nb")) + F.col("alpha")
    close = close.where(F.size(F.array_intersect("pa", "pb")) >= least).select("a", "b")
    for c in "ab":
        close = close.join(sizes.select(F.col("grp").alias(c), F.col("k").alias(f"k{c}")), c, "left")
    close = written(close.select("a", "b", (F.coalesce("ka", F.lit(1)) * F.coalesce("kb", F.lit(1)) <= PAIRS).alias("few")), "join-close")
    left, right = nodes.select(F.col("grp").alias("a"), F.col("node").alias("x")), nodes.select(F.col("grp").alias("b"), F.col("node").alias("y"))
    pairs = close.where("few").join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = written(pairs.unionByName(inside.where("b IS NOT NULL").select("a", "b")).distinct(), "join-pairs")

    def job(rows: DataFrame, kind: int, ja: str, jb: str | None = None, side: int = 0) -> DataFrame:
        second = F.col(jb) if jb else F.lit(0).cast("long")
        return rows.select(F.lit(kind).alias("kind"), F.col(ja).alias("ja"), second.alias("jb"), F.lit(side).alias("side"), "node", "n", "p")

    shared = met.where("b IS NULL").select("token", F.col("a").alias("grp"), "p").join(nodes.select("grp", "node", "n"), "grp")
    many = close.where("NOT few")
    members = job(shared, 0, "token").unionByName(job(inside.where("b IS NULL").withColumnRenamed("a", "node"), 1, "token"))
    for i, c in enumerate("ab"):
        members = members.unionByName(job(many.join(nodes.select(F.col("grp").alias(c), "node", "n"), c).withColumn("p", F.lit(0)), 2, "a", "b", i + 1))
    members = written(members.withColumnRenamed("node", "a"), "join-large")
    # A hot shingle of one node has nothing to compare.
    alone = members.groupBy(*JOB).agg(F.count("*").alias("k")).where("k > 1").select(*JOB)
    large, members = members, written(members.join(alone, JOB, "left_semi"), "join-members")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select(F.col("a").alias("node"))).distinct()
    needed = written(needed.join(nodes.select("node", "id"), "node").select("node", "id"), "join-needed")

    spot, test = wanted_test("id", needed)
    gone, seed = np.uint64(64 - TOLD_BY[attempt]), 4 * attempt + 1

    def sets(batches):
        for b in sliced(batches):
            found = [shingles(t, width) for t in b.filter(test(b.column(1))).column(0).to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in found], np.uint64) >> gone
            yield pa.RecordBatch.from_arrays([_signed(node), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["node", "x"])
        forget()
        release()

    # One text for each node: the row of its smallest id (other rows that the map lets through go again).
    texts = text_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("text", spot.alias("spot")))
    sets_of = written(texts.mapInArrow(sets, "node long, x array<long>").join(needed, "node", "left_semi"), "join-sets")
    near = pairs.join(sets_of.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets_of.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    near = near.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), F.size(F.array_intersect("xa", "xb")).alias("k"))
    links = near.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")
    found = components(job_links(members, sets_of, links, percent))
    delete_written(met, inside, close, pairs, large, members, needed, sets_of)
    root = nodes.select("node", "id").join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "id", F.coalesce("component", "node").alias("root"))
    root = written(root, "join-roots")
    low = root.groupBy("root").agg(F.min("id").alias("low"))
    out = full.select("id", "n", "node").join(root.select("node", "root").join(low, "root"), "node", "left").select("id", "n", "node", "root", "low")
    out = out.unionByName(rows.where("n = 0").select("id", "n", "node", F.lit(None).cast("long").alias("root"), F.col("id").alias("low")))
    out.__dict__["attempt"] = attempt
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id in reach), a row for each row of df."""
    out = linked(df, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("low").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each class: that of the smallest id. Rows without shingles are no copies of anything and all stay; of
    rows of one class under its smallest id (repeated rows, say) one stays."""
    found = linked(df, id_col, text_col, width, percent)
    told, attempt = written(found, "join-told"), found.__dict__["attempt"]
    stays = F.col("root").isNull() | F.col("id").eqNullSafe(F.col("low"))
    per = told.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__rows"), F.max(stays.cast("int")).alias("__stays"))
    out = df.join(per.where("__rows > 1 OR __stays = 0"), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    plain = out.where("__rows IS NULL").select(*df.columns)
    if per.where("__rows > 1").isEmpty():
        return plain
    # Several rows under one id: which class a row is of has to be told by its set.
    gone, seed = np.uint64(64 - TOLD_BY[attempt]), 4 * attempt + 1
    again = out.where("__rows > 1").select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"))

    def sets(batches):
        for b in batches:
            node = np.array([xxhash.xxh3_64_intdigest(shingles(t, width).tobytes(), seed) for t in b.column(1).to_pylist()], np.uint64) >> gone
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(node)], names=["row", "mark"])

    marked = again.mapInArrow(sets, f"row {again.schema['row'].dataType.simpleString()}, mark long")
    right = told.where(stays).select("id", F.col("node").alias("same"), "root").distinct()
    held = marked.join(right, F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("same")))
    one = held.where("root IS NOT NULL").dropDuplicates(["id", "root"]).unionByName(held.where("root IS NULL"))
    return plain.unionByName(one.select("row.*"))


def oracle_sql(width: int = 5, percent: int = 80) -> str:
    """DuckDB SQL that counts shared shingles of all pairs that share one, and walks the links."""
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS x FROM docs),
unified AS (SELECT x, min(r) AS u, len(x) AS n FROM sets GROUP BY x),
tokens AS (SELECT u, n, unnest(x) AS s FROM unified),
shared AS (SELECT a.u AS a, b.u AS b, a.n AS na, b.n AS nb, count(*) AS k FROM tokens a JOIN tokens b ON a.s = b.s AND a.u < b.u GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= {percent} * (na + nb - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT u, u FROM unified UNION SELECT r.u, b.b FROM reach r JOIN ways b ON b.a = r.v),
of AS (SELECT s.doc_id, u.u, len(s.x) AS n FROM sets s JOIN unified u ON u.x = s.x),
low AS (SELECT reach.u, min(of.doc_id) AS low FROM reach JOIN of ON of.u = reach.v GROUP BY reach.u)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE low END AS component_id FROM of JOIN low USING (u)"""
