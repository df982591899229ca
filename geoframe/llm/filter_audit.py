"""How filters interact: which rows each of several filters removes, for every order of applying them.

One pass over the texts tells for each row which filters it fails.  It goes over the Arrow buffers as they are: a table of 256 entries
turns bytes into classes, prefix sums of the classes at the rows' borders give code points, words, capitals and symbols of all
rows of a slice at once, and the words are hashed eight bytes at a time (a word of up to eight bytes is its own hash).  Sorted by
row and hash, neighbours that agree are compared as bytes; a row where hashes agree and words do not is counted anew by its words.

The mask of failed filters is all that counts from there on: rows are counted by part and mask, and what an order of filters
does is the same for all rows of a mask.

The filters (words are runs of anything but ASCII white space, told apart by case):
A: fewer than 200 words; B: fewer than half of the words are distinct; C: more than 3 capitals A-Z among 100 code points;
D: any of #$%&*|; E: the same text as a row of a smaller doc_id, whether that one is removed or not.

Counts by part, order and step: kept (rows left after this step), removed (here), redundant (fail this filter, but were removed before),
unique_fails (fail this filter alone), good_lost and toxic_lost (removed here with label quality 1, or toxic 1), shapley (rows removed by
this filter, whatever the step, added up over all orders: a row failing k filters is removed by each of them in one k-th of the orders).

Defined results: a null text is an empty one, which fails A only (and E, if not the first), a null part is the part ''; a null doc_id has no label, is smaller than none
and has none smaller; rows of one doc_id are rows of their own, neither the first of the other; of several labels of an id each counts that says 1;
an empty table gives an empty table; further columns are ignored.  Texts of any length are scanned in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm.common import sliced, text_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes scanned at a time, and words of more bytes than these are hashed one by one.
PIECE, LONG = 1 << 21, 64
_SPACE, _CAPITAL, _SYMBOL = (np.isin(np.arange(256), list(c)) for c in (b"\x20\x09\x0a\x0b\x0c\x0d", range(65, 91), b"#$%&*|"))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, words, capitals and symbols of each row (a column each), and its number of distinct words. data: UTF-8 bytes; the rows'
    borders are at offsets, from 0 to its length."""
    rows = len(offsets) - 1
    totals, distinct = np.zeros((rows, 4), np.int64), np.zeros(rows, np.int64)
    at = 0
    while at < rows:
        # As many rows as fit a piece, or one row that may be larger.
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        piece, borders = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(piece) <= PIECE:
            totals[at:to], distinct[at:to] = _scanned(piece, borders)
        else:
            totals[at], distinct[at] = _long_row(piece)
        at = to
    return totals, distinct


def _classes(data: np.ndarray, borders: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of prefix sums at the rows' borders."""
    out = np.empty((len(borders) - 1, 4), np.int64)
    for k, hits in enumerate((_LEAD[data], starts, _CAPITAL[data], _SYMBOL[data])):
        out[:, k] = np.diff(np.concatenate(([0], np.cumsum(hits, dtype=np.int64)))[borders])
    return out


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a word starts at each byte, and where words start and end. A row's border ends a word."""
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    inner = borders[(borders > 0) & (borders < len(data))]
    before[inner] = True
    first = ~space & before
    after = np.concatenate((space[1:], [True])) if len(data) else space
    after[inner - 1] = True
    return first, np.flatnonzero(first), np.flatnonzero(~space & after) + 1


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; the data has eight bytes of padding."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _eight(loads: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes of words as numbers; left: bytes that a word still has."""
    keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
    return loads[starts] & np.where(keep == 64, ~np.uint64(0), (np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1))


def _hashed(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    loads, sizes = _loads(padded), ends - starts
    out = _eight(loads, starts, sizes)
    more = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    for k in range(8, LONG, 8):
        if not len(more):
            break
        out[more] = (out[more] ^ (out[more] >> np.uint64(29))) * _MIX[0] + _eight(loads, starts[more] + k, sizes[more] - k) * _MIX[1]
        more = more[sizes[more] > k + 8]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def _same(padded: np.ndarray, s: np.ndarray, t: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether words at s and at t, of the given sizes, are the same bytes."""
    loads, same = _loads(padded), sizes == other
    open_ = np.flatnonzero(same & (sizes <= LONG))
    for k in range(0, LONG, 8):
        if not len(open_):
            break
        same[open_] = _eight(loads, s[open_] + k, sizes[open_] - k) == _eight(loads, t[open_] + k, sizes[open_] - k)
        open_ = open_[same[open_] & (sizes[open_] > k + 8)]
    for i in np.flatnonzero(same & (sizes > LONG)).tolist():
        same[i] = bytes(padded[s[i] : s[i] + sizes[i]]) == bytes(padded[t[i] : t[i] + sizes[i]])
    return same


def _scanned(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, starts, ends = _words(data, borders)
    totals = _classes(data, borders, first)
    words = totals[:, 1]
    if not len(starts):
        return totals, np.zeros(len(words), np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    hashes, row = _hashed(padded, starts, ends), np.repeat(np.arange(len(words)), words)
    order = np.lexsort((hashes, row))
    hashes, row, starts, sizes = hashes[order], row[order], starts[order], (ends - starts)[order]
    alike = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
    same = _same(padded, starts[alike], starts[alike + 1], sizes[alike], sizes[alike + 1])
    distinct = words - np.bincount(row[alike], minlength=len(words))
    for r in np.unique(row[alike[~same]]).tolist():  # hashes of different words agree
        distinct[r] = len(set(bytes(data[borders[r] : borders[r + 1]]).split()))
    return totals, distinct


def _long_row(data: np.ndarray) -> tuple[np.ndarray, int]:
    """One row in pieces, cut where white space is; its distinct words are kept as bytes."""
    totals, seen, at = np.zeros(4, np.int64), set(), 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):  # on to the next white space, however far
            found = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(data), end + PIECE)
        piece = data[at:end]
        first, _, _ = _words(piece, np.array([0, len(piece)]))
        totals += _classes(piece, np.array([0, len(piece)]), first)[0]
        seen.update(bytes(piece).split())
        at = end
    return totals, len(seen)


def masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """doc_id, part, failed (bits of A to D), same (digest of the text) of each row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text = b.column(2)
            wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
            borders = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            held = text.buffers()[2]
            data = np.frombuffer(held, np.uint8)[borders[0] : borders[-1]] if held is not None else np.zeros(0, np.uint8)
            borders = borders - borders[0]
            totals, distinct = counts(data, borders)
            points, words, capitals, symbols = totals.T
            failed = (words < 200) + 2 * (100 * distinct < 50 * words) + 4 * (100 * capitals > 3 * points) + 8 * (symbols > 0)
            view = memoryview(data)
            same = [hashlib.sha256(view[s:e]).digest() for s, e in zip(borders.tolist(), borders.tolist()[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(failed.astype(np.int32)), pa.array(same, pa.binary())], names=["doc_id", "part", "failed", "same"])

    none = F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), none).alias("part"), F.coalesce("text", none).alias("text"))
    return text_batches(rows).mapInArrow(run, "doc_id long, part string, failed int, same binary")


def counted(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), n, good, toxic: rows by part and mask, and those with label quality 1 and toxic 1."""
    told = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = scanned.join(told, "doc_id", "left").select("doc_id", "part", "failed", "same", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # Rows of one text, part and labels, first by id and then in all: what is left of a group of copies is a few rows, whatever its size.
    by = ["same", "part", "failed", "good", "toxic"]
    each = rows.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    groups = each.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    groups = groups.withColumn("first", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    kinds = groups.select("part", "good", "toxic", F.explode(F.array(F.struct("failed", F.col("first").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("first")).alias("n")))).alias("k"))
    return kinds.groupBy("part", "k.failed").agg(F.sum("k.n").alias("n"), *(F.sum(F.col("k.n") * F.col(c)).alias(c) for c in ("good", "toxic")))


def interactions(by_mask: DataFrame, filters: str = FILTERS, orders: list[str] | None = None) -> DataFrame:
    """part, filter_order, step and the counts: a row for each part, order and step. by_mask: part, failed (bit k: filter number k), n, good, toxic."""
    orders = orders or ["".join(p) for p in permutations(filters)]
    bit = F.create_map(*(F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)))
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    each = by_mask.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    fails = lambda s: F.col("failed").bitwiseAND(bit[F.substring("filter_order", s, 1)]) != 0
    each = each.withColumn("out", F.coalesce(F.array_min(F.filter(steps, fails)), F.lit(len(filters) + 1)))
    each = each.withColumn("step", F.explode(steps))
    own = bit[F.substring("filter_order", F.col("step"), 1)]
    here, fail = F.col("out") == F.col("step"), F.col("failed").bitwiseAND(own) != 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    share = F.sum(F.when(fail, F.expr(f"n * {len(orders)} div greatest(bit_count(failed), 1)")))
    return each.groupBy("part", "filter_order", "step").agg(
        total(F.col("out") > F.col("step")).alias("kept"), total(here).alias("removed"), total(fail & (F.col("out") < F.col("step"))).alias("redundant"),
        total(F.col("failed") == own).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), F.coalesce(share, F.lit(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(counted(masks(docs), labels))


def oracle_sql() -> str:
    """DuckDB SQL for audit(documents, labels)."""
    return r"""
WITH docs AS (SELECT row_number() OVER () AS i, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT i, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT docs.i, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) AS b,
    CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS INTEGER) AS c,
    CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d, CAST(coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS e
  FROM docs JOIN words USING (i) LEFT JOIN told ON told.doc_id = docs.doc_id),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.f || q.f || r.f || s.f || t.f AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
kinds AS (SELECT part, a, b, c, d, e, a + b + c + d + e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
steps AS (SELECT k.*, o, s.step, CASE substr(o, s.step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS x
  FROM kinds k, orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
so_far AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY part, a, b, c, d, e, o ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN before + x = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN before = 0 AND x = 1 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN before > 0 AND x = 1 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN x = 1 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN before = 0 AND x = 1 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN before = 0 AND x = 1 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(sum(CASE WHEN before = 0 AND x = 1 THEN n ELSE 0 END)) OVER (PARTITION BY part, substr(o, step, 1)) AS BIGINT) AS shapley
FROM so_far GROUP BY part, o, step"""
