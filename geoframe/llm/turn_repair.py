r"""Repair of the structure of conversations by error-correcting Earley parsing.

The roles of a conversation are parsed by a grammar whose terminals are role initials,

    Chat -> (nothing) | Turns        Turns -> Asked a        Asked -> u | s u | Turns u

with error productions: a row may be deleted, given another role that the grammar wants (rerole), and a message without text may be
inserted.  A chart item is a rule with a dot, and where it began; for each the chart keeps the least (cost, audit), an audit being the
edits' initials in order.  Items of a set are taken by rising (cost, audit), so each is final when it is taken; the completed
item of the start symbol over all rows gives the repair.  As every rule calls another one at its left end only, all items that wait for
a row began at the first one: a chart set is a handful of items, a row costs constant work, and what a set does with a
row depends on differences of costs and the order of audits only, so it is remembered and looked up.

That also cuts a conversation into blocks: a block tells, for each item it may be entered with, the least (cost, audit) of each item
it can be left with, and blocks are joined by adding costs and stringing audits together.

In Spark: rows are dealt by ranges of (conversation, turn) and sorted.  A task repairs the conversations that lie wholly in its range
as they stream by.  The rest (those at the ends of ranges, and longer than a block) are written out with their places: what was said before
is told by a grouping, blocks are parsed apart, one fold over the (short) results of the blocks of each conversation decides, and the
rows are digested in order.  So a conversation that holds a third of all rows is sorted and parsed by many tasks; its fold and its digest, which is
sequential, stream through one.

Faults of a row, the first that holds: blank (no character but ASCII white space), duplicate (an earlier row of the conversation has its
role and text), truncated (its last such character is none of .!?).  Blank and duplicate rows must be deleted; a truncated one that is not costs more.

Defined results: a null conversation, turn, role or text reads as one space (conversations without an id are one, told apart as null); turns that are null come first;
rows of one turn are ordered by role and text, as they are after damage; repeated rows are duplicates; an empty role has no initial, so that it can only be
deleted or given another; initials are told apart by case; conversations of which no row is left have zeros, an empty audit and the digest of
nothing; gaps are 0 where no turn is known; an empty table gives an empty table; further columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import text_batches, written

#: Costs of edits, and what a truncated row costs that is kept.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Start symbol first. Small letters are terminals: initials of roles; the end of a conversation is one, too.
GRAMMAR = (("Start", ("Chat", "end")), ("Chat", ()), ("Chat", ("Turns",)), ("Turns", ("Asked", "a")), ("Asked", ("u",)), ("Asked", ("s", "u")), ("Asked", ("Turns", "u")))
#: Roles that may be given or inserted.
GIVEN = {"u": "user", "a": "assistant"}
#: Rows of a block, and characters of a conversation that a task holds.
BLOCK, HELD = 1024, 8_000_000
#: Of a text that is not blank, and at the end of one that is not truncated.
_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_LAST = re.compile(_ENDED.replace("z", "Z"))

Item = tuple[int, int, int]  # rule, place of the dot, set where it began
Chart = dict[Item, tuple[int, str]]


def _wants(item: Item) -> str | None:
    rule = GRAMMAR[item[0]][1]
    return rule[item[1]] if item[1] < len(rule) else None


def _terminal(symbol: str | None) -> bool:
    return symbol is not None and not symbol[0].isupper()


def _closed(seeds: Iterable[tuple[Item, int, str]], waiting: Chart, at: int, insert: bool = True) -> Chart:
    """The items of a set, each with its least (cost, audit): predicted, completed and (with insert) advanced by insertions from the seeds. at: the set's
    number, if it is the first; waiting: what the first set holds, where items that began there are completed into."""
    done: Chart = {}
    heap = [(cost, audit, item) for item, cost, audit in seeds]
    heapq.heapify(heap)
    while heap:
        cost, audit, item = heapq.heappop(heap)
        if item in done:
            continue
        done[item] = (cost, audit)
        rule, dot, began = item
        symbol = _wants(item)
        if symbol is None:
            for other, (c, a) in list((done if began == at else waiting).items()):
                if _wants(other) == GRAMMAR[rule][0]:
                    heapq.heappush(heap, (c + cost, a + audit, (other[0], other[1] + 1, other[2])))
        elif _terminal(symbol):
            if insert and symbol in GIVEN:
                heapq.heappush(heap, (cost + INSERT, audit + "I", (rule, dot + 1, began)))
        else:
            for r, (name, _) in enumerate(GRAMMAR):
                if name == symbol:
                    heapq.heappush(heap, (0, "", (r, 0, at)))
            for other, (c, a) in list(done.items()):  # completed here before it was wanted
                if other[2] == at and GRAMMAR[other[0]][0] == symbol and _wants(other) is None:
                    heapq.heappush(heap, (c + cost, a + audit, (rule, dot + 1, began)))
    return done


#: The number of any set but the first; all items began in that.
LATER = -1
#: Set 0 without insertions yet: what the start symbol predicts. Items that wait in it do so at no cost.
_FIRST = {item: v for item, v in _closed([((0, 0, 0), 0, "")], {}, 0).items() if v == (0, "")}


def opened() -> Chart:
    """The items of set 0 that wait for a row."""
    return {item: v for item, v in _FIRST.items() if _terminal(_wants(item))}


def scan(kernel: Chart, initial: str, fault: str) -> Chart:
    """The items that wait for the next row: after a row of this initial and fault, read in whatever way. kernel: those that wait for this one."""
    more = TRUNCATED if fault == "truncated" else 0
    seeds = []
    for item, (cost, audit) in _closed([(i, c, a) for i, (c, a) in kernel.items()], _FIRST, LATER).items():
        symbol = _wants(item)
        if not _terminal(symbol):
            continue
        seeds.append((item, cost + DELETE, audit + "D"))
        if fault in ("blank", "duplicate"):
            continue
        rule, dot, began = item
        if symbol == initial:
            seeds.append(((rule, dot + 1, began), cost + more, audit + "K"))
        if symbol in GIVEN:
            seeds.append(((rule, dot + 1, began), cost + more + REROLE, audit + "R"))
    # Insertions come with the next row, or at the end: a set keeps what was reached by rows.
    reached = _closed(seeds, _FIRST, LATER, insert=False)
    return {item: v for item, v in reached.items() if _terminal(_wants(item))}


def finish(kernel: Chart) -> tuple[int, str]:
    """The completed chart's least (cost, audit)."""
    return _closed([(i, c, a) for i, (c, a) in kernel.items()], _FIRST, LATER)[(0, 1, 0)]


@lru_cache(1 << 16)
def _step(kernel: tuple[tuple[Item, int, int], ...], initial: str, fault: str) -> tuple[tuple[Item, int, int, str], ...]:
    """scan() of items with costs less the least one's and audits by their rank: items, costs, whose audit they go on, and with what. No audit of a set begins
    with another one (each ends with its edit of the same row), so audits and what follows them sort as ranks and what follows."""
    marked = {item: (cost, chr(0x10000 + rank)) for item, cost, rank in kernel}
    return tuple((item, cost, ord(audit[0]) - 0x10000, audit[1:]) for item, (cost, audit) in scan(marked, initial, fault).items())


def parsed(kernel: Chart, rows: Iterable[tuple[str, str]]) -> Chart:
    """scan() over rows of (initial, fault)."""
    for initial, fault in rows:
        least = min((c for c, _ in kernel.values()), default=0)
        audits = sorted({a for _, a in kernel.values()})
        rank = {a: k for k, a in enumerate(audits)}
        key = tuple(sorted((item, c - least, rank[a]) for item, (c, a) in kernel.items()))
        kernel = {item: (c + least, audits[k] + more) for item, c, k, more in _step(key, initial, fault)}
    return kernel


#: Items that can wait for a row.
ITEMS = tuple((r, d, 0) for r, (_, symbols) in enumerate(GRAMMAR) for d, symbol in enumerate(symbols) if _terminal(symbol))


def transfer(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """For a block: (number of the item it is entered with, of the item it is left with, cost, audit)."""
    return [(e, ITEMS.index(x), cost, audit) for e, item in enumerate(ITEMS) for x, (cost, audit) in parsed({item: (0, "")}, rows).items()]


def initial_of(role: str) -> str:
    return role[:1]


def fault_of(role: str, text: str, seen: bool) -> str:
    if not _BLANK.search(text):
        return "blank"
    return "duplicate" if seen else "" if _LAST.search(text) else "truncated"


class Tally:
    """Counts of a stretch of rows in order, which can be added up."""

    LEGAL = frozenset(("su", "ua", "au"))

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.first: str | None = None
        self.last = ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.first is None:
            self.first = initial
        elif self.last + initial not in self.LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:  # rows come by turn
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def state(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last

    def join(self, state: tuple) -> None:
        blank, duplicate, truncated, illegal, turns, low, high, first, last = state
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.first is not None and first is not None and self.last + first not in self.LEGAL)
        self.turns += turns - (low is not None and low == self.high)
        if low is not None:
            self.low, self.high = (low if self.low is None else self.low), high
        if first is not None:
            self.first, self.last = (first if self.first is None else self.first), last

    def counts(self) -> tuple[int, ...]:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Repaired:
    """The repaired conversation as it grows, and its digest."""

    def __init__(self) -> None:
        self.last, self.sha, self.empty = "", hashlib.sha256(), True

    def add(self, edits: str, role: str, text: str) -> None:
        """The edits of one row: insertions before it, its own, and those after it."""
        for edit in edits:
            if edit == "D":
                continue
            wanted = GIVEN["a" if self.last == "u" else "u"]
            said = f"{role}:{text}" if edit == "K" else f"{wanted}:{text if edit == 'R' else ''}"
            self.sha.update(said.encode("utf-8", "surrogatepass") if self.empty else b"\n" + said.encode("utf-8", "surrogatepass"))
            self.empty, self.last = False, initial_of(role) if edit == "K" else wanted[0]


def edits_by_row(audit: str, rows: int) -> list[str]:
    """Each row's share of an audit: insertions before it and its edit; the last one's has those after it, too."""
    cut = re.findall("I*[DKR]", audit)
    if cut:
        cut[-1] += audit[sum(map(len, cut)) :]
    return cut or [audit] * (rows > 0)


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of a conversation of (turn, role, text) in order."""
    tally, seen, said = Tally(), set(), []
    for turn, role, text in rows:
        fault = fault_of(role, text, (role, text) in seen)
        seen.add((role, text))
        said.append((initial_of(role), fault))
        tally.add(turn, *said[-1])
    cost, audit = finish(parsed(opened(), said))
    out = Repaired()
    for edits, (_, role, text) in zip(edits_by_row(audit, len(rows)), rows, strict=True):
        out.add(edits, role, text)
    return *tally.counts(), cost, audit, out.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, left (whether anything is) of the rows as crc32 of `conv_id:turn` modulo 20 damages them: 0 drops a row, 1 empties its text,
    2 takes .!? away, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hit.alias("hit"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    again = F.explode(F.array_repeat(F.col("hit") != 0, F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", again.alias("left"))


_TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = [c.split()[0] for c in _TOLD.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(batches, columns: int) -> Iterator[tuple]:
    return (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | list))
        if len(held) >= 2000 or size >= HELD:
            yield made()
            held, size = [], 0
    if held:
        yield made()


_STREAMED = f"conv_id long, {_TOLD}, part int, block long, nth int, turn long, role string, text string"


def _streamed(batches, most: int) -> Iterator[tuple]:
    """Rows of _STREAMED of a sorted range: conversations that lie in it wholly, as told, and the rows of others with their place: task, block
    (of one conversation, `most` rows at most) and number in it (-1: a row that is not there)."""
    part, none, block = TaskContext.get().partitionId(), (None,) * len(_COLUMNS), 0

    def places(rows: Iterable[tuple]) -> Iterator[tuple]:
        nonlocal block
        nth = 0
        for conv, turn, role, text, left in rows:
            if nth == most:
                block, nth = block + 1, 0
            yield conv, *none, part, block, nth if left else -1, turn, role, text
            nth += left
        block += 1

    waiting: list[tuple] | None = None  # a conversation that may go on behind the range, if none follows
    for number, (_, rows) in enumerate(groupby(_rows(batches, 5), key=lambda r: r[0])):
        if waiting:
            yield waiting[0][0], *repair([r[1:4] for r in waiting if r[4]]), *(None,) * 6
        waiting, size = [], 0
        for r in rows:
            waiting.append(r)
            size += len(r[3])
            # What comes first may have begun before the range.
            if not number or len(waiting) > most or size > HELD:
                yield from places(chain(waiting, rows))
                waiting = None
                break
    if waiting:
        yield from places(waiting)


def repaired(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id long, turn long, role, text, left
    boolean: whether the row is there at all; a conversation without such rows is told, too)."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order, "left").repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    streamed = written(text_batches(dealt).mapInArrow(lambda b: _batches(_streamed(b, most), _schema(_STREAMED)), _STREAMED), "turn-repair")
    return streamed.where("part IS NULL").select("conv_id", *_COLUMNS).unionByName(_joined(streamed.where("part IS NOT NULL").drop(*_COLUMNS)))


_STATE = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
_BLOCKS = "conv_id long, part int, block long, n long, " + ", ".join(f"{c} {'string' if c in _STATE[-2:] else 'long'}" for c in _STATE) + ", moves array<struct<e:int,x:int,cost:long,audit:string>>"
_MOVE = pa.struct([("e", pa.int32()), ("x", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_FOLDED = f"conv_id long, {_TOLD}, part int, block long, edits array<string>"


def _block(t: pa.Table) -> pa.Table:
    """One block's tally and transfer."""
    t = t.sort_by("nth")
    tally = Tally()
    said = list(zip(t.column("initial").to_pylist(), t.column("fault").to_pylist(), strict=True))
    for turn, (initial, fault) in zip(t.column("turn").to_pylist(), said, strict=True):
        tally.add(turn, initial, fault)
    moves = [dict(zip(("e", "x", "cost", "audit"), m, strict=True)) for m in transfer(said)]
    keys = {c: t.column(c).slice(0, 1).combine_chunks() for c in ("conv_id", "part", "block")}
    state = {c: pa.array([v], pa.string() if c in _STATE[-2:] else pa.int64()) for c, v in zip(_STATE, tally.state(), strict=True)}
    return pa.table(keys | {"n": pa.array([len(said)], pa.int64())} | state | {"moves": pa.array([moves], pa.list_(_MOVE))})


def _folded(batches) -> Iterator[tuple]:
    """Rows of _FOLDED from sorted blocks: for each conversation what is told of it, and for each block its rows' edits."""
    for conv, blocks in groupby(_rows(batches, 5 + len(_STATE)), key=lambda r: r[0]):
        tally, kernel, decided, sizes = Tally(), opened(), [], []
        for _, part, block, n, *state, moves in blocks:
            tally.join(tuple(state))
            sizes.append((part, block, n))
            new: Chart = {}
            for m in moves:
                if (before := kernel.get(ITEMS[m["e"]])) is not None:
                    reached = (before[0] + m["cost"], before[1] + m["audit"])
                    new[ITEMS[m["x"]]] = min(reached, new.get(ITEMS[m["x"]], reached))
            # What all audits begin with is decided.
            same = len(os.path.commonprefix([a for _, a in new.values()]))
            decided.append(next(iter(new.values()))[1][:same])
            kernel = {item: (c, a[same:]) for item, (c, a) in new.items()}
        cost, rest = finish(kernel)
        audit = "".join(decided) + rest
        yield conv, *tally.counts(), cost, audit, None, None, None, None
        edits = re.finditer("I*[DKR](?:I+$)?", audit)
        for part, block, n in sizes:
            yield conv, *(None,) * len(_COLUMNS), part, block, [e[0] for e in islice(edits, n)]


def _digested(batches) -> Iterator[tuple]:
    """conv_id and digest from sorted rows (conv_id, part, block, nth, role, text, edits)."""
    for conv, rows in groupby(_rows(batches, 7), key=lambda r: r[0]):
        out = Repaired()
        for *_, role, text, edits in rows:
            out.add(edits, role, text)
        yield conv, out.sha.hexdigest()


def _joined(rows: DataFrame) -> DataFrame:
    """What repaired() tells, for rows with places (part, block, nth), which also give their order."""
    place = ["part", "block", "nth"]
    there = rows.where("nth >= 0")
    # All but the first row of one role and text repeat what was said before.
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    firsts = there.groupBy("conv_id", said.alias("said")).agg(F.min(F.struct(*place)).alias("at")).select("at.*", F.lit(False).alias("again"))
    fault = F.when(~F.col("text").rlike(_BLANK.pattern), "blank").when(F.coalesce("again", F.lit(True)), "duplicate").when(~F.col("text").rlike(_ENDED), "truncated").otherwise("")
    marks = there.join(firsts, place, "left").select("conv_id", *place, "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    blocks = marks.groupBy("conv_id", "part", "block").applyInArrow(_block, _BLOCKS)
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    folded = written(blocks.mapInArrow(lambda b: _batches(_folded(b), _schema(_FOLDED)), _FOLDED), "turn-repair-edits")
    edits = folded.where("part IS NOT NULL").select("part", "block", F.posexplode("edits").alias("nth", "edits"))
    digested = "conv_id long, repaired_sha256 string"
    ordered = there.join(edits, place).select("conv_id", *place, "role", "text", "edits").repartition("conv_id").sortWithinPartitions("conv_id", *place)
    shas = text_batches(ordered).mapInArrow(lambda b: _batches(_digested(b), _schema(digested)), digested)
    told = folded.where("part IS NULL").select("conv_id", *_COLUMNS[:-1])
    # A conversation without any row has no block and no digest.
    empty = rows.groupBy("conv_id").agg(*(F.lit(0).cast("long").alias(c) for c in _COLUMNS[:-2])).withColumn("audit", F.lit(""))
    empty = empty.withColumn("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    parts = told.unionByName(shas, allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in _COLUMNS))
    return parts.unionByName(empty.join(parts.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti"))


def oracle_sql() -> str:
    """DuckDB SQL for repaired(damaged(conversations)): a table of CRC-32 by its polynomial, and one row after another of all conversations at once, with
    the least (cost, audit) for nothing yet (n), a system row (s), a user's (u) and an assistant's (a) as the last one."""
    best = lambda *x: f"list_min([{', '.join(x)}])"
    more = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'e': {x}.e || '{edit}'}}"
    keep, other = f"t * {TRUNCATED}", f"t * {TRUNCATED} + {REROLE}"
    never = "{'c': 1000000000000, 'e': ''}"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {never} END"
    free = "f IN ('', 'truncated')"
    to_u = [when(f"{free} AND r = 'u'", best(*(more(x, keep, "K") for x in ("n", "s", "a")))), when(free, best(*(more(x, other, "R") for x in ("n", "s", "a"))))]
    to_a = [when(f"{free} AND r = 'a'", more("u", keep, "K")), when(free, more("u", other, "R"))]
    # Insertions before a row: u from n, s or a; then a from u.
    insert = f"""{best("u", more("n", INSERT, "I"), more("s", INSERT, "I"), more("a", INSERT, "I"))} AS u"""
    return rf"""
WITH RECURSIVE bits(b, c, k) AS (SELECT b, b, 0 FROM range(256) v(b) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hits AS (SELECT raw.* EXCLUDE (name), xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda h, x: xor(h // 256, t[CAST(xor(h % 256, x) AS INTEGER) + 1])), 4294967295) % 20 AS hit FROM raw, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, hit FROM hits),
doubled AS (SELECT conv_id, turn, role, text FROM hurt, (VALUES (1), (2)) v(copy) WHERE hit <> 0 AND (copy = 1 OR hit = 3)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
ordered AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i
  FROM doubled JOIN ids ON ids.conv_id IS NOT DISTINCT FROM doubled.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS said FROM ordered),
marked AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN said > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS f FROM placed),
pairs AS (SELECT *, lag(r) OVER (PARTITION BY g ORDER BY i) || r AS pair FROM marked),
told AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
  count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY g),
walk AS (SELECT g, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'e': ''}} AS n, {never.replace("1000000000000", "CAST(1000000000000 AS BIGINT)")} AS s, {never.replace("1000000000000", "CAST(1000000000000 AS BIGINT)")} AS u, {never.replace("1000000000000", "CAST(1000000000000 AS BIGINT)")} AS a FROM ids
  UNION ALL
  SELECT g, i, {more("n", DELETE, "D")}, {best(more("s", DELETE, "D"), when(f"{free} AND r = 's'", more("n", keep, "K")))},
    {best(more("u", DELETE, "D"), *to_u)}, {best(more("a", DELETE, "D"), *to_a)}
  FROM (SELECT g, i, r, f, t, n, s, u, {best("a", more("u", INSERT, "I"))} AS a FROM
    (SELECT w.g, w.i + 1 AS i, m.r, m.f, CAST(m.f = 'truncated' AS INTEGER) AS t, w.n, w.s, w.a, {insert} FROM walk w JOIN marked m ON m.g = w.g AND m.i = w.i + 1))),
ends AS (SELECT g, {best("n", "a", more("u", INSERT, "I"), more("n", 2 * INSERT, "II"), more("s", 2 * INSERT, "II"))} AS x FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1)),
cut AS (SELECT g, x.c AS cost, x.e AS audit, regexp_extract_all(x.e, 'I*[DKR]') AS rows, length(regexp_extract(x.e, 'I*$')) AS tail FROM ends),
each AS (SELECT g, m.i, p, substr(rows[m.i], p, 1) AS e, m.role, m.text FROM cut JOIN marked m USING (g), range(1, 1000) v(p) WHERE p <= length(rows[m.i])
  UNION ALL SELECT g, 1000000000000, p, 'I', '', '' FROM cut, range(1, 3) v(p) WHERE p <= tail),
left_ AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i, p) AS k FROM each WHERE e <> 'D'),
heads AS (SELECT g, bool_or(k = 1 AND e = 'K' AND substr(role, 1, 1) = 's') AS led FROM left_ GROUP BY g),
lines AS (SELECT g, string_agg(CASE WHEN e = 'K' THEN role || ':' || text ELSE (CASE WHEN (k - CAST(led AS INTEGER)) % 2 = 1 THEN 'user:' ELSE 'assistant:' END) || CASE WHEN e = 'R' THEN text ELSE '' END END, chr(10) ORDER BY k) AS whole
  FROM left_ JOIN heads USING (g) GROUP BY g)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids JOIN cut USING (g) LEFT JOIN told USING (g) LEFT JOIN lines USING (g)"""
