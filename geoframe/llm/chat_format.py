r"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: `message` starts a message, `delta` appends streamed text to it, `edit` replaces its
text, `regenerate` empties it for new deltas, `delete` takes it away.  A table of finished turns becomes such a log, too: texts are streamed
in deltas, some after a draft that is regenerated, some as a draft that is edited, so that its reconstruction goes the same way.  The log is dealt by conversation (and, as an event
changes its own message only, by message, so that a hot conversation is spread), sorted by sequence, and folded as it
streams by; a worker holds the message at hand and nothing else.

Rendering: `<|turn:ROLE|>\nTEXT<|end|>\n` for each message, by sequence.  Inside roles and texts a backslash is put before
each backslash and after the first character of every control string; taking each backslash away and the character after it
literally gives the text back, and no control string is left.

Defined results: null text is empty, null role is the empty role; ties in sequence are ordered by step (if the log has any), kind (as listed above),
role and text; a second `message` event with the same message id starts a second message, so repeated rows are repeated
turns; an event for a message that never started starts it; rows with a null conversation form one of their own; an empty
table gives an empty table; columns other than those named are ignored.  A digest of a whole conversation is sequential:
its messages stream through one task, in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that steer one chat template or another.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A backslash, or the first character of a control string.
_STEERS = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
OPEN, HEAD, END = "<|turn:", "|>\n", "<|end|>\n"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    return _STEERS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, learnt: bool) -> tuple[str, int, int]:
    """A message as formatted text, and where in it the text to learn starts and ends (0, 0: none)."""
    head, body = f"{OPEN}{escape(role)}{HEAD}", escape(text)
    return head + body + END, len(head) * learnt, (len(head) + len(body)) * learnt


def parse(formatted: str) -> Iterator[tuple[str, str, int]]:
    """Role, text and length of each message of a formatted conversation."""
    at = 0
    while at < len(formatted):
        head = formatted.index(HEAD, at)
        end = formatted.index(END, head)
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        yield unescape(formatted[at + len(OPEN) : head]), unescape(formatted[head + len(HEAD) : end]), end + len(END) - at
        at = end + len(END)


def fold(events: Iterable[tuple]) -> Iterator[tuple[int, str, str]]:
    """Final (first sequence, role, text) of what the sorted (seq, kind, role, text) of one message id make."""
    state: list | None = None
    for seq, kind, role, text in events:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        if state and kind == "message":
            yield state[0], state[1], "".join(state[2])
            state = None
        if kind == "delete":
            state = None
            continue
        if state is None:
            state = [seq, role or "", []]
        if kind in ("message", "delta"):
            state[2].append(text or "")
        else:
            state[2] = [text or ""] * (kind == "edit")
    if state:
        yield state[0], state[1], "".join(state[2])


def _groups(batches, columns: int, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that agree in their first columns, streamed."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True))
    for key, group in groupby(rows, lambda row: row[:keys]):
        yield key, (row[keys:] for row in group)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def reconstruct(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, seq, role, text, formatted, mask_start, mask_end of each final message. events: conv_id long, seq long,
    message (a message's id in its conversation, of any type that sorts), kind, role, text, and step long (optional, the order of events of
    one seq). A conversation's formatted text is that of its messages by seq; [mask_start, mask_end) of each is under the loss mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])

    def run(batches):
        def messages():
            for (conv, _), rows in _groups(batches, 6, 2):
                for seq, role, text in fold(rows):
                    yield conv, seq, role, text, *render(role, text, role in learn)

        yield from _batches(messages(), schema)

    step = F.col("step") if "step" in events.columns else F.lit(0)
    by_kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = events.select(F.col("conv_id").cast("long"), "message", F.col("seq").cast("long"), "kind", "role", "text", step.cast("long").alias("step"), by_kind.alias("by_kind"))
    dealt = rows.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "step", "by_kind", "role", "text")
    return dealt.drop("step", "by_kind").mapInArrow(run, "conv_id long, seq long, role string, text string, formatted string, mask_start long, mask_end long")


def read_back(messages: DataFrame) -> DataFrame:
    """A row for each conversation with what its formatted text says once parsed: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def digests():
            for (conv,), rows in _groups(batches, 5, 1):
                n = chars = size = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for _, formatted, start, end in rows:
                    for role, text, _ in parse(formatted):
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode())
                    learnt = unescape(formatted[start:end])
                    chars += len(learnt)
                    loss.update(learnt.encode())
                    size += len(formatted)
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from _batches(digests(), schema)

    rows = messages.select("conv_id", "seq", "formatted", "mask_start", "mask_end").repartition("conv_id")
    # Messages of one seq go by role and text as they are without escapes: told from the formatted text behind the shuffle, so that nothing is sent twice.
    head = F.locate(HEAD, "formatted")
    role = F.substring("formatted", F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
    text = F.substring("formatted", head + len(HEAD), F.length("formatted") - head - len(HEAD) - len(END) + 1)
    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    dealt = rows.withColumns({"role": plain(role), "text": plain(text)}).sortWithinPartitions("conv_id", "seq", "role", "text").drop("role", "text")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Characters of a delta at least, deltas of a text at most, and the draft that an edit or a regeneration takes back.
DELTA, DELTAS, DRAFT = 400, 64, "(draft) "


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of how they came about: each row is a message of its own. A third of
    them (by hash) are streamed in deltas; a third begin with a draft in deltas, are regenerated and streamed again; a third hold a
    draft that an edit replaces."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("how", F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(3)))
    size = F.greatest(F.lit(DELTA), F.ceil(F.length("text") / DELTAS).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / size).cast("int")), lambda k: F.substring("text", k * size + 1, size))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    draft = F.concat(F.lit(DRAFT), F.substring("text", 1, DELTA))
    streamed = F.transform(pieces, lambda t: event("delta", t))
    begun, none = event("message", F.lit("")), F.lit(None).cast("string")
    regenerated = F.concat(F.array(begun, event("delta", draft), event("regenerate", none)), streamed)
    events = F.when(F.col("how") == 0, F.concat(F.array(begun), streamed)).when(F.col("how") == 1, regenerated).otherwise(F.array(event("message", draft), event("edit", F.col("text"))))
    # The first event carries the role; the row's number keeps repeated rows and rows of one turn apart.
    log = rows.select("conv_id", F.struct("turn", "row").alias("message"), F.col("turn").alias("seq"), "role", F.posexplode(events).alias("step", "event"))
    return log.select("conv_id", "message", "seq", "step", "event.kind", F.when(F.col("step") == 0, F.col("role")).alias("role"), "event.text")


def _count(column: str) -> str:
    """SQL for how many characters escape() adds."""
    each = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (*CONTROLS, chr(92))]
    return "(" + " + ".join(each) + ")"


def oracle_sql(extra: list[tuple]) -> str:
    """DuckDB SQL for read_back(reconstruct(log_of(conversations and the extra rows)))."""
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in extra)
    frame = len(OPEN) + len(HEAD) + len(END)
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {rows}) v(conv_id, turn, role, text)),
said AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({frame} + length(role) + length(text) + {_count("role")} + {_count("text")}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""
