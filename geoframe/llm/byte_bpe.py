"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its BPE encoding.  The table of these last
tokens is built from left to right: a token that is a suffix of the prefix is the last one if it stands alone or if it
may follow the last token of what is before it, that is if BPE applied to the two together gives the two back.  The
encoding is read off backwards.  Appending bytes only appends to the table, and after an edit only the pieces around
it are made anew.

Defined results: a null text is encoded as the empty text (no ids); an empty text has no ids and decodes to nothing;
a piece of any length is encoded whole, in time in proportion to the tokens that occur in it; repeated rows give
repeated rows; an empty table gives an empty table; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import release, text_batches

#: Pieces that a Python worker keeps encoded; when as many new ones have come, those not seen since go.
KEPT_PIECES = 300_000


class Vocabulary:
    """The ranks of a file of base64 tokens, with each token's last merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.alone: set[int] = set()
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.follows: dict[tuple[int, int], bool] = {}
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                self.alone.add(rank)
                continue
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
                if left < rank and right < rank and left in self.alone and right in self.alone and self.may_follow(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = left, right
                    self.alone.add(rank)
                    break

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right as they are when one follows the other: undo their merges from the latest
        on, and see whether at any time a merge across the border would have come first."""
        limit, merged, halves = 1 << 62, self.merged, self.halves
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """The last token of each prefix of data, where last holds those of the first len(last) prefixes. The matcher tells all tokens
        that end at each byte, the longest first."""
        follows, alone = self.follows, self.alone
        base = max(0, len(last) + 1 - self.longest)
        done = len(last)
        for at, (token, size) in self.matcher.iter(data[base:].decode("latin-1")):
            end = base + at + 1
            if end <= done:
                continue
            if end == size:
                may = token in alone
            else:
                pair = last[end - size - 1], token
                may = follows.get(pair)
                if may is None:
                    may = token in alone and self.may_follow(*pair)
                    if len(follows) < 400_000:
                        follows[pair] = may
            if may:
                last.append(token)
                done = end
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        if (token := self.ranks.get(data)) is not None:
            return [token]
        return self.read_back(data, self.extend(data, []))

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoding:
    """A text's pieces with their ids; append() and edit() encode again only what they touch."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern, self.text = vocabulary, regex.compile(pattern), ""
        self.ends: list[int] = []
        self.parts: list[list[int]] = []
        self.encoded = 0
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.parts))

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> None:
        """Put text in the place of [start, end). Pieces that end well before start stay; from there on pieces are made
        anew until one ends where an old piece after the edit ended, as from there on all are as before."""
        shift = len(text) - (end - start)
        self.text, stays = self.text[:start] + text + self.text[end:], 0
        while stays < len(self.ends) and self.ends[stays] < start:
            stays += 1
        stays = max(0, stays - 2)
        at = self.ends[stays - 1] if stays else 0
        old = {e + shift: i for i, e in enumerate(self.ends) if e >= end}
        ends, parts = self.ends[:stays], self.parts[:stays]
        for m in self.pattern.finditer(self.text, at):
            ends.append(m.end())
            parts.append(self.vocabulary.encode_piece(m[0].encode()))
            self.encoded += 1
            if m.end() > start + len(text) and m.end() in old:
                k = old[m.end()] + 1
                ends += [e + shift for e in self.ends[k:]]
                parts += self.parts[k:]
                break
        self.ends, self.parts = ends, parts


class _Pieces(dict):
    """Ids of pieces as packed 32-bit numbers; two generations, so that pieces in use stay while memory is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}
        self.vocabulary.follows.clear()


_loaded: dict[str, tuple[Vocabulary, _Pieces]] = {}


def tokens_of(path: str) -> list[bytes]:
    """The tokens of a file by rank, which is all that decoding takes."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
    out = [b""] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        out[rank] = token
    return out


def _load(path: str) -> tuple[Vocabulary, _Pieces]:
    if path not in _loaded:
        vocabulary = Vocabulary(path)
        _loaded[path] = vocabulary, _Pieces(vocabulary)
    return _loaded[path]


def _runs(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about as many bytes or values each, one row at least."""
    values = batch.column(column)
    lengths = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values)
    sizes = np.cumsum(np.asarray(lengths).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _ids_of(texts: pa.Array, find, get) -> pa.ListArray:
    values, ends = [np.zeros(0, np.int32)], [0]
    for text in texts.to_pylist():
        ids = np.frombuffer(b"".join(map(get, find(text))), np.int32)
        values.append(ids)
        ends.append(ends[-1] + len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))


def _bytes_of(ids: pa.ListArray, get) -> pa.Array:
    flat, ends = ids.flatten().to_numpy(), np.asarray(ids.offsets)
    ends = (ends - ends[0]).tolist()
    return pa.array([b"".join(map(get, flat[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int>, a row for each row of df: every match of pattern in the whole text encoded by itself."""
    id_type = df.schema[id_col].dataType.simpleString()  # a struct of columns may stand for the id

    def run(batches):
        _, pieces = _load(path)
        find, get = regex.compile(pattern).findall, pieces.__getitem__
        for whole in batches:
            for batch in _runs(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), _ids_of(batch.column(1), find, get)], names=["id", "ids"])
        # Workers live on beside other stages: what was learnt of this task's texts goes.
        pieces.forget()
        release()

    return _texts(df, id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids and decoded binary, a row for each row of df: the bytes that the ids stand for."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        get = tokens_of(path).__getitem__
        for whole in batches:
            for batch in _runs(whole, 1, 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes_of(batch.column(1), get)], names=["id", "ids", "decoded"])
        release()

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return text_batches(rows).mapInArrow(run, f"id {id_type}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_and_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode(encode(df)) gives, by one Python worker a task: ids are decoded where they were made, by the same vocabulary."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary, pieces = _load(path)
        find, get, back = regex.compile(pattern).findall, pieces.__getitem__, vocabulary.tokens.__getitem__
        for whole in batches:
            for batch in _runs(whole, 1, 2_000_000):
                ids = _ids_of(batch.column(1), find, get)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, _bytes_of(ids, back)], names=["id", "ids", "decoded"])
        pieces.forget()
        release()

    return _texts(df, id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digest(ids: Column) -> Column:
    """Lowercase hex of SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of what encode() and then decode() give."""
    out = encode_and_decode(df, path, pattern, id_col, text_col)
    return out.select(id_col, F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
