"""A quality classifier on random-indexing word vectors.

Every word (hashed to WORDS rows) and every word shape (case, digits and what punctuation follows; hashed to SHAPES rows) has
a sparse random index vector.  Over the whole corpus, a word's context vector is the sum of the index vectors of its
neighbours two words to either side; the sums of all tasks are added up in two steps, so no task adds up more than a share.
A document is pooled into means and spreads of the vectors of all its words and shapes, how alike neighbours are, and its
length.  A two-layer network in numpy is trained on the pooled vectors of at most ROWS_PER_CLASS labelled rows of either
label; a part is kept back to fit a temperature, which calibrates the probabilities.

Defined results: null and empty texts are scored as texts without words; whole texts of any length are pooled, in
slices of bounded memory; rows without a label or with another than 0 and 1 teach nothing; if only one label (or none) could be learnt, each score is
its share (or 0.5); several labels of a document count each; repeated rows give repeated rows; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import sliced, text_batches
from geoframe.llm.language_id import held_out

#: Rows of vectors, their width, the sample's bound, hidden units, passes over the sample, and rows in a piece of the sums.
WORDS, SHAPES, WIDTH, ROWS_PER_CLASS, HIDDEN, EPOCHS, PIECE, SEED = 8192, 256, 32, 4000, 32, 40, 256, 11
#: Known tokens of a worker, and words in a slice.
KEPT_TOKENS, SLICE = 300_000, 1 << 17
_ALL = WORDS + SHAPES
_CORE = re.compile(r"\w+")


class Network(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two ones in the index vector of each word and shape."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, WIDTH, (_ALL, 2)), rng.choice((-1, 1), (_ALL, 2))


class _Tokens(dict):
    """token -> word * SHAPES + shape."""

    def __missing__(self, token: str) -> int:
        core = _CORE.search(token)
        word = core[0] if core else ""
        case = "0" if word.isdigit() else "A" if len(word) > 1 and word.isupper() else "a" if word.islower() else "Aa" if word else ""
        rest = (token[: core.start()][:3], token[core.end() :][:3]) if core else (token[:4], "")
        shape = zlib.crc32(f"{rest[0]}{case}{rest[1]}".encode("utf-8", "replace")) % SHAPES
        out = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS * SHAPES + shape
        if len(self) >= KEPT_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out


_tokens = _Tokens()


def _ids(text: str | None) -> np.ndarray:
    return np.fromiter(map(_tokens.__getitem__, (text or "").split()), np.int64)


def _split(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed // SHAPES, packed % SHAPES + WORDS


def contexts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """(WORDS + SHAPES) x (WIDTH + 1): sums of the neighbours' index vectors over all texts, and how often each occurs."""
    places, signs = index_vectors()

    def count(batches):
        total = np.zeros(_ALL * (WIDTH + 1))

        def add(ids: np.ndarray, text: np.ndarray) -> None:
            total[:] += np.bincount(ids * (WIDTH + 1) + WIDTH, minlength=len(total))
            for gap in (1, 2):
                one = text[:-gap] == text[gap:]
                for a, b in ((ids[:-gap][one], ids[gap:][one]), (ids[gap:][one], ids[:-gap][one])):
                    for k in (0, 1):
                        total[:] += np.bincount(a * (WIDTH + 1) + places[b, k], signs[b, k], len(total))

        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            text = np.repeat(np.arange(len(held)), [len(x) for x in held])
            for stream in _split(np.concatenate(held)):
                add(stream, text)

        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                ids = _ids(text)
                if len(ids):
                    held.append(ids)
                    size += len(ids)
                if size >= 1 << 19:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        sums = total.reshape(-1, PIECE * (WIDTH + 1)).astype(np.int64)
        salt = int(np.random.default_rng(abs(int(total.sum()))).integers(0, 64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(np.full(len(sums), salt, np.int32)), pa.array(list(sums), pa.list_(pa.int64()))], names=["piece", "salt", "sums"])

    def add_up(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for piece, salt, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = x.values.to_numpy()
                key = piece, salt % 64
                held[key] = held[key] + x if key in held else x.copy()
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.list_(pa.int64()))], names=["piece", "salt", "sums"])

    kind = "piece int, salt int, sums array<long>"
    parts = text_batches(df.select(text_col)).mapInArrow(count, kind)
    parts = parts.repartition("piece", "salt").mapInArrow(add_up, kind).withColumn("salt", F.lit(0)).repartition("piece").mapInArrow(add_up, kind)
    rows = sorted(parts.select("piece", "sums").toPandas().itertuples(index=False), key=lambda r: r.piece)
    total = np.zeros((_ALL // PIECE, PIECE * (WIDTH + 1)))
    for r in rows:
        total[r.piece] = r.sums
    return total.reshape(_ALL, WIDTH + 1)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Each row's mean context, less the mean over all words or shapes, of length 1 (0 where a row never occurs)."""
    out = np.zeros((_ALL, WIDTH), np.float32)
    for rows in (slice(0, WORDS), slice(WORDS, _ALL)):
        n = sums[rows, WIDTH]
        mean = sums[rows, :WIDTH] / np.maximum(n, 1)[:, None]
        mean -= sums[rows, :WIDTH].sum(0) / max(1, n.sum())
        mean[n == 0] = 0
        out[rows] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    return out


def _tables(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its context vector, for each shape its context and its index vector, all beside their squares."""
    places, signs = index_vectors()
    index = np.zeros((_ALL, WIDTH))
    for k in (0, 1):
        np.add.at(index, (np.arange(_ALL), places[:, k]), signs[:, k])
    words, shapes = vectors[:WORDS], np.concatenate((vectors, index), axis=1)[WORDS:]
    return np.concatenate((words, words * words), axis=1).astype(np.float32), np.concatenate((shapes, shapes * shapes), axis=1)


def pooled(texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row for each text, pooled over all its words."""
    n = len(texts)
    ids = [_ids(t) for t in texts]
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), lengths)
    sums, alike = np.zeros((n, 2 * WIDTH)), np.zeros((n, 2))
    words, shapes = _split(flat)
    for s in range(0, len(flat), SLICE):
        own = owner[s : s + SLICE]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[starts]] += np.add.reduceat(tables[0][words[s : s + SLICE]], starts)
        e = slice(s, min(s + SLICE, len(flat) - 1))
        together = owner[e] == owner[e.start + 1 : e.stop + 1]
        for k, stream in enumerate((words, shapes)):
            alike[:, k] += np.bincount(owner[e], together & (stream[e] == stream[e.start + 1 : e.stop + 1]), n)
    shape_sums = np.bincount(owner * SHAPES + shapes - WORDS, minlength=n * SHAPES).reshape(n, SHAPES) @ tables[1]
    many = np.maximum(lengths, 1)[:, None]
    parts = [alike / many, np.log1p(lengths)[:, None]]
    for total in (sums, shape_sums):
        first, second = np.split(total / many, 2, axis=1)
        parts += [first, np.sqrt(np.maximum(0, second - first**2))]
    return np.concatenate(parts, axis=1)


def _features(df: DataFrame, vectors: np.ndarray, extra: str, kind: str) -> DataFrame:
    def run(batches):
        tables = _tables(vectors)
        for b in sliced(batches):
            x = pooled(b.column(1).to_pylist(), tables).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=[extra, "x"])

    return text_batches(df).mapInArrow(run, f"{extra} {kind}, x array<float>")


def train(x: np.ndarray, y: np.ndarray, back: np.ndarray) -> Network:
    """Rows marked back only serve to fit the temperature."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z, rng = (x - mean) / spread, np.random.default_rng(SEED)
    w1, b1 = rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w1, b1, w2, b2)]
    rows, step = np.flatnonzero(~back), 0
    weight = np.where(y == 1, 0.5 / max(1e-9, y[rows].mean()), 0.5 / max(1e-9, 1 - y[rows].mean()))
    prior = np.log(max(1e-9, y[rows].mean()) / max(1e-9, 1 - y[rows].mean()))
    for epoch in range(EPOCHS):
        order = rng.permutation(rows)
        for s in range(0, len(order), 128):
            i = order[s : s + 128]
            h = np.tanh(z[i] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50)))
            d = (p - y[i]) * weight[i] / len(i)
            dh = d[:, None] * w2 * (1 - h * h)
            step += 1
            for p_, g, (m, v) in zip((w1, b1, w2, b2), (z[i].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ d + 1e-4 * w2, d.sum(keepdims=True)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= 0.003 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    b2 = float(b2[0] + prior)  # the classes were made equally heavy for training
    logit = np.tanh(z[back] @ w1 + b1) @ w2 + b2
    grid = np.geomspace(0.5, 20, 60)
    cost = lambda t: np.logaddexp(0, np.where(y[back] == 1, -1, 1) * logit / t).mean()
    return Network(mean, spread, w1, b1, w2, b2, float(min(grid, key=cost)) if back.any() else 1.0)


def probability(x: np.ndarray, net: Network) -> np.ndarray:
    logit = np.tanh((x - net.mean) / net.spread @ net.w1 + net.b1) @ net.w2 + net.b2
    return 1 / (1 + np.exp(-np.clip(logit / net.temperature, -700, 700)))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Network | float]:
    """Word vectors of the whole corpus, and the network trained on a bounded sample of the labelled rows (or a constant)."""
    vectors = word_vectors(contexts(df, text_col))
    marked = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not n or len(n) < 2:
        return vectors, float(*n) if n else 0.5
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    cut = F.when(F.col("y") == 1, F.lit(ROWS_PER_CLASS / n[1] * (1 << 30))).otherwise(F.lit(ROWS_PER_CLASS / n[0] * (1 << 30)))
    taken = marked.withColumn("place", place).where(F.col("place") < cut).orderBy("place", "id", "y").limit(4 * ROWS_PER_CLASS)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
    # One row of an id and label, however often it is repeated, so that the sample stays as large as its bound.
    rows = rows.groupBy("y", "place", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = _features(rows.select(F.struct("y", "place", "id").alias("k"), "text"), vectors, "k", f"struct<y:int,place:bigint,id:{df.schema[id_col].dataType.simpleString()}>")
    sample = rows.select("k.y", "k.place", "k.id", "x").toPandas().sort_values(["place", "id", "y"], kind="stable")
    if not len(sample):
        return vectors, 0.5
    x, y, back = np.array(sample["x"].tolist(), np.float64), sample["y"].to_numpy().astype(float), sample["place"].to_numpy() % 5 == 0
    # The sample holds as many of either label as it can; b2 is set right for their shares in the table.
    net = train(x, y, back)
    share = y[~back].mean() if (~back).any() else 0.5
    real = n[1] / (n[0] + n[1])
    if 0 < share < 1:
        net = net._replace(b2=net.b2 + float(np.log(real / (1 - real)) - np.log(share / (1 - share))))
    return vectors, net


def predict(df: DataFrame, vectors: np.ndarray, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, the calibrated probability of label 1, a row for each row of df."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        tables = _tables(vectors)
        for b in sliced(batches):
            p = probability(pooled(b.column(1).to_pylist(), tables), net) if isinstance(net, Network) else np.full(b.num_rows, net)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return text_batches(rows).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
