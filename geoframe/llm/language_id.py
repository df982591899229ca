"""Language identification from averaged hashed subword embeddings.

A text's subwords are the runs of 2 to 4 bytes inside its lower-cased words, word borders included; each is hashed to a row of
an embedding matrix, the rows are averaged, and a linear softmax tells the language.  The model is trained by stochastic
gradient descent in numpy on a bounded sample: ROWS_PER_LANGUAGE labelled rows (as a hash of their ids takes them, one row of each id) for each language, as many of each
as make SAMPLE_ROWS where languages are many, but one at least, each row whole and in a few excerpts so that short texts are learnt too; of a row
with more different subwords than its share of SAMPLE_VALUES, an excerpt from anywhere in it takes the place of the whole, so that the sample fits the driver whatever the
texts' lengths.  A part of the sample is kept back: on it a temperature is fitted, and then the threshold of rejection, the least confidence such that of the rows
kept at most REJECT_ERROR are wrong; it never falls below FLOOR times the confidence of a blind guess.

As embedding and softmax are both linear, scoring needs their product only, one short row for each hash.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected, and so is every text if no
label could be learnt; whole texts of any length are scored, in slices of bounded memory; ties go to the language that
sorts first; repeated rows give repeated rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm.common import sliced, text_batches

#: The sample's bounds, the model's size and the rule of rejection.
ROWS_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_VALUES, HASHES, WIDTH, EPOCHS, REJECT_ERROR, FLOOR, SEED = 800, 160_000, 40_000_000, 1 << 15, 16, 6, 0.02, 1.2, 7
_WORD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Bytes of texts that are scored at a time, and numbers of them, so that memory does not grow with the languages.
SLICE, SLICE_VALUES = 1 << 18, 1 << 21


class Model(NamedTuple):
    languages: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For 2, 3 and 4 bytes, the hash at each place of the padded, translated bytes; 0 where a run holds a border inside."""
    gap, out = data == 32, []
    a = data.astype(np.uint32)
    h = a
    inside = gap
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(16777619) + a[n - 1 :]
        inside = gap[:-1] & gap[1:] if n == 2 else gap[1:-1].copy() if n == 3 else gap[1:-2] | gap[2:-1]
        mixed = (h * np.uint32(2654435761)) >> np.uint32(17)
        mixed = np.where(mixed == 0, 1, mixed)
        mixed[inside] = 0
        out.append(mixed)
    return out


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_WORD) + b" "


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's subwords and how often each occurs, whole, in slices that overlap by 3 bytes."""
    data, total = np.frombuffer(_bytes(text), np.uint8), np.zeros(HASHES, np.int64)
    for s in range(0, len(data), SLICE):
        for n, h in zip((2, 3, 4), subwords(data[s : s + SLICE + 3]), strict=True):
            total += np.bincount(h[: min(SLICE, len(data) - s - n + 1)], minlength=HASHES)
    total[0] = 0
    which = np.flatnonzero(total)
    return which.astype(np.int32), total[which].astype(np.int32)


def _sample(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, which, share: hashes of the sampled rows and of excerpts of them as bytes of uint16, and their shares as bytes of float32, made on the executors."""
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30))
    per = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("count"), F.min(place).alias("first"))
    # One line for each language; its first row is taken however few the others are.
    wanted = F.least(F.lit(float(ROWS_PER_LANGUAGE)), F.lit(float(SAMPLE_ROWS)) / F.count("*").over(Window.partitionBy()))
    share = F.lit(SAMPLE_VALUES) / F.greatest(F.sum(F.least(wanted, F.col("count"))).over(Window.partitionBy()) * 1.2, F.lit(1.0))
    cut = per.select("lang", "first", (F.lit(float(1 << 30)) * F.least(F.lit(1.0), wanted / F.col("count"))).alias("cut"), F.greatest(share, F.lit(64.0)).cast("int").alias("most"))
    taken = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).join(F.broadcast(cut), "lang").where("place < cut OR place = first")
    # One row of an id, however often it is repeated, so that the sample is as large as the bounds say.
    taken = taken.groupBy("lang", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("most").alias("most"))

    def run(batches):
        for b in sliced(batches):
            lang, which, share, place = [], [], [], []
            for label, text, at, most in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.split()
                rng = np.random.default_rng(at)
                starts = [(int(rng.integers(0, max(1, len(words) - size + 1))), size) for size in (4, 12, 40)]
                for k, piece in enumerate((text, *(" ".join(words[s : s + size]) for s, size in starts))):
                    x, y = counts(piece)
                    size = len(words)
                    while len(x) > most and size > 4:
                        size = max(4, size * most // (len(x) + most // 8))
                        s = int(rng.integers(0, len(words) - size + 1))
                        x, y = counts(" ".join(words[s : s + size]))
                    if len(x):
                        lang.append(label)
                        which.append(x.astype(np.uint16).tobytes())
                        share.append((y / np.sum(y)).astype(np.float32).tobytes())
                        place.append(at * 4 + k)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(which, pa.binary()), pa.array(share, pa.binary()), pa.array(place, pa.int64())], names=["lang", "which", "share", "place"])

    return text_batches(taken.select("lang", "text", "place", "most")).mapInArrow(run, "lang string, which binary, share binary, place long")


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Of a grid, the one under which held-back labels are likeliest."""
    grid = np.geomspace(0.5, 20, 60)
    return float(min(grid, key=lambda t: -_log_softmax(logits / t)[np.arange(len(truth)), truth].mean()))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    sample = _sample(df, id_col, text_col, lang_col).toPandas().sort_values(["place", "lang"], kind="stable", ignore_index=True)
    languages = sorted(sample["lang"].unique())
    if not languages:
        return Model([], np.zeros((HASHES, 0), np.float32), np.zeros(0), 1.0, 1.0)
    truth = np.searchsorted(languages, sample["lang"])
    which = [np.frombuffer(x, np.uint16) for x in sample["which"]]
    share = [np.frombuffer(x, np.float32) for x in sample["share"]]
    place = sample["place"].to_numpy()
    del sample
    rng = np.random.default_rng(SEED)
    back = (place // 4) % 5 == 0
    train, back = np.flatnonzero(~back), back & (place % 4 == 0)
    alone = ~np.isin(truth, truth[train])
    train = np.flatnonzero(np.isin(np.arange(len(truth)), train) | alone)  # a language of which all rows are kept back is learnt from them
    if not len(train) or not back.any():
        train, back = np.arange(len(truth)), np.ones(len(truth), bool)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (HASHES, WIDTH))
    w, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    columns, steps, done = np.arange(WIDTH), EPOCHS * -(-len(train) // 32), 0

    def gathered(rows):
        idx, val = np.concatenate([which[i] for i in rows]), np.concatenate([share[i] for i in rows])
        starts = np.cumsum([0, *(len(which[i]) for i in rows[:-1])])
        return idx, val, starts, np.add.reduceat(e[idx] * val[:, None], starts)

    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for s in range(0, len(order), 32):
            rows = order[s : s + 32]
            rate = 0.5 * (1 - done / steps)
            done += 1
            idx, val, starts, x = gathered(rows)
            g = np.exp(_log_softmax(x @ w + bias))
            g[np.arange(len(rows)), truth[rows]] -= 1
            gx = g @ w.T
            w -= rate * x.T @ g
            bias -= rate * g.sum(0) / len(rows)
            each = np.repeat(gx, np.diff([*starts, len(idx)]), axis=0) * val[:, None]
            used, at = np.unique(idx, return_inverse=True)
            step = np.bincount((at[:, None] * WIDTH + columns).ravel(), each.ravel(), len(used) * WIDTH).reshape(-1, WIDTH)
            e[used] -= rate * WIDTH * step
    kept_back = np.flatnonzero(back)
    logits = np.concatenate([gathered(kept_back[s : s + 32])[3] for s in range(0, len(kept_back), 32)]) @ w + bias
    t = temperature(logits, truth[kept_back])
    p = np.exp(_log_softmax(logits / t))
    sure, right = p.max(1), p.argmax(1) == truth[kept_back]
    order = np.argsort(-sure, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= REJECT_ERROR)
    least = sure[order[fine[-1]]] if len(fine) else 1.0
    floor = min(0.9, FLOOR / len(languages))
    # With no need to reject, the threshold is the floor: being as sure as the least sure row seen is no reason to go.
    threshold = floor if len(fine) and fine[-1] == len(order) - 1 else max(floor, float(least))
    rows = (e @ w).astype(np.float32)
    rows[0] = 0
    return Model(languages, rows, bias, t, threshold)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Logits of whole texts (with letters)."""
    out, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held: list[bytes] = []
    first = size = 0
    most = max(64, min(SLICE, SLICE_VALUES // max(1, len(model.languages))))

    def add(parts: list[bytes], at: int) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        for h in subwords(data):
            if len(h):
                inside = np.minimum(starts, len(h) - 1)
                out[at : at + len(parts)] += np.add.reduceat(model.rows[h], inside) * (starts < len(h))[:, None]
                n[at : at + len(parts)] += np.add.reduceat((h > 0).astype(np.float64), inside) * (starts < len(h))

    for i, text in enumerate(texts):
        data = _bytes(text)
        if len(data) > most:
            which, k = counts(text)
            out[i], n[i] = (model.rows[which] * k[:, None]).sum(0), k.sum()
            data = b" "
        held.append(data)
        size += len(data)
        if size > most:
            add(held, first)
            held, first, size = [], i + 1, 0
    if held:
        add(held, first)
    return out / np.maximum(n, 1)[:, None] + model.bias


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (calibrated probability of it), rejected."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            fine = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if fine:
                p = np.exp(_log_softmax(scores([texts[i] for i in fine], model) / model.temperature))
                best = p.argmax(1)
                score[fine] = p[np.arange(len(best)), best]
                out[fine] = score[fine] < model.threshold
                for i, k in zip(fine, best.tolist(), strict=True):
                    lang[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(out)], names=["id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return text_batches(rows).mapInArrow(run, f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def kept(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that are not rejected, with all their columns."""

    def run(batches):
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            stay = np.zeros(len(texts), bool)
            fine = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            if fine:
                p = np.exp(_log_softmax(scores([texts[i] for i in fine], model) / model.temperature))
                stay[fine] = p.max(1) >= model.threshold
            yield b.filter(pa.array(stay))

    return text_batches(df).mapInArrow(run, df.schema)
