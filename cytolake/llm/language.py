"""Operator 11: the language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: letters and their marks in lower case, all else as single blanks; n-grams of 1 to ``ORDER`` units, hashed to ``1 << BITS`` places. A feature's value is (1 + ln tf) * idf, and a text's vector
  has length 1. Document frequencies are counted over all documents to learn from.
* Training: follow the regularised leader, coordinate by coordinate, with an L1 and an L2 penalty. The rows to learn from are a sample of about ``SAMPLE`` rows and ``SAMPLE_CHARS`` characters a language at
  most (a hash of the id chooses), dealt to shards of about ``SHARD_ROWS``. In each of ``EPOCHS`` rounds a task takes one shard through the learner, beginning with the common state; a feature's next state
  is the mean over the shards that saw it. The L1 penalty leaves most weights at zero, and only the others are sent to score.
* Calibration: a tenth of the sample is kept from training. One temperature, the best of two grids by their summed log loss, divides all scores before they become probabilities.

Learned only from rows with a language whose ``crc32(doc_id) mod 4`` is not 2. No prediction looks at language, source or id.

Defined results: a null text and one without a letter is ``und`` with score 0, and so is any where nothing could be learned. Repeated rows are scored each; a null id is never learned from and not held out. An
empty table gives an empty result. Very long texts are read whole, ``PIECE`` units at a time. Only id, text and language are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, shards

FOLDS, HELD = 4, 2
ORDER, BITS = 4, 18
#: Rows and characters of a language to learn from, at most about.
SAMPLE, SAMPLE_CHARS = 1_000, 4_000_000
SHARD_ROWS, EPOCHS = 2_000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
PIECE = 1 << 20
GRID = np.exp(np.linspace(np.log(0.02), np.log(20.0), 61))
UNDETERMINED = "und"
_FACTOR, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


# -- features --------------------------------------------------------------------------------------------------------


@cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for all else, by code point."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of about ``PIECE`` characters at a time: the units before (up to ORDER - 1), the piece's own units, and whether a letter is among them. Units are the code points of letters
    and marks; a run of anything else is one blank, and so are both ends."""
    before = np.full(1, 32, np.uint64)
    for a in range(0, len(text), PIECE):
        u = np.frombuffer(text[a : a + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[np.minimum(u, 0x10FFFF)]
        word = kind > 0
        own = np.where(word, u, 32)[word | np.concatenate([[before[-1] != 32], word[:-1]])].astype(np.uint64)
        if a + PIECE >= len(text) and (own[-1] if len(own) else before[-1]) != 32:
            own = np.append(own, np.uint64(32))
        yield before, own, bool((kind == 1).any())
        before = np.concatenate([before, own])[1 - ORDER :]


def hashed(before: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the n-grams that end among the own units, order by order."""
    for n in range(1, ORDER + 1):
        u = np.concatenate([before[len(before) - min(n - 1, len(before)) :], own])
        if len(u) >= n:
            h = np.zeros(len(u) - n + 1, np.uint64)
            for k in range(n):
                h = h * _ODD + u[k : len(u) - n + 1 + k]
            yield ((h + np.uint64(n)) * _FACTOR >> np.uint64(64 - BITS)).astype(np.int64)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, times), sorted by row and place; rows without a letter have none."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size, lettered = 0, np.zeros(len(texts), bool)

    def fold() -> None:
        if held:
            parts.append(np.unique(np.concatenate(held), return_counts=True))
            held.clear()

    for row, t in enumerate(texts):
        for before, own, letter in pieces(t or ""):
            lettered[row] |= letter
            held += [h + (row << BITS) for h in hashed(before, own)]
            size += len(own)
            if size >= PIECE:
                fold()
                size = 0
    fold()
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    key, times = parts[0]
    if len(parts) > 1:
        key, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        times = np.bincount(back, np.concatenate([n for _, n in parts]))
    some = lettered[key >> BITS]
    key, times = key[some], times[some].astype(np.int64)
    return key >> BITS, key & ((1 << BITS) - 1), times


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) with length 1 for each row that has any."""
    row, place, times = counts(texts)
    value = (1 + np.log(times)) * idf[place]
    return row, place, value / np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]


# -- training --------------------------------------------------------------------------------------------------------


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of every place, over all rows of (text); and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in batches:
            n += b.num_rows
            df[:-1] += np.bincount(counts(b.column(0).to_pylist())[1], minlength=1 << BITS)
        df[-1] = n  # one place more tells the number of rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["place", "n"])

    got = texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a place at most
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[got["place"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the leader's sums come to: zero where the gradients do not outweigh the L1 penalty."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over rows of (class, places, values); changes the state in place."""
    for y, at, x in rows:
        zs, ns = z[at], n[at]
        w = weight(zs, ns)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        n[at] = ns + g * g
        z[at] = zs + g - (np.sqrt(n[at]) - np.sqrt(ns)) / ALPHA * w


PER_BLOCK = 1 << 12
_STATE = "shard int, block int, place array<int>, z array<double>, n array<double>"


def _pack(shard: int, at: np.ndarray, z: np.ndarray, n: np.ndarray) -> pa.Table:
    """A row for each block of places; ``at`` ascends."""
    cut = np.flatnonzero(np.diff(at // PER_BLOCK, prepend=-1))
    ends = [*cut[1:].tolist(), len(at)]
    spans = list(zip(cut.tolist(), ends, strict=True))
    return pa.table({
        "shard": pa.array([shard] * len(spans), pa.int32()), "block": pa.array([int(at[a]) // PER_BLOCK for a, _ in spans], pa.int32()), "place": pa.array([at[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())),
        "z": pa.array([z[a:b].ravel() for a, b in spans], pa.list_(pa.float64())), "n": pa.array([n[a:b].ravel() for a, b in spans], pa.list_(pa.float64())),
    })


def _unpack(t: pa.Table, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, z, n = (np.concatenate([np.asarray(x.values) for x in t[c]] or [np.zeros(0)]) for c in ("place", "z", "n"))
    return at.astype(np.int64), z.reshape(-1, classes), n.reshape(-1, classes)


def _mix(t: pa.Table, classes: int) -> pa.Table:
    """The mean of each place's states over the shards that saw it."""
    at, z, n = _unpack(t.sort_by("shard"), classes)
    places, back, many = np.unique(at, return_inverse=True, return_counts=True)
    out = [np.zeros((len(places), classes)) for _ in range(2)]
    for x, total in zip((z, n), out, strict=True):
        np.add.at(total, back, x)
    return _pack(0, places, out[0] / many[:, None], out[1] / many[:, None])


Rows = list[tuple[int, np.ndarray, np.ndarray]]


def _unroll(b: pa.RecordBatch) -> Iterator[tuple[int, Rows]]:
    """Shards with their rows of (class, places, values)."""
    for k in range(b.num_rows):
        y, at, place, value = (np.asarray(b.column(c)[k].values) for c in ("y", "at", "place", "value"))
        yield b.column("shard")[k].as_py(), [(int(c), place[i:j], value[i:j].astype(float)) for c, i, j in zip(y, at[:-1], at[1:], strict=True)]


def train(rows: DataFrame, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not all zero, from :func:`shard_rows`."""

    def mix(t: pa.Table) -> pa.Table:
        return _mix(t, classes)

    at, z, n = np.zeros(0, np.int64), np.zeros((0, classes)), np.zeros((0, classes))
    for _ in range(epochs):
        sent = rows.sparkSession.sparkContext.broadcast((at, z, n))  # 1 << BITS places at most

        def learn(batches: Iterator[pa.RecordBatch], state=sent) -> Iterator[pa.RecordBatch]:
            known, z_before, n_before = state.value
            for b in batches:
                for shard, own in _unroll(b):
                    places = np.unique(np.concatenate([p for _, p, _ in own]))
                    z, n = np.zeros((len(places), classes)), np.zeros((len(places), classes))
                    if len(known):
                        to = np.minimum(np.searchsorted(known, places), len(known) - 1)
                        old = known[to] == places
                        z[old], n[old] = z_before[to[old]], n_before[to[old]]
                    follow([(y, np.searchsorted(places, p), x) for y, p, x in own], z, n)
                    yield from _pack(shard, places, z, n).to_batches()

        seen = rows.mapInArrow(learn, _STATE).groupBy("block").applyInArrow(mix, _STATE)
        at, z, n = _unpack(seen.toArrow(), classes)
        order = np.argsort(at)
        at, z, n = at[order], z[order], n[order]
    w = weight(z, n)
    some = (w != 0).any(axis=1)
    return at[some], w[some]


class Model:
    """Languages, document weights, places with weights, and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, place: np.ndarray, w: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.place, self.w, self.temperature = langs, idf, place, w, temperature
        self.to = np.full(1 << BITS, -1, np.int32)
        self.to[place] = np.arange(len(place))

    def __getstate__(self) -> tuple:
        return self.langs, self.idf, self.place, self.w, self.temperature

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def sums(self, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        to = self.to[place]
        row, to, value = row[to >= 0], to[to >= 0], value[to >= 0]
        return np.stack([np.bincount(row, value * self.w[to, c], minlength=n) for c in range(len(self.langs))], axis=1) if self.langs else np.zeros((n, 0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        row, place, value = vectors(texts, self.idf)
        best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        some = np.unique(row)
        if self.langs and len(some):
            s = self.sums(len(texts), row, place, value)[some] / self.temperature
            p = np.exp(s - s.max(axis=1, keepdims=True))
            score[some] = 1 / p.sum(axis=1)
            for k, c in zip(some, s.argmax(axis=1), strict=True):
                best[k] = self.langs[c]
        return best, score


def log_losses(rows: DataFrame, model: Model, temperatures: np.ndarray, smooth: float = 0.0) -> np.ndarray:
    """Summed over the rows of :func:`shard_rows`, for each temperature; ``smooth`` is the share of a row that counts for all languages alike."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(temperatures))
        for b in batches:
            for _, own in _unroll(b):
                row = np.repeat(np.arange(len(own)), [len(p) for _, p, _ in own])
                s = sent.value.sums(len(own), row, np.concatenate([p for _, p, _ in own]), np.concatenate([x for *_, x in own]))
                for k, t in enumerate(temperatures):
                    x = s / t
                    right = (1 - smooth) * x[np.arange(len(x)), [y for y, *_ in own]] + smooth * x.mean(axis=1)
                    total[k] += np.sum(np.logaddexp.reduce(x, axis=1) - right)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "loss"])

    got = rows.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    out = np.zeros(len(temperatures))
    for r in got:
        out[r.k] = r.loss
    return out


def calibrate(rows: DataFrame, model: Model) -> float:
    """The temperature of least log loss: the best of a grid, then of a finer one about it. 1 without rows. As in Platt's scaling a row of n counts 1 / (n + 2) for all languages alike,
    so languages without a single error among the rows do not get probabilities of 1."""
    n = rows.agg(F.sum(F.size("y"))).first()[0]
    if not n:
        return 1.0
    best = float(GRID[log_losses(rows, model, GRID, 1 / (n + 2)).argmin()])
    fine = best * (GRID[1] / GRID[0]) ** np.linspace(-1, 1, 41)
    return float(fine[log_losses(rows, model, fine, 1 / (n + 2)).argmin()])


_ROWS = "shard int, kept boolean, y array<int>, at array<int>, place array<int>, value array<float>"


def shard_rows(chosen: DataFrame, idf: np.ndarray, langs: list[str], tasks: int) -> DataFrame:
    """The vectors of rows of (key, text, lang): two rows a shard, of which one is kept for calibration; a written table, read again in every round without a shuffle."""
    sent = chosen.sparkSession.sparkContext.broadcast((idf, {x: k for k, x in enumerate(langs)}))

    def run(t: pa.Table) -> pa.Table:
        idf, number = sent.value
        t = t.take(pa.array(np.lexsort((np.array(t["lang"].to_pylist(), object), t["key"].to_numpy()))))
        key, lang, text = t["key"].to_numpy(), t["lang"].to_pylist(), t["text"].to_pylist()
        out = []
        for kept in (False, True):
            own = np.flatnonzero((key % 10 == 0) == kept)
            row, place, value = vectors([text[k] for k in own], idf)
            some = np.unique(row)
            at = np.append(np.searchsorted(row, some), len(row))
            if len(some):
                out.append({"shard": t["shard"][0].as_py(), "kept": kept, "y": [number[lang[own[r]]] for r in some], "at": at.astype(np.int32), "place": place.astype(np.int32), "value": value.astype(np.float32)})
        kinds = {"shard": pa.int32(), "kept": pa.bool_(), "y": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "place": pa.list_(pa.int32()), "value": pa.list_(pa.float32())}
        return pa.table({c: pa.array([r[c] for r in out], k) for c, k in kinds.items()})

    dealt = chosen.withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(tasks)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(run, _ROWS), "language-rows")


def fit(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, per_shard: int = SHARD_ROWS) -> Model:
    """From ``docs`` of (id, text, lang), all of which may be learned from."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"), F.lit(float(sample_chars)) / F.greatest(F.col("chars"), F.lit(1)))
    sizes = materialize(sizes.select("lang", "n", share.alias("share")), "language-sizes")
    langs = [r.lang for r in sizes.select("lang").orderBy("lang").collect()]  # a row a language
    if not langs:
        return Model([], np.ones(1 << BITS), np.zeros(0, np.int64), np.zeros((0, 0)))
    df, n = document_frequencies(docs.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    chosen = docs.join(sizes, "lang").where(spread < F.col("share") * (1 << 30)).select(F.xxhash64(F.lit("deal"), "id", "text").alias("key"), "lang", "text")
    tasks = shards(int(sizes.agg(F.sum(F.col("n") * F.col("share"))).first()[0]), per_shard)
    rows = shard_rows(chosen, idf, langs, tasks)
    model = Model(langs, idf, *train(rows.where("not kept"), len(langs)))
    model.temperature = calibrate(rows.where("kept"), model)
    return model


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the prediction is one scan without a shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    fold = lambda c: F.crc32(F.col(c).cast("string")) % FOLDS
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows.where((fold("id") != HELD) & F.col("lang").isNotNull()), sample, sample_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = rows.select("id", "text").mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id") == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
