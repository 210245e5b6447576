"""Operator 6: a quality classifier by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are characters (UTF-16 units; digits count as one digit, white space as one blank), the order is ``ORDER``, and each language has
its own model. Counts cover all trusted documents but a fifth (by a hash of the id), whose perplexities give the language's
threshold: the median and ``SPREADS`` times the way from it to a quantile that a few bad texts among the trusted do not move, with a margin that falls with the
root of their number. A document above its language's threshold is rejected.

Training is a chain of joins between count tables sharded by language and n-gram: counts of the highest order, continuation
counts of the lower ones, the discounts of each order, the totals of each context, and the lower order's probabilities, joined on
the suffix. Tasks count n-grams of their own rows before anything is shuffled, and give up what they have gathered when it
becomes too much, so memory is bounded.

The model reaches the documents in one of two ways with equal results. A model of at most ``SENT_ROWS`` entries (counted first)
is sent to the executors; no text is shuffled. A larger one stays sharded: batches of documents request the entries for their own
n-grams by a join, and are scored beside them (``sharded``).

Scores of short texts vary widely, so a document's score is drawn towards its language's mean as if by ``PRIOR`` characters of it.

Defined results: a null or empty text has n_chars 0, the language's mean as score and is kept (there is nothing to judge it by);
a document of a language without trusted text is kept, with a null score and threshold. A null language counts as the empty one. Repeated
rows are counted and scored each. Empty tables give empty results. Only the id, text and language are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, shards, unused

ORDER = 4
SENT_ROWS = 4_000_000
#: So many ids of trusted documents are sent to the executors at most (8 bytes each); more are joined by a shuffle.
SENT_IDS = 2_000_000
GATHERED = 2_000_000
QUANTILE, SPREADS, MARGIN, PRIOR = 0.9, 4.0, 1.25, 60
HELD_OUT = 5
START = 2
UNIT = 16
BATCH_BYTES = 8 << 20

_TABLE = np.arange(1 << 16, dtype=np.uint16)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000:
        if chr(_c).isdigit():
            _TABLE[_c] = ord("0")
        elif chr(_c).isspace() or _c <= START:
            _TABLE[_c] = ord(" ")


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts, each text after ORDER - 1 start units, and the place where each text's own units begin; and the end."""
    parts, at, place = [], [], 0
    pad = np.full(ORDER - 1, START, np.uint64)
    for t in texts:
        own = _TABLE[np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2")].astype(np.uint64)
        parts += [pad, own]
        at.append(place + ORDER - 1)
        place += ORDER - 1 + len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([*at, place], np.int64)


def grams(u: np.ndarray) -> np.ndarray:
    """Key of the n-gram that ends at each place from ORDER - 1 on: the oldest unit in the highest bits."""
    n = len(u) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key |= u[k : k + n] << np.uint64(UNIT * (ORDER - 1 - k))
    return key


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts one after another, and the number of keys of each."""
    u, at = units(texts)
    g = grams(u)
    return g[u[ORDER - 1 :] != START], np.diff(at) - np.array([*([ORDER - 1] * (len(texts) - 1)), 0][: len(texts)], np.int64)


def _by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[str]]]:
    rows: dict[str, list[int]] = {}
    for k, x in enumerate(b.column("lang").to_pylist()):
        rows.setdefault(x, []).append(k)
    text = b.column("text").to_pylist()
    for lang, at in rows.items():
        yield lang, at, [text[k] or "" for k in at]


# -- training ------------------------------------------------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, c) of all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            g, back = np.unique(np.concatenate([x for x, _ in have[lang]]), return_inverse=True)
            return g, np.bincount(back, np.concatenate([c for _, c in have[lang]])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in have:
                g, c = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "g", "c"])

        for b in batches:
            for lang, _, texts in _by_lang(b):
                got = np.unique(text_grams(texts)[0], return_counts=True)
                have.setdefault(lang, []).append(got)
                held += len(got[0])
            if held > GATHERED:
                for lang in have:
                    have[lang] = [merged(lang)]
                held = sum(len(x[0][0]) for x in have.values())
                if held > GATHERED // 2:
                    yield from out()
                    have, held = {}, 0
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order from how many n-grams occur once, twice, three and four times."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")) for k in (1, 2, 3)]
    return n.select("lang", *[F.greatest(F.lit(0.05 * k), F.least(F.lit(float(k)), F.coalesce(x, F.lit(0.5 * k)))).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])


def train(trusted: DataFrame) -> DataFrame:
    """(lang, kind, key, value): natural logs. Kind k > 0: probability of the n-gram of order k; kind -k: what a context (key without
    the last unit) of order k leaves to the lower order; kind 0: probability of a unit never seen."""
    counts = {ORDER: materialize(gram_counts(trusted), "ngram-counts")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << (UNIT * k)) - 1))
        counts[k] = materialize(counts[k + 1].groupBy("lang", suffix.alias("g")).agg(F.count("*").alias("c")), f"ngram-continuations-{k}")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        ctx = F.shiftrightunsigned("g", UNIT) if k > 1 else F.lit(0).cast("long")
        table = counts[k].withColumn("ctx", ctx)
        stats = table.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == j if j < 3 else F.col("c") >= 3).alias(f"m{j}") for j in (1, 2, 3)])
        of = discounts(table)
        left = sum(F.col(f"d{j}") * F.col(f"m{j}") for j in (1, 2, 3)) / F.col("total")
        stats = stats.join(of, "lang").withColumn("left", left)
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = table.join(stats, ["lang", "ctx"])
        if lower is None:
            joined = joined.withColumn("below", 1.0 / (F.col("m1") + F.col("m2") + F.col("m3") + 1))
            out.append(stats.select("lang", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.log(F.col("left") / (F.col("m1") + F.col("m2") + F.col("m3") + 1)).alias("value")))
        else:
            joined = joined.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << (UNIT * (k - 1))) - 1)))
            joined = joined.join(lower.withColumnsRenamed({"g": "suffix", "p": "below"}), ["lang", "suffix"])
            out.append(stats.select("lang", F.lit(-k).alias("kind"), F.col("ctx").alias("key"), F.log("left").alias("value")))
        lower = materialize(joined.select("lang", "g", ((F.col("c") - d) / F.col("total") + F.col("left") * F.col("below")).alias("p")), f"ngram-p{k}")
        out.append(lower.select("lang", F.lit(k).alias("kind"), F.col("g").alias("key"), F.log("p").alias("value")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    return materialize(model, "ngram-model")


# -- scoring -------------------------------------------------------------------------------------------------------

Arrays = dict[tuple[str | None, int], tuple[np.ndarray, np.ndarray]]


def arrays(lang: list, kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> Arrays:
    out: Arrays = {}
    names = pd.Series(lang, dtype=object)
    for (name, k), at in names.groupby([names, kind], dropna=False).groups.items():
        keys = key[at].view(np.uint64)
        order = np.argsort(keys)
        out[name, int(k)] = keys[order], value[at][order]
    return out


def _find(model: Arrays, lang: str, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values for keys, and which keys are there."""
    have, value = model.get((lang, kind), (np.zeros(0, np.uint64), np.zeros(0)))
    if not len(have):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return value[at], have[at] == keys


def log_probs(model: Arrays, lang: str, keys: np.ndarray) -> np.ndarray:
    """Of each n-gram's last unit; keys should be distinct, for speed alone."""
    out = np.zeros(len(keys))
    todo, now = np.arange(len(keys)), keys
    for k in range(ORDER, 0, -1):
        value, there = _find(model, lang, k, now)
        out[todo[there]] += value[there]
        todo, now = todo[~there], now[~there]
        if not len(todo):
            return out
        if k > 1:
            value, there = _find(model, lang, -k, now >> np.uint64(UNIT))
            out[todo] += np.where(there, value, 0.0)
            now = now & np.uint64((1 << (UNIT * (k - 1))) - 1)
    out[todo] += model[lang, 0][1][0]
    return out


def _sums(model: Arrays, lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probability and number of units of each text."""
    keys, n = text_grams(texts)
    uniq, back = np.unique(keys, return_inverse=True)
    p = log_probs(model, lang, uniq)[back] if len(keys) else np.zeros(0)
    some, total = n > 0, np.zeros(len(n))
    if some.any():
        total[some] = np.add.reduceat(p, (np.cumsum(n) - n)[some])  # each text by itself: equal texts have equal sums, wherever they stand
    return -total, n


def _score_batch(b: pa.RecordBatch, model: Arrays) -> tuple[np.ndarray, np.ndarray]:
    nll, n = np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int64)
    for lang, at, texts in _by_lang(b):
        if (lang, 0) in model:
            nll[at], n[at] = _sums(model, lang, texts)
        else:
            n[at] = [len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts]
    return nll, n


def _scored(docs: DataFrame, model: DataFrame, sent_rows: int) -> DataFrame:
    """(id, lang, nll, n_chars) of rows of (id, lang, text)."""
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, nll double, n_chars long"

    def emit(b: pa.RecordBatch, m: Arrays) -> pa.RecordBatch:
        nll, n = _score_batch(b, m)
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(nll, from_pandas=True), pa.array(n)], names=["id", "lang", "nll", "n_chars"])

    if model.count() <= sent_rows:
        t = model.toArrow()
        sent = spark.sparkContext.broadcast(arrays(t["lang"].to_pylist(), t["kind"].to_numpy(), t["key"].to_numpy(), t["value"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield emit(b, sent.value)

        return docs.mapInArrow(run, schema)
    return sharded(docs, model, emit, schema)


def sharded(docs: DataFrame, model: DataFrame, emit, schema: str) -> DataFrame:
    """Documents scored in batches of about BATCH_BYTES, each beside the entries that its own n-grams ask for."""
    some = docs.withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    n = shards(some.agg(F.sum("chars")).first()[0] or 0, BATCH_BYTES)
    # the row's number spreads repeated rows; it is written, so that both readers see the same batches
    batched = materialize(docs.withColumn("batch", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")), "ngram-batches")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("batch").to_numpy()
            for k in np.unique(of):
                for lang, _, texts in _by_lang(b.filter(pa.array(of == k))):
                    g = np.unique(text_grams(texts)[0]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array([lang] * len(g), pa.string()), pa.array(g)], names=["batch", "lang", "g"])

    asked = batched.select("batch", "lang", "text").mapInArrow(ask, "batch int, lang string, g long").distinct()
    value = F.lit(None).cast("double")
    back, got, now = F.lit(0.0), asked, F.col("g")
    for k in range(ORDER, 0, -1):
        one = model.where(F.col("kind") == k).select(F.col("lang").alias("l"), F.col("key").alias("k"), F.col("value").alias(f"p{k}"))
        got = got.withColumn("now", now).join(one, F.col("lang").eqNullSafe(F.col("l")) & (F.col("now") == F.col("k")), "left").drop("l", "k", "now")
        value = F.coalesce(value, back + F.col(f"p{k}"))
        if k > 1:
            one = model.where(F.col("kind") == -k).select(F.col("lang").alias("l"), F.col("key").alias("k"), F.col("value").alias(f"b{k}"))
            got = got.withColumn("now", F.shiftrightunsigned(now, UNIT)).join(one, F.col("lang").eqNullSafe(F.col("l")) & (F.col("now") == F.col("k")), "left").drop("l", "k", "now")
            back = back + F.coalesce(f"b{k}", F.lit(0.0))
            now = F.col("g").bitwiseAND(F.lit((1 << (UNIT * (k - 1))) - 1))
    none = model.where("kind = 0").select(F.col("lang").alias("l"), F.col("value").alias("p0"))
    got = got.join(none, F.col("lang").eqNullSafe(F.col("l"))).select("batch", "lang", "g", F.coalesce(value, back + F.col("p0")).alias("value"))

    def score(docs_: pa.Table, entries: pa.Table) -> pa.Table:
        lang = entries["lang"].to_pylist()
        m = arrays(lang, np.full(len(lang), ORDER, np.int32), entries["g"].to_numpy(), entries["value"].to_numpy())
        m |= {(x, 0): (np.zeros(1, np.uint64), np.zeros(1)) for x, _ in list(m)}
        return pa.Table.from_batches([emit(b, m) for b in docs_.combine_chunks().to_batches()] or [], schema=pa.schema([("id", docs_.schema.field("id").type), ("lang", pa.string()), ("nll", pa.float64()), ("n_chars", pa.int64())]))

    return batched.groupBy("batch").cogroup(got.groupBy("batch")).applyInArrow(score, schema)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR) -> list:
    """(lang, mean, threshold) of each language, as rows: of held-out trusted documents, nats a character."""
    known = scored.where("n_chars > 0 and nll is not null")
    mean = known.groupBy("lang").agg((F.sum("nll") / F.sum("n_chars")).alias("mean"))
    drawn = known.join(mean.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).withColumn("score", (F.col("nll") + prior * F.col("mean")) / (F.col("n_chars") + prior))
    middle, high = F.col("q")[0], F.col("q")[1]
    threshold = middle + SPREADS * (high - middle) + math.log(margin) / F.sqrt("n")
    return drawn.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx("score", [0.5, quantile], 10_000).alias("q"), F.count("*").alias("n")).select("lang", "mean", threshold.alias("threshold")).collect()


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, sent_rows: int = SENT_ROWS, sent_ids: int = SENT_IDS) -> tuple[DataFrame, dict]:
    """The model, and (mean, threshold) by language. ``docs`` has id, lang and text; ``labels`` doc_id and quality (1: trusted)."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    few = materialize(good, "trusted-ids")
    good = F.broadcast(few) if few.count() <= sent_ids else few.hint("merge")
    trusted = docs.join(good, "id", "left_semi")
    held = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) == 0
    model = train(trusted.where(~held))
    levels = thresholds(_scored(trusted.where(held), model, sent_rows), quantile, margin)
    return model, {r.lang: (r.mean, r.threshold) for r in levels}


def needed(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sent_rows: int = SENT_ROWS, sent_ids: int = SENT_IDS) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, score, threshold, kept) of every row."""
    prepare(docs.sparkSession)
    rows = needed(docs, doc_id, text, lang)
    model, levels = fit(rows, labels, sent_rows=sent_rows, sent_ids=sent_ids)
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in levels.items()], "l string, mean double, threshold double")
    scored = _scored(rows, model, sent_rows).join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("l")), "left")  # a row a language
    score = (F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_chars") + PRIOR)
    ppl = F.when(F.col("n_chars") > 0, F.exp(F.col("nll") / F.col("n_chars")))
    return scored.select(F.col("id").alias("doc_id"), "lang", "n_chars", ppl.alias("perplexity"), score.alias("score"), "threshold", F.coalesce(score <= F.col("threshold"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sent_rows: int = SENT_ROWS, sent_ids: int = SENT_IDS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged. A model too large to send decides by id and text instead of in place."""
    spark = docs.sparkSession
    prepare(spark)
    rows = needed(docs, doc_id, text, lang)
    model, levels = fit(rows, labels, sent_rows=sent_rows, sent_ids=sent_ids)
    if model.count() > sent_rows:
        row = unused(docs, "row")
        marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "quality-rows")
        scored = _scored(needed(marked, row, text, lang), model, sent_rows)
        known = spark.createDataFrame([(k, *v) for k, v in levels.items()], "l string, mean double, threshold double")
        scored = scored.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("l")), "left")
        bad = scored.where((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_chars") + PRIOR) > F.col("threshold")).select(F.col("id").alias(row))
        return marked.join(bad, row, "left_anti").select(*docs.columns)
    t = model.toArrow()
    sent = spark.sparkContext.broadcast((arrays(t["lang"].to_pylist(), t["kind"].to_numpy(), t["key"].to_numpy(), t["value"].to_numpy()), levels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, limit = sent.value
        for b in batches:
            some = pa.RecordBatch.from_arrays([b.column(names.index(lang)).fill_null(""), b.column(names.index(text))], names=["lang", "text"])
            nll, n = _score_batch(some, m)
            mean, most = (np.array([limit.get(x, (0.0, np.inf))[k] for x in some.column(0).to_pylist()]) for k in (0, 1))
            yield b.filter(pa.array(~((nll + PRIOR * mean) / (n + PRIOR) > most)))

    return docs.mapInArrow(run, docs.schema)
