"""Operator 4: mixing sources to target weights.

Every row gets a hash-random key of its id and its text. Rows are ordered by key within their source, sizes are summed along that
order, and each source is cut at its exact budget. A budget beyond the source's size repeats whole epochs and cuts in the last one.

The prefix sums are distributed: keys are uniform, so ranges of the key split even a source that holds a third of all rows into
ranges of about ``RANGE_ROWS`` rows. Ranges are summed first (partial sums before the shuffle), then summed along each source; only
the range that a source's cut falls into is sorted row by row. What is before the cut or behind it follows from the key alone, so
the mix needs no more than a row per source: documents are taken in place, and no text is shuffled. Rows that agree in id, source and
text have one key and are one entry of as many copies, so a row that is repeated a billion times is one row of every sum.

Sources are in order of code points, null last, and weights repeat along that order. Their shares of the budget stop at
``CAP`` times the source's size; what that leaves over goes to the others by weight, until none is above. All sums are of integers, so
reruns and other engines give the same doubles.

Defined results: a null or empty text has size 0 and takes 0 words. A null source is a source of its own. A null id counts as "-". Repeated rows count
and are taken like any other; which of the copies at a cut takes more does not matter, they are equal. An empty table gives an empty result. Only the id, text and source are
read; columns of any other name pass through :func:`mixed_documents`, but for rows that agree in id, source and text and stand at a source's cut: there one row's stand for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, n_words, running, unused

WEIGHTS = (3, 1, 2)
#: The mix has this share of all words: numerator and denominator.
SHARE = (3, 2)
#: Times its size that a source may be taken.
CAP = 2
RANGE_ROWS = 8_000
MAX_RANGES = 1 << 20
#: So many sources are broadcast at most (about 150 bytes each); more are joined by a shuffle.
SENT_SOURCES = 200_000
#: Copies that one step of an explode makes.
COPIES = 1_000
#: A character of a word, and a word with what breaks words before it.
_WORD = r"[^\x20\x09-\x0D]"
_HEAD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size): one row a source.

    Sources are capped in order of cap * size / weight, as long as that ratio is not above what the rest would get.
    """
    up, down = share
    totals = totals.select("source", F.col("source_size").cast("long").alias("source_size"))
    placed = running(totals, [F.col("source").asc_nulls_last()], {"k": F.lit(1)})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.withColumn("w", w)
    levels = running(weighed, [F.col("source_size") / F.col("w"), F.col("k")], {"size_before": F.col("source_size"), "w_before": F.col("w")})
    size_all, w_all = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left = F.lit(up * size_all) - F.lit(down * cap) * F.col("size_before")
    wl = F.lit(w_all) - F.col("w_before")
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    # capped: cap * size / w <= left / (down * wl)
    free = wide(F.lit(cap * down) * F.col("source_size"), 19) * wide(wl, 18) > wide(left, 19) * wide(F.col("w"), 18)
    levels = levels.select("source", "source_size", "w", left.alias("left"), wl.alias("wl"), free.alias("free"))
    first = levels.where("free").agg(F.max(F.struct("wl", "left")).alias("x")).first()[0]  # of the free ones the first has the largest weight left
    rate = float(first.left) / float(down * first.wl) if first else 0.0
    target = F.when(F.col("free"), F.col("w").cast("double") * F.lit(rate)).otherwise((F.lit(cap) * F.col("source_size")).cast("double"))
    return levels.select("source", "source_size", target.alias("target")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def key_of(doc_id: Column, text: Column, seed: int = 7) -> Column:
    """Thirty-two hex digits; rows of equal id and text have equal keys."""
    own = F.coalesce(F.md5(text.cast("binary")), F.lit("-"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), own).cast("binary"))


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, key): what the mix needs of a row; one scan without the shuffle of any text."""
    key = key_of(F.col(doc_id), F.col(text), seed)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("key"))


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source of ``rows`` (doc_id, source, size, key), a written table: source, source_size, target, epochs, and the entry at its cut: cut (its key; null if
    none is taken in part), cut_id, cut_size, n (rows that are that entry) and into (words of the last epoch that the n rows take together)."""
    count, n = rows.count(), 1
    while n * RANGE_ROWS < count and n < MAX_RANGES:
        n *= 2
    # the first eight hex digits of the key, scaled to n ranges: ordered like the key
    of = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")
    ranges = materialize(rows.groupBy("source", of.alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("budget") / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("epochs", epochs).withColumn("rest", F.when(size > 0, F.col("budget") - F.col("epochs") * size).otherwise(0)).drop("budget"), "mix-plan")
    sent = lambda d: F.broadcast(d) if plan.count() <= SENT_SOURCES else d.hint("merge")
    by = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("source", "range", "words", F.coalesce(F.sum("words").over(by), F.lit(0)).alias("before"))
    met = starts.join(sent(plan.select(F.col("source").alias("s"), "rest")), same("source", "s"))
    inside = met.where((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("words"))).select("s", F.col("range").alias("r"), (F.col("rest") - F.col("before")).alias("more"))
    inside = materialize(inside, "mix-cut-ranges")  # a range a source
    near = rows.withColumn("range", of).join(sent(inside), same("source", "s") & (F.col("range") == F.col("r")))
    entries = near.groupBy("source", "key", "doc_id", "size", "more").agg(F.count("*").alias("n"))
    along = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    entries = entries.withColumn("into", F.col("more") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(along), F.lit(0)))
    at = entries.where((F.col("into") > 0) & (F.col("into") <= F.col("size") * F.col("n"))).select(F.col("source").alias("s"), F.col("key").alias("cut"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), "n", "into")
    return materialize(plan.join(sent(at), same("source", "s"), "left").drop("s", "rest"), "mix-cuts")


def with_cut(rows: DataFrame, cut: DataFrame, source: str, prefix: str) -> DataFrame:
    """``rows`` beside what :func:`cuts` says of their source, in columns that begin with ``prefix``."""
    told = cut.select(*[F.col(c).alias(prefix + c) for c in cut.columns])
    told = F.broadcast(told) if cut.count() <= SENT_SOURCES else told.hint("merge")
    return rows.join(told, F.col(source).eqNullSafe(F.col(prefix + "source")))


def spread(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, whatever that is: by steps of ``COPIES``, so no array is long."""
    step, some = unused(rows, "step"), unused(rows, "some")
    steps = F.when(F.col(times) > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))).otherwise(F.array().cast("array<bigint>"))
    each = rows.withColumn(step, F.explode(steps)).withColumn(some, F.least(F.lit(COPIES), F.col(times) - F.col(step) * COPIES).cast("int"))
    return each.withColumn(some, F.explode(F.array_repeat(F.lit(0), F.col(some)))).drop(step, some)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken) per row."""
    rows = materialize(sizes(docs, doc_id, text, source, seed), "mix-sizes")
    return take(rows, cuts(rows, weights, share, cap))


def take(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of :func:`sizes` with source_size, target and taken. Rows that are the entry at a cut are equal, so they are made from the entry: whole ones, one in part, and the rest."""
    out = ["doc_id", "source", "size", "key", "source_size", "target", "taken"]
    met = with_cut(rows, cut, "source", "c_").withColumnsRenamed({"c_source_size": "source_size", "c_target": "target"})
    clear = met.where(F.col("c_cut").isNull() | (F.col("key") != F.col("c_cut")))
    taken = (F.col("c_epochs") + F.coalesce(F.col("key") < F.col("c_cut"), F.lit(False)).cast("long")) * F.col("size")
    at = cut.where("cut is not null").withColumn("whole", F.floor(F.col("into") / F.col("cut_size"))).withColumn("part", F.col("into") % F.col("cut_size"))
    some = (F.col("part") > 0).cast("long")
    kinds = F.array(
        F.struct(F.col("cut_size").alias("last"), F.col("whole").alias("times")), F.struct(F.col("part").alias("last"), some.alias("times")), F.struct(F.lit(0).cast("long").alias("last"), (F.col("n") - F.col("whole") - some).alias("times")),
    )
    made = spread(at.select(F.col("cut_id").alias("doc_id"), "source", F.col("cut_size").alias("size"), F.col("cut").alias("key"), "source_size", "target", "epochs", F.inline(kinds)), "times")
    return clear.withColumn("taken", taken).select(*out).unionByName(made.withColumn("taken", F.col("epochs") * F.col("size") + F.col("last")).select(*out))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The mix itself, columns of ``docs``: a row for each time a document is taken; at a source's cut the text ends where the budget does."""
    cut = cuts(materialize(sizes(docs, doc_id, text, source, seed), "mix-sizes"), weights, share, cap)
    key, p = unused(docs, "key"), unused(docs, "cut") + "_"
    words = unused(docs, "words")
    met = with_cut(docs.withColumn(key, key_of(F.col(doc_id), F.col(text), seed)), cut, source, p)
    here = F.coalesce(F.col(key) == F.col(p + "cut"), F.lit(False))
    full = F.col(p + "epochs") + F.coalesce(F.col(key) < F.col(p + "cut"), F.lit(False)).cast("long")
    # a text without words is taken as often as any other of its source, but adds nothing: leave it out
    clear = spread(met.where(~here & F.col(text).rlike(_WORD)).withColumn(words, full), words).select(*docs.columns)
    whole, part = F.col(p + "epochs") * F.col(p + "n") + F.floor(F.col(p + "into") / F.col(p + "cut_size")), F.col(p + "into") % F.col(p + "cut_size")
    one = met.where(here).dropDuplicates([key, p + "source"])  # a row a source
    one = one.withColumn(words, F.explode(F.array(F.struct(F.lit(0).alias("end"), whole.cast("long").alias("times")), F.struct(part.cast("int").alias("end"), (part > 0).cast("long").alias("times")))))
    end, times = unused(one, "end"), unused(one, "times")
    one = spread(one.withColumns({end: F.col(words)["end"], times: F.col(words)["times"]}), times)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(_HEAD), F.lit(0)), F.lit(1), F.col(end)), "")
    return clear.unionByName(one.withColumn(text, F.when(F.col(end) > 0, head).otherwise(F.col(text))).select(*docs.columns))
