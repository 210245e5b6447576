"""Operator 13: how far the sources of a language differ in their words.

Two passes over the texts, which are dealt to blocks of about ``BLOCK`` bytes of one language and source. The first counts, block by block, in how many documents each term
stands; sums over the blocks of a language leave the kept terms, those in at least ``LEAST`` documents. The second hands each block the kept terms that it holds itself, builds
an Aho-Corasick automaton of them, each between delimiters, and recounts their occurrences in the block's texts, whose other characters are delimiters. A task holds one block and
its terms at a time, whatever the size of the vocabulary; nothing is broadcast.

The counts are sparse postings (group, term, n). A pair of sources is summed over all kept terms from three sparse parts: the terms that only one of the two has follow from how often each
count occurs in a group, those that both have are met term by term (all sources of a term are in one task, in numpy), and the terms that neither has are equal.

All arithmetic is exact in 64 bits: shares are divided in three steps of a factor 1000, so counts may go up to 9 * 10^15.

Defined results: null texts, languages and sources are read as empty. Repeated rows are documents of their own. A group without kept terms takes part in all pairs; a
language without kept terms has pairs of value 0. An empty table gives an empty result. Only the id (to deal rows to blocks), text, language and source are read.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare, shards

LEAST, TOP = 3, 200
#: Bytes of text of a block, about, and postings of a task that meets sources.
BLOCK, POSTINGS = 8 << 20, 200_000
#: So many pairs of postings are held at a time.
HELD = 1 << 21
_SUB = 1 << 24

#: Letters of ASCII in lower case and all bytes of other characters; anything else is a delimiter.
_FOLD = bytes(b | 0x20 if chr(b).isascii() and chr(b).isalpha() else b if b > 0x7F else 0x20 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return folded(text).split()


def _strings(x: list[bytes]) -> pa.Array:
    return pa.array(x, pa.binary()).cast(pa.string())


def _term_documents(rows: pa.Table) -> pa.Table:
    """Of one block: in how many of its documents each term stands."""
    found: Counter = Counter()
    for t in rows["text"]:
        found.update(set(terms(t.as_py())))
    n = len(found)
    return pa.table({"block": pa.repeat(rows["block"][0], n), "lid": pa.repeat(rows["lid"][0], n), "term": _strings(list(found)), "n": pa.array(list(found.values()), pa.int32())})


def automaton(kept: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, t in enumerate(kept):
        a.add_word(f" {t} ", k)
    a.make_automaton()
    return a


def recount(texts: list[str | None], kept: list[str]) -> np.ndarray:
    """Occurrences of each kept term in all texts."""
    n = np.zeros(len(kept), np.int64)
    if kept:
        find = automaton(kept).iter
        for t in texts:
            n += np.bincount(np.fromiter((k for _, k in find(f" {folded(t).decode('utf-8', 'surrogatepass')} ")), np.int64), minlength=len(kept))
    return n


def _block_counts(rows: pa.Table, kept: pa.Table) -> pa.Table:
    if not rows.num_rows or not kept.num_rows:
        return pa.table({"gid": pa.array([], pa.int32()), "lid": pa.array([], pa.int32()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    n = recount([t.as_py() for t in rows["text"]], kept["term"].to_pylist())
    gid, lid = (pa.repeat(rows[c][0], len(n)) for c in ("gid", "lid"))
    return pa.table({"gid": gid, "lid": lid, "term": kept["term"].combine_chunks(), "n": pa.array(n)})


def share(count: str, of: str) -> str:
    """SQL of 1 + floor(10^9 * (count + 1) / of) for count < of, without overflow."""
    d = f"greatest({of}, 1L)"
    r1 = f"(({count} + 1L) * 1000L % {d})"
    r2 = f"({r1} * 1000L % {d})"
    return f"1L + (({count} + 1L) * 1000L div {d}) * 1000000L + ({r1} * 1000L div {d}) * 1000L + {r2} * 1000L div {d}"


def excess(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def met(gid: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, sum) over the terms that two groups both have: what the pair has there, less what the sums over either group's terms take it to have. ``p0`` is a group's share of
    a term that it lacks. Pairs are made in pieces of about ``held`` and added up before the next."""
    order = np.argsort(term, kind="stable")
    gid, term, p, p0 = gid[order], term[order], p[order], p0[order]
    first = np.searchsorted(term, term, "left")
    many = np.searchsorted(term, term, "right") - first
    names, code = np.unique(gid, return_inverse=True)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(many)
    at = 0
    while at < len(gid):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + held, "right")))
        m = many[at:to]
        a = np.repeat(np.arange(at, to), m)
        b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + first[a]
        a, b = a[code[a] != code[b]], b[code[a] != code[b]]
        v = _excess(p[a], p[b]) - _excess(p[a], p0[b]) - _excess(p0[a], p[b]) + _excess(p0[a], p0[b])
        keys, back = np.unique(np.concatenate([keys, code[a] * len(names) + code[b]]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.concatenate([sums, v]))
        sums, at = total, to
    return names[keys // max(len(names), 1)], names[keys % max(len(names), 1)], sums


def _met(rows: pa.Table) -> pa.Table:
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    g, h, v = met(*(x.to_numpy() if x is not term else x for x in (rows["gid"], term, rows["p"], rows["p0"])))
    return pa.table({"gid": pa.array(g, pa.int32()), "hid": pa.array(h, pa.int32()), "v": pa.array(v, pa.int64())})


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(gid, lid, lang, source) of the groups, and (gid, lid, term, n) of the kept terms that each group has; written tables."""
    prepare(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("spread"))
    groups = rows.groupBy("lang", "source").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    in_order = W.orderBy("lang", "source")  # a row a group; the result has a row for each pair of them
    groups = materialize(groups.select("lang", "source", F.row_number().over(in_order).alias("gid"), F.dense_rank().over(W.orderBy("lang")).alias("lid"), F.ceil((F.col("bytes") + 1) / block).alias("parts")), "audit-groups")
    dealt = rows.join(groups, ["lang", "source"])
    dealt = dealt.select("gid", "lid", "text", (F.col("gid").cast("long") * _SUB + F.pmod("spread", F.least("parts", F.lit(_SUB)))).alias("block"))
    found = dealt.groupBy("block").applyInArrow(_term_documents, "block long, lid int, term string, n int")
    kept = found.withColumn("df", F.sum("n").over(W.partitionBy("lid", "term"))).where(F.col("df") >= least).select("block", "term")
    counts = dealt.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_block_counts, "gid int, lid int, term string, n long")
    return groups, materialize(counts.groupBy("gid", "lid", "term").agg(F.sum("n").alias("n")), "audit-postings")


def audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK, per_task: int = POSTINGS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that a group has beyond its language's share."""
    groups, have = postings(docs, doc_id, text, lang, source, least, block)
    total = have.groupBy("lid", "term").agg(F.sum("n").alias("n"))
    of_lang = total.groupBy("lid").agg(F.sum("n").alias("all_n"), F.count("*").alias("v"))
    of_group = have.groupBy("gid").agg(F.sum("n").alias("own_n"), F.count("*").alias("k"))
    none = F.lit(0).cast("long")
    stats = groups.join(of_group, "gid", "left").join(of_lang, "lid", "left")
    stats = stats.select("gid", "lid", "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("own_n", "k", "all_n", "v")])
    stats = materialize(stats.withColumn("p0", F.expr(share("0L", "own_n + v"))), "audit-stats")
    few = stats.select("gid", "own_n", "all_n", "v", "p0")
    with_p = have.join(few, "gid").withColumn("p", F.expr(share("n", "own_n + v")))

    tasks = shards(have.count(), per_task)
    both = with_p.select("lid", "gid", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(tasks)).alias("deal"))
    both = both.groupBy("lid", "deal").applyInArrow(_met, "gid int, hid int, v long").groupBy("gid", "hid").agg(F.sum("v").alias("both"))

    other = stats.select("lid", F.col("gid").alias("hid"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("k").alias("hk"))
    often = with_p.groupBy("gid", "lid", "p").agg(F.count("*").alias("times")).join(other, "lid").where("gid <> hid")  # a group's different counts by the groups of its language
    often = often.groupBy("gid", "hid").agg(F.sum(F.expr(f"times * {excess('p', 'q0')}")).alias("mine"), F.sum(F.expr(f"times * {excess('q0', 'p')}")).alias("theirs"))
    often = materialize(often, "audit-single")
    pairs = stats.join(other, "lid").where("gid <> hid").join(both, ["gid", "hid"], "left").join(often.select("gid", "hid", "mine"), ["gid", "hid"], "left")
    pairs = pairs.join(often.select(F.col("gid").alias("hid"), F.col("hid").alias("gid"), "theirs"), ["gid", "hid"], "left")
    value = sum(F.coalesce(c, none) for c in ("both", "mine", "theirs")) + F.expr(f"(v - k - hk) * {excess('p0', 'q0')}")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, value).otherwise(none).alias("value"))

    shared = with_p.withColumn("total", F.sum("n").over(W.partitionBy("lid", "term"))).withColumn("q", F.expr(share("total", "all_n + v")))
    shared = shared.where("p > q").select("gid", F.col("term").alias("item"), F.expr(excess("p", "q")).alias("value"))
    best = shared.withColumn("rank", F.row_number().over(W.partitionBy("gid").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    best = best.join(stats.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(best)
