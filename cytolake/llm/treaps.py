"""Operator 12: ranked search over inverted treaps.

Documents are dealt, where they are read, to shards of about ``SHARD`` bytes. A shard's index is one row: for each term the documents that hold it, in the order of their ids, as a treap: a search tree
by document and a heap by impact, which is what one occurrence weight's worth of the term adds to the document's score. Equal impacts are ordered by a hash, so no treap is deep. The index is written;
postings are never shuffled, and a term or a source in a third of all documents is dealt out like any other.

A query walks the treaps of all its terms at once. A state is a range of documents with, for each term, the root of the treap within the range, whose impact is the term's greatest there. The sum of these
maxima bounds every score in the range: a range whose bound cannot enter the ``k`` best is dropped with all its subtrees; else the document of the greatest part is scored and the range is cut there in two.
States wait in the order of their bounds and are taken in batches, in numpy. Every query begins with the ``k``-th best score of the first shards (one in ``SEED``), a bound that the other shards have to reach.

Queries go in blocks of about ``BLOCK`` bytes of text, so the driver and the executors hold a bounded number of them at a time. For as long as the text of all queries is below ``ASKED`` bytes the index
leaves out all terms that none of them asks for; beyond that it holds all terms, with equal results.

Scores are integers (see :func:`top_documents`); equal ones rank by ascending document id, null ids last.

Defined results: null and empty texts hold no term and are never found; a query without terms finds nothing. Repeated documents are ranked each. Repeated queries (equal id and text) count once; different
texts under one id are queries of their own. Empty tables give an empty result. Only ids and texts are read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare, shards

TOP = 20
SHARD, BLOCK, ASKED = 32 << 20, 8 << 20, 64 << 20
SEED = 16
#: States that are taken at a time.
BATCH = 1024
#: Tasks that an item's best of a shard are first cut in.
FIRST_CUT = 64

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII letters in lower case, digits, and all bytes of other characters; anything else parts terms.
_FOLD = bytes(b | 0x20 if chr(b).isascii() and chr(b).isalpha() else b if b > 0x7F or chr(b).isdigit() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


# -- one shard -------------------------------------------------------------------------------------------------------


def _greater(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The nearest place on one side (-1 or +1) with a greater rank, in the same treap; -1 if none. Pointers jump along each other, which keeps all that they pass smaller."""
    n = len(rank)
    near = np.arange(n) + step
    near[(near < 0) | (near >= n)] = -1
    near[(near >= 0) & (at[near] != at)] = -1
    todo = np.flatnonzero((near >= 0) & (rank[near] < rank))
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[(near[todo] >= 0) & (rank[near[todo]] < rank[todo])]
    return near


def treaps(term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, root) of one treap a term over postings in the order of (term, doc): children by place, -1 for none, and whether a place is a root."""
    n = len(term)
    rank = impact << 32 | (doc * 0x9E3779B1 & 0xFFFFFFFF)  # an odd factor: different documents differ
    before, behind = _greater(rank, term, -1), _greater(rank, term, 1)
    place = np.arange(n)
    to_before = (before >= 0) & ((behind < 0) | (rank[before] < rank[behind]))
    to_behind = (behind >= 0) & ~to_before
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    right[before[to_before]] = place[to_before]
    left[behind[to_behind]] = place[to_behind]
    return left, right, ~(to_before | to_behind)


INDEX = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), *((c, pa.list_(pa.int32())) for c in ("doc", "impact", "left", "right"))])


def index_shard(shard: int, ids: list, texts: list[str | None], n_docs: int, n_terms: int, asked: set[bytes] | None) -> dict:
    """The row of one shard."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
    number: dict[bytes, int] = {}
    term, doc, tf, m = [], [], [], np.zeros(len(ids), np.int64)
    for d, k in enumerate(order):
        found = terms(texts[k])
        m[d] = 100 - 25 + 25 * len(found) * n_docs // max(n_terms, 1)
        counts = Counter(found)
        for t in counts if asked is None else counts.keys() & asked:
            term.append(number.setdefault(t, len(number)))
            doc.append(d)
            tf.append(counts[t])
    term, doc, tf = np.array(term, np.int64), np.array(doc, np.int64), np.array(tf, np.int64)
    sort = np.argsort(term * len(ids) + doc, kind="stable")
    term, doc, tf = term[sort], doc[sort], tf[sort]
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    left, right, _ = treaps(term, doc, impact)
    return {"shard": shard, "docs": [ids[k] for k in order], "terms": list(number), "counts": np.bincount(term, minlength=len(number)).astype(np.int32), "doc": doc.astype(np.int32), "impact": impact.astype(np.int32), "left": left, "right": right}


class Shard:
    """A shard's index, ready for queries."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        counts = np.asarray(row["counts"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.number = {t: k for k, t in enumerate(row["terms"])}
        # a last place stands for "none": without impact and beyond all documents
        self.doc = np.append(np.asarray(row["doc"], np.int64), len(self.docs))
        self.impact = np.append(np.asarray(row["impact"], np.int64), 0)
        none = len(self.doc) - 1
        self.left, self.right = (np.append(np.where((x := np.asarray(row[c], np.int64)) < 0, none, x), none) for c in ("left", "right"))
        child = np.zeros(none + 1, bool)
        child[self.left] = child[self.right] = True
        child[none] = True
        self.root = np.flatnonzero(~child)  # one a term, in the order of the terms
        self.key = np.repeat(np.arange(len(counts)), counts) * (len(self.docs) + 1) + self.doc[:-1]

    def settle(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each place (states by terms) down to the first that lies within the state's range."""
        none = len(self.doc) - 1
        flat = at.ravel().copy()
        low, high = np.repeat(low, at.shape[1]), np.repeat(high, at.shape[1])
        todo = np.flatnonzero(flat != none)
        while len(todo):
            p = flat[todo]
            d = self.doc[p]
            down, up = d < low[todo], d > high[todo]
            go = down | up
            todo, p, down = todo[go], p[go], down[go]
            p = np.where(down, self.right[p], self.left[p])
            flat[todo] = p
            todo = todo[p != none]
        return flat.reshape(at.shape)

    def best(self, query: list[tuple[bytes, int]], k: int, least: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, document's place) of score ``least`` or more; ``query`` has terms and weights."""
        there = [(self.number[t], w) for t, w in query if t in self.number and w > 0]
        if not there:
            return []
        number, weight = np.array([x for x, _ in there]), np.array([w for _, w in there], np.int64)
        base = number * (len(self.docs) + 1)
        ats = self.root[number][None, :]
        lows, highs = np.zeros(1, np.int64), np.full(1, len(self.docs) - 1)
        bounds = self.impact[ats] @ weight
        score, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(least, 1)
        waiting = [(-int(bounds[0]), 0, (ats, lows, highs, bounds))]
        made = 1
        none = len(self.doc) - 1
        while waiting:
            # the batches of the greatest bounds; together about BATCH states
            taken, n = [], 0
            while waiting and n < BATCH:
                taken.append(heapq.heappop(waiting)[2])
                n += len(taken[-1][1])
            ats, lows, highs, bounds = (np.concatenate([x[j] for x in taken]) for j in range(4))
            full = len(score) >= k
            floor = score[-1] if full else least
            live = bounds > floor if full else bounds >= floor
            if full:
                live |= (bounds == floor) & (lows < place[-1])  # an equal score of a smaller id still enters
            if not live.all():
                ats, lows, highs, bounds = ats[live], lows[live], highs[live], bounds[live]
            if not len(lows):
                continue
            part = self.impact[ats] * weight
            cut = self.doc[ats[np.arange(len(ats)), part.argmax(axis=1)]]
            # the cut document's score, read from each term's postings
            want = base + cut[:, None]
            found = np.minimum(np.searchsorted(self.key, want), none - 1)
            got = np.where(self.key[found] == want, self.impact[found], 0) @ weight
            good = got >= floor
            if good.any():
                score, place = np.concatenate([score, got[good]]), np.concatenate([place, cut[good]])
                order = np.lexsort((place, -score))[:k]
                score, place = score[order], place[order]
            # both sides of the cut
            ats = np.concatenate([ats, ats])
            lows, highs = np.concatenate([lows, cut + 1]), np.concatenate([cut - 1, highs])
            some = lows <= highs
            ats, lows, highs = ats[some], lows[some], highs[some]
            ats = self.settle(ats, lows, highs)
            bounds = self.impact[ats] @ weight
            floor = score[-1] if len(score) >= k else least
            some = bounds >= floor
            ats, lows, highs, bounds = ats[some], lows[some], highs[some], bounds[some]
            order = np.argsort(-bounds, kind="stable")
            for a in range(0, len(order), BATCH // 4):
                o = order[a : a + BATCH // 4]
                heapq.heappush(waiting, (-int(bounds[o[0]]), made, (ats[o], lows[o], highs[o], bounds[o])))
                made += 1
        return list(zip(score.tolist(), place.tolist(), strict=True))


# -- all shards ------------------------------------------------------------------------------------------------------


def build(docs: DataFrame, asked: set[bytes] | None = None, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index, a written table, and the number of documents with a term. ``asked``, if given, limits it to these terms."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = rows.select(F.coalesce(F.regexp_count("text", F.lit(TERM_PATTERN)), F.lit(0)).cast("long").alias("n"))
    n_docs, n_terms = size.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = docs.sparkSession.sparkContext.broadcast(asked)
    kind = pa.schema([INDEX.field(k) if INDEX.names[k] != "docs" else pa.field("docs", pa.list_(_arrow(rows))) for k in range(len(INDEX))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = index_shard(number, ids, texts, n_docs, n_terms, sent.value)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kind.field(c).type) for c in kind.names], schema=kind)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                if size >= shard:
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"shard long, docs array<{id_type}>, terms array<binary>, counts array<int>, doc array<int>, impact array<int>, left array<int>, right array<int>"
    return materialize(rows.mapInArrow(run, schema), "treaps"), n_docs


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def weights(index: DataFrame, n_docs: int, wanted: DataFrame) -> DataFrame:
    """(term, w) of the wanted terms that the index holds."""
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = each.groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return df.join(wanted.select("term").distinct(), "term", "left_semi").select("term", w.alias("w"))


def search(index: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], k: int, seed: int = SEED) -> DataFrame:
    """(query, doc_id, score): the best of each shard, among them the ``k`` best of all; ``queries`` (a bounded block) have terms and weights."""
    spark = index.sparkSession
    id_type = index.schema["docs"].dataType.elementType
    schema = f"query long, doc_id {id_type.simpleString()}, score long"

    def over(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        sent = spark.sparkContext.broadcast((queries, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, floor = sent.value
            for b in batches:
                for at in range(b.num_rows):
                    one = b.slice(at, 1)
                    row = {c: one.column(c)[0].values for c in one.schema.names if c != "shard"}
                    docs = row["docs"]
                    shard = Shard({c: x.to_pylist() if c == "terms" else x.to_numpy(zero_copy_only=False) for c, x in row.items()})
                    number, place, score = [], [], []
                    for q, query in asked:
                        for s, p in shard.best(query, k, floor.get(q, 1)):
                            number.append(q)
                            place.append(p)
                            score.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), docs.take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

        return rows.mapInArrow(run, schema)

    part = F.pmod(F.xxhash64("shard"), F.lit(seed))
    first = materialize(over(index.where(part == 0), {}), "treaps-first")
    kth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    least = {r.query: r.score for r in first.withColumn("n", kth).where(F.col("n") == k).select("query", "score").collect()}  # a row a query
    return first.unionByName(over(index.where(part != 0), least))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their ranks; cut by parts of a query's rows first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_CUT)))
    some = some.withColumn("n", F.row_number().over(W.partitionBy("query", "cut").orderBy(*order))).where(F.col("n") <= k).drop("cut", "n")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK, asked: int = ASKED, seed: int = SEED
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents.

    With N documents that have a term, L terms in all, n terms of a document, df documents of a term and tf occurrences in a document: a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); a document's
    m is 75 + (25 n N) div L; a score is the sum of w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    rows = materialize(rows.withColumn("query", F.monotonically_increasing_id()), "treap-queries")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kind = rows.schema["item"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(q, t, n) for q, x in zip(b.column("query").to_pylist(), b.column("text").to_pylist(), strict=True) for t, n in Counter(terms(x)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())], names=["query", "term", "times"])

    wanted = materialize(rows.mapInArrow(split, "query long, term binary, times long"), "treap-terms")
    only = {bytes(r.term) for r in wanted.select("term").distinct().collect()} if size <= asked else None  # no more bytes than the queries' text
    index, n_docs = build(docs, only, doc_id, text, shard)
    weighed = wanted.join(weights(index, n_docs, wanted), "term").where("w > 0")
    blocks = shards(size, block)
    weighed = materialize(weighed.select("query", "term", (F.col("w") * F.col("times")).alias("w"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")), "treap-weights")
    found = None
    for b in range(blocks):
        of: dict[int, list[tuple[bytes, int]]] = {}
        for r in weighed.where(F.col("block") == b).collect():
            of.setdefault(r["query"], []).append((bytes(r.term), r.w))
        one = search(index, sorted(of.items()), k, seed)
        one = materialize(ranked(one, k), "treap-found") if blocks > 1 else ranked(one, k)
        found = one if found is None else found.unionByName(one)
    return found.join(rows.select("query", F.col("item").alias("item_id")), "query").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
