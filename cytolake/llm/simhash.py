"""Operator 3: near-duplicates by SimHash, linked through a Gray-order hierarchical index.

1. Fingerprints: one scan. Equal fingerprints collapse to one vertex, so copies cost nothing further.
2. Candidate groups: two 64-bit fingerprints with at most ``d`` differing bits agree on at least one of ``d + 1`` bit
   blocks. Each vertex goes to one group for each block; a group's upper node is the bit pattern that its members share.
   A group of over ``GROUP`` vertices is divided again over the bits that its pattern leaves free, by the same argument, so
   the groups stay small however many near copies exist: once 51 bits are fixed only 8192 fingerprints remain.
3. In a group, fingerprints are sorted by Gray rank. Runs of neighbours share masked bits, which are factored into nodes, and
   runs of nodes into upper nodes. A search adds up the differences on a node's shared bits and prunes the whole subtree
   beyond ``d``. Links found become a spanning forest of the group, as chains, so no vertex gains many edges.
4. Components: random contraction over all groups' edges (each round every vertex joins the neighbour of least hash), with
   each round written to the shared folder. Once few edges are left (``LAST_EDGES``), one task ends it.

Defined results: a null, empty or blank text has fingerprint zero and links like any other. Repeated rows and equal ids give a
row each. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare, unused

BITS, MAX_DIFF, SEED, WIDTH = 64, 2, 42, 3
#: A larger group of candidates is divided by further bits.
GROUP = 4096
#: So few edges are joined up in one task.
LAST_EDGES = 16_384
#: Members of a node, at each level of the hierarchy.
FAN = 16
#: Rounds of contraction, each of which halves the edges or better; that so many do not do is an error.
ROUNDS = 200
#: A fingerprint that more than one in HOT_SHARE of all rows have, and more than LEAST_HOT, is not shuffled by.
HOT_SHARE, LEAST_HOT = 100_000, 200
#: So many ids of removed documents are sent to the executors at most (about 20 bytes each); more are joined by a shuffle.
SENT_REMOVED = 2_000_000


# -- fingerprints ----------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower lowers A-Z alone
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), seed) for x in zip(*(ws[k:] for k in range(width)), strict=False)), np.uint64, len(ws) - width + 1)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h))))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long with the fingerprint's bits."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, fp long")


# -- candidate groups ------------------------------------------------------------------------------------------


def split_bits(free: list[int], parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` blocks of nearly equal size."""
    return [[int(x) for x in block] for block in np.array_split(np.array(free), parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def groups(fps: DataFrame, d: int = MAX_DIFF, most: int = GROUP) -> DataFrame:
    """(node, pattern, fp): every vertex once for each group; pairs within ``d`` bits meet in one at least.

    ``node`` says which bits are shared (the blocks chosen on the way), ``pattern`` which values they have.
    """
    level = [("", list(range(BITS)))]
    todo = fps.select("fp", F.lit("").alias("node"))
    done = None
    while True:
        # each node's free bits, in d+1 blocks; a child fixes one block more
        children = {node + str(k): block for node, free in level for k, block in enumerate(split_bits(free, d + 1))}
        fixed_of: dict[str, list[int]] = {}
        for node, free in level:
            fixed = [b for b in range(BITS) if b not in free]
            for k in range(d + 1):
                fixed_of[node + str(k)] = sorted(fixed + children[node + str(k)])
        masks = F.create_map(*[x for c, bits in fixed_of.items() for x in (F.lit(c), F.lit(_mask(bits)))])
        here = todo.select("fp", F.explode(F.array(*[F.concat("node", F.lit(str(k))) for k in range(d + 1)])).alias("node"))
        here = here.select("node", F.col("fp").bitwiseAND(masks[F.col("node")]).alias("pattern"), "fp")
        level = [(c, [b for b in range(BITS) if b not in bits]) for c, bits in fixed_of.items()]
        sizes = here.groupBy("node", "pattern").agg(F.count("*").alias("n"))
        if 1 << len(level[0][1]) <= 2 * most:  # so few fingerprints share the pattern at most
            return here if done is None else done.unionByName(here)
        large = sizes.where(F.col("n") > most).select("node", "pattern", F.lit(True).alias("large"))
        large = materialize(large, "simhash-large")
        if large.isEmpty():
            return here if done is None else done.unionByName(here)
        here = here.join(large, ["node", "pattern"], "left")
        small = here.where(F.col("large").isNull()).drop("large")
        done = small if done is None else done.unionByName(small)
        todo = here.where(F.col("large")).select("fp", "node")


# -- the index in a group --------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a code word in Gray order: the XOR of all its right shifts."""
    r = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node has the bits (mask) and values (pattern) that its members share."""

    def __init__(self, fps: np.ndarray, fan: int = FAN):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.fan = fan
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves' parents upwards
        both, any_ = self.fps, self.fps
        while len(both) > 1:
            cut = np.arange(0, len(both), fan)
            both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
            self.levels.append((~(both ^ any_), both))

    def links(self, d: int = MAX_DIFF, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of places i < j in Gray order, within ``d`` bits."""
        n = len(self.fps)
        for lo in range(0, n, block):
            query = np.arange(lo, min(n, lo + block))
            nodes = np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                near = np.bitwise_count((self.fps[query] ^ pattern[nodes]) & mask[nodes]) <= d
                query, nodes = query[near], nodes[near]
                below = len(self.levels[depth - 1][0]) if depth else n
                query = np.repeat(query, self.fan)
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                keep = nodes < below
                query, nodes = query[keep], nodes[keep]
                last = (nodes + 1) * self.fan**depth > query  # subtrees before the query hold no j > i
                query, nodes = query[last], nodes[last]
            good = (nodes > query) & (np.bitwise_count(self.fps[query] ^ self.fps[nodes]) <= d)
            yield query[good], nodes[good]


def forest(fps: np.ndarray, d: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Chains (a, b) of fingerprints that join up exactly what the links within ``d`` bits join."""
    index = GrayIndex(np.unique(fps))
    root = np.arange(len(index.fps))
    for i, j in index.links(d):
        root = merge(root, i, j)
    order = np.lexsort((np.arange(len(root)), root))
    same = root[order][1:] == root[order][:-1]
    return index.fps[order[:-1][same]], index.fps[order[1:][same]]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of every component once the pairs (i, j) are linked; ``root`` has it from before."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def group_edges(grouped: DataFrame, d: int = MAX_DIFF) -> DataFrame:
    """Edges (a, b) of all groups. A group's rows sit together in a partition; groups are cut out of the sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(parts)
            if len(fps) > 1:
                a, b = forest(fps.view(np.uint64), d)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            pattern, fp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cut = np.flatnonzero((pattern[1:] != pattern[:-1]) | (node[1:] != node[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(fp)], strict=True):
                if (mine := (node[lo], pattern[lo])) != key:
                    if parts:
                        yield from close()
                    key, parts = mine, []
                parts.append(fp[lo:hi])
        if parts:
            yield from close()

    return grouped.repartition("node", "pattern").sortWithinPartitions("node", "pattern").mapInArrow(run, "a long, b long")


# -- components ------------------------------------------------------------------------------------------------


def _last(edges: DataFrame) -> DataFrame:
    """Components of at most LAST_EDGES edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if got:
            a, b = (np.concatenate([x[k] for x in got]) for k in (0, 1))
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = merge(np.arange(len(names)), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["v", "c"])

    return edges.coalesce(1).mapInArrow(run, "v long, c long")


def components(edges: DataFrame, few: int = LAST_EDGES) -> DataFrame:
    """(v, c) for every vertex on an edge: c is equal just where vertices are connected."""
    edges = materialize(edges.where("a <> b").distinct(), "simhash-edges")
    steps: list[DataFrame] = []
    for turn in range(ROUNDS + 1):
        if edges.count() <= few:
            break
        if turn == ROUNDS:
            raise RuntimeError(f"{ROUNDS} rounds of contraction left more than {few} edges")
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("v"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("v")).agg(F.min(order(F.col("b"))).alias("m"))
        step = materialize(step.select("v", F.least("m", order(F.col("v")))["v"].alias("c")), "simhash-step")
        steps.append(step)
        for k in ("a", "b"):
            edges = edges.join(step.select(F.col("v").alias(k), F.col("c").alias("to")), k).drop(k).withColumnRenamed("to", k)
        edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-edges")
    label = _last(edges)
    for step in reversed(steps):
        label = step.join(label.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", F.coalesce("up", "c").alias("c"))
    return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", d: int = MAX_DIFF) -> DataFrame:
    """(id, fp, component_id, root): component_id is the smallest id that links of at most ``d`` bits reach, the row's own included; root is one fingerprint of the component."""
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, doc_id, text), "simhash-fp")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-vertices")
    found = materialize(components(group_edges(groups(fps.select("fp"), d), d)), "simhash-components")
    named = fps.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    best = named.groupBy("c").agg(F.min("least").alias("component_id"), F.max(F.when(F.col("fp") == F.col("c"), F.col("n"))).alias("n"))
    of = named.where(F.col("c") != F.col("fp")).select("fp", "c", "n").join(best.drop("n"), "c").select("fp", "c", "component_id", "n")
    label = materialize(of.unionByName(best.select(F.col("c").alias("fp"), "c", "component_id", "n")), "simhash-labels").withColumnRenamed("c", "root")
    # rows of a fingerprint that many have meet its label where they are; there are fewer than HOT_SHARE of those, whatever the table's size
    often = F.col("n") > max(LEAST_HOT, rows.count() // HOT_SHARE)
    hot, rest = label.where(often).drop("n"), label.where(~often).drop("n")
    met = rows.join(F.broadcast(hot), "fp").unionByName(rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest.hint("merge"), "fp"))
    return met.select("id", "fp", "component_id", "root")


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sent_removed: int = SENT_REMOVED) -> DataFrame:
    """One row of each component, columns unchanged: one of the smallest id (a null id only where all are null).

    Documents are filtered in place by the ids that go; no text is shuffled unless more than ``sent_removed`` of them go. Rows that share an id, or have none, are told apart by
    their fingerprints, and of those that share both any one stays.
    """
    found = near_duplicates(docs, doc_id, text)
    found = materialize(found.groupBy("id", "fp", "component_id", "root").agg(F.count("*").alias("n")), "simhash-rows")
    shared = materialize(found.groupBy("id").agg(F.sum("n").alias("n")).where("n > 1 and id is not null").select("id"), "simhash-shared")
    some = found.join(shared.hint("merge"), "id", "left_semi").unionByName(found.where("id is null"))  # rows that an id does not tell apart
    gone = found.where("id <> component_id").select("id").unionByName(shared).distinct()
    gone = materialize(gone.withColumnRenamed("id", "gone_id"), "simhash-gone")
    name = unused(docs, "gone")
    gone_ids = gone.select(F.col("gone_id").alias(name))
    gone_ids = F.broadcast(gone_ids) if gone.count() <= sent_removed else gone_ids.hint("merge")
    kept = docs.where(F.col(doc_id).isNotNull()).join(gone_ids, F.col(doc_id) == F.col(name), "left_anti")
    # one fingerprint for each component whose smallest id is shared or null; the root tells components of one id apart
    winners = some.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "root").agg(F.min("fp").alias("fp"))
    winners = materialize(winners.select("id", "fp"), "simhash-winners")
    if winners.isEmpty():
        return kept
    fp, wid, wfp = unused(docs, "fp"), unused(docs, "id"), unused(docs, "own")
    winners = winners.select(F.col("id").alias(wid), F.col("fp").alias(wfp))
    named = docs.join(winners.select(wid).distinct(), F.col(doc_id).eqNullSafe(F.col(wid)), "left_semi")
    one = with_fingerprint(named, text, fp).join(winners, F.col(doc_id).eqNullSafe(F.col(wid)) & (F.col(fp) == F.col(wfp)), "left_semi").dropDuplicates([doc_id, fp])
    return kept.unionByName(one.select(*docs.columns))


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t)) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield b.append_column(name, pa.array(fps))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


__all__ = ["GrayIndex", "components", "digest", "fingerprint", "fingerprints", "forest", "groups", "near_duplicates", "shingle_hashes", "survivors"]
