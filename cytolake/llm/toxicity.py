"""Operator 7: toxicity by a fuzzy lexicon and the context of each hit.

* Lexicon: whole words (written with a ``$`` at the end) and stems that mark toxic rows of the training labels. Terms are counted by
  document in a bounded sample of ``SAMPLE`` labelled rows; a term needs a precision and a significance that allows for all terms tried, and
  must stand after many different words, so that the words of a much-copied toxic text do not become terms.
* Matching: the lexicon is a trie; each distinct word of a text becomes a Levenshtein automaton (bit sets of places by number of errors),
  and both are walked together. A misspelling within one edit (a character too few, too many, wrong, or two swapped, anywhere in the word) is a hit of its own kind, unless clean training texts have it
  as a word.
* Context: a hit within a window that quotes or reports (quotation marks around it, verbs of saying, words about words) is counted apart from a hit that is
  plain or addressed to somebody. A logistic model over the four counts, drawn towards prior weights that are set by hand, gives the score; the words of speech are a fixed list too.

Labels are learned only from rows whose ``crc32(doc_id) mod 5`` is not 0. No score looks at label, language, source or id.

Defined results: a null or empty text scores like a text without hits. Repeated rows are scored each. Without labels the lexicon is
empty and all texts get the score of no hits. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Labelled rows to learn from, and characters that their texts have, about at most (a hash of the id chooses). All that is learned from them, words near terms included, fits the driver.
SAMPLE, SAMPLE_CHARS = 20_000, 200_000_000
FOLDS = 5
STEM, WORD_MIN = range(4, 9), 3
#: Least length of terms that a text's words may misspell; the clean words near them are known.
SHORT_MIN = 3
PRECISION, DOUBT = 0.9, 100.0
WINDOW = 5
KEPT_WORDS = 300_000

#: Words and marks about speech: a hit near them is reported, not uttered.
SPEECH = frozenset("said says say called calls call wrote writes quote quoted quotes word words term terms slur insult insults phrase cited reported according dit disait appelé mot dijo dice llamó palabra sagte sagt nannte wort".split())
MARKS = "\"“”«»„‟'‘’"

#: Prior mean of bias and weights: plain, reported, misspelt, misspelt and reported.
PRIOR = np.array([-4.0, 5.0, 1.0, 1.5, 0.0])
PRIOR_STRENGTH = 0.05


# -- trie and automaton ----------------------------------------------------------------------------------------------


def trie(terms: list[str]) -> dict:
    """Nested by character; a stem ends at "" and a whole word at "$"."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t.removesuffix("$"):
            node = node.setdefault(c, {})
        node["$" if t.endswith("$") else ""] = t
    return root


class Terms:
    """The trie of the terms, and that of the terms without their first characters: what follows an error there is met without one."""

    def __init__(self, terms: list[str]):
        self.root = trie(terms)
        #: Of a longer word no term meets more than its beginning, and no whole word does.
        self.longest = max((len(t.removesuffix("$")) for t in terms), default=0) + 3
        self.first: dict[str, str] = {}  # the first term of each tail
        for t in sorted(terms, reverse=True):
            self.first[t[1:]] = t
        self.rest = trie(list(self.first))


def met(word: str, node: dict | None) -> Iterator[str]:
    """The terms that a word meets without an error."""
    for c in word:
        if node is None:
            return
        if "" in node:
            yield node[""]
        node = node.get(c) if c != "$" else None
    if node is not None:
        yield from (node[c] for c in ("", "$") if c in node)


def at_first(word: str, terms: Terms) -> Iterator[str]:
    """The terms that a word meets but for one error in its first character: one too many, a wrong one, one too few, or the first two in the wrong order."""
    yield from met(word[1:], terms.root)
    for w in (word[1:], word):
        yield from (terms.first[t] for t in met(w, terms.rest))
    if len(word) > 1 and "$" not in word[:2]:
        yield from met(word[2:], terms.root.get(word[1], {}).get(word[0]))


def match(word: str, terms: Terms, least: int = SHORT_MIN) -> tuple[str, int] | None:
    """The term nearest to a word, as (term, edits): an exact one first, then one edit (two neighbours in the wrong order are one); None beyond that.

    Terms of fewer than ``least`` characters allow no edit. Bit i of ``r0`` or ``r1``: i characters of the word are read with none or one error. Reading a trie character moves
    equal places on; an error lets a place stay (a character too few), move (a wrong one) or jump (one too many), or takes two trie characters crosswise: ``p0`` and ``pb`` are
    ``r0`` and the word's places of the character before. A stem is met wherever the word goes on. Most words agree with no term in their first character, so errors there
    are looked up apart (:func:`at_first`) and the walk begins behind it.
    """
    word = word[: terms.longest]
    best = min(((t, 1) for t in at_first(word, terms) if len(t.removesuffix("$")) >= least), default=None) if word else None
    below = terms.root.get(word[:1]) if word[:1] != "$" else None
    if below is None:
        return best
    n = len(word)
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    stack = [(below, 2, 4, 1, at[word[0]], 1)]
    full = (1 << (n + 1)) - 1
    while stack:
        node, r0, r1, p0, pb, depth = stack.pop()
        for c, below in node.items():
            if c == "" or c == "$":
                here0 = r0 if c == "" else r0 >> n & 1
                here1 = depth >= least and (r1 & full if c == "" else r1 >> n & 1)
                if here0:
                    return below, 0
                if here1 and (best is None or best[0] > below):
                    best = (below, 1)
                continue
            b = at.get(c, 0)
            n0 = (r0 & b) << 1
            n1 = ((r1 & b) << 1 | r0 | r0 << 1 | n0 << 1 | ((p0 & b) << 1 & pb) << 1) & full
            if n0 or n1:
                stack.append((below, n0, n1, r0, b, depth + 1))
    return best


EDGES = ".,;:!?()[]{}<>*#%&$|/\\_-+=~^`@" + MARKS


def plain(token: bytes) -> str:
    """A white-space-separated token as a word: lower case without marks around it."""
    return token.decode("utf-8", "ignore").lower().strip(EDGES)


def spellings(token: bytes) -> list[str]:
    """The word of a token, and the word with the one mark before it, which may stand for a letter (``$tupid``)."""
    word, led = plain(token), token.decode("utf-8", "ignore").lower().rstrip(EDGES)
    lead = led[: len(led) - len(word)] if word else ""
    return [word, lead[-1] + word] if lead and lead[-1] not in MARKS else [word]


@dataclass
class Lexicon:
    terms: list[str]
    known: set[str] = field(default_factory=set)  # near terms, but clean
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self.index = Terms(self.terms)
        self.kept: dict[bytes, tuple[str, int] | None] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "known": self.known, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def look(self, token: bytes) -> tuple[str, int] | None:
        words = spellings(token)
        if words[0] in self.known:  # clean, but for an exact term
            hit = next(met(words[0], self.index.root), None) if len(words[0]) >= WORD_MIN else None
            return (hit, 0) if hit else None
        found = [hit for w in words if len(w) >= WORD_MIN and (hit := match(w, self.index))]
        return min(found, key=lambda hit: hit[1], default=None)

    def hits(self, tokens: list[bytes]) -> list[tuple[int, str, int]]:
        """(place, term, edits) of all hits."""
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for t in set(tokens):
            if t not in kept:
                kept[t] = self.look(t)
        return [(i, *kept[t]) for i, t in enumerate(tokens) if kept[t]]

    def features(self, text: str | None) -> list[int]:
        """Counts of hits: plain, reported, misspelt, misspelt and reported."""
        out = [0, 0, 0, 0]
        if text:
            tokens = text.encode("utf-8", "surrogatepass").split()
            for i, _, edits in self.hits(tokens):
                out[2 * edits + reported(tokens, i)] += 1
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(counts) @ self.weights, -30, 30)))


def reported(tokens: list[bytes], i: int, window: int = WINDOW) -> bool:
    """Whether the words around a hit quote it: marks that open before and close after it, or words of speech."""
    before, after = tokens[max(0, i - window) : i], tokens[i + 1 : i + 1 + window]
    near = [plain(t) for t in (*before, *after)]
    if SPEECH.intersection(near):
        return True
    marks = tuple(m.encode() for m in MARKS)
    opened = any(t.startswith(marks) for t in (*before, tokens[i]))
    closed = any(t.rstrip(b".,;:!?").endswith(marks) for t in (tokens[i], *after))
    return opened and closed


def design(counts: np.ndarray) -> np.ndarray:
    """Bias and damped counts."""
    x = np.log2(1.0 + np.asarray(counts, float).reshape(-1, 4))
    return np.column_stack([np.ones(len(x)), x])


def logistic(counts: np.ndarray, label: np.ndarray, prior: np.ndarray = PRIOR, strength: float = PRIOR_STRENGTH) -> np.ndarray:
    """Weights of greatest posterior, by damped Newton steps; the step is halved while it does not improve."""
    x, w = design(counts), prior.copy()

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - label * z) + strength * np.sum((w - prior) ** 2) / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        t, now = 1.0, cost(w)
        while t > 1e-6 and cost(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w


# -- learning --------------------------------------------------------------------------------------------------------


@lru_cache(200_000)
def forms(token: bytes) -> tuple[str, ...]:
    """The word itself and its stems."""
    w = plain(token)
    if len(w) < WORD_MIN or not any(map(str.isalpha, w)):
        return ()
    return (w + "$", *(w[:k] for k in STEM if k <= len(w)))


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, label, n) over documents of (text, label), counted by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                if counts[k]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts[k])), pa.array([k] * len(counts[k]), pa.int32()), pa.array(list(counts[k].values()), pa.int64())], names=["term", "label", "n"])
                    counts[k].clear()

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = set((text or "").encode("utf-8", "surrogatepass").split())
                counts[label].update({f for t in tokens for f in forms(t)})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from out()
        yield from out()

    return sample.select("text", "label").mapInArrow(run, "term string, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))


def divergence(k, n, p):
    """n times the Kullback-Leibler divergence of k/n from p: the logarithm of a bound on so many hits by chance."""
    q = k / n
    tail = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return n * (q * F.log(q / p) + tail)


def candidates(counts: DataFrame, rate: float, precision: float = PRECISION, doubt: float = DOUBT) -> list[str]:
    """Terms whose documents are toxic far more often than chance allows, for all the terms tried."""
    both = counts.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("k"), F.sum("n").cast("double").alias("n"))
    tried = both.count()
    if not tried:
        return []
    good = both.where((F.col("k") >= precision * F.col("n")) & (F.col("k") >= 3))
    good = good.withColumn("weight", divergence(F.col("k"), F.col("n"), F.lit(rate))).where(F.col("weight") > float(np.log(tried * doubt)))
    return [r.term for r in good.select("term").collect()]


def varied(sample: DataFrame, terms: list[str], rate: float, doubt: float = DOUBT) -> dict[str, int]:
    """Terms of the toxic documents by the number of different words before them, where those alone are significant."""
    spark = sample.sparkSession
    sent = spark.sparkContext.broadcast(set(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            out = set()
            for text in b.column(0).to_pylist():
                last = b""
                for t in (text or "").encode("utf-8", "surrogatepass").split():
                    out.update((f, last) for f in forms(t) if f in wanted)
                    last = t
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["term", "before"])

    pairs = sample.where("label = 1").select("text").mapInArrow(run, "term string, before binary").distinct()
    least = float(np.log(max(len(terms), 1) * doubt) / -np.log(rate))
    return {r.term: r.n for r in pairs.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}


def choose(found: dict[str, int]) -> list[str]:
    """The longest form among those of equal standing; none that another one covers."""
    chosen: set[str] = set()
    begun: set[str] = set()  # all beginnings of chosen terms
    for t in sorted(found, key=lambda t: (-found[t], -len(t), t)):
        if t.removesuffix("$") not in begun and not any(t[:k] in chosen for k in range(1, len(t) + 1)):
            chosen.add(t)
            begun.update(t[:k] for k in range(1, len(t) + 1))
    return sorted(chosen)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label) of a bounded sample of the labelled rows outside the held-out fold; a written table."""
    open_ = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    known = open_.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = known.count()
    share = min(1.0, most / max(n, 1))
    in_share = lambda share: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = materialize(known.where(in_share(share)), "toxicity-labels")  # about ``most`` rows of two numbers: bounded, so it may be broadcast
    chosen = chosen.withColumnRenamed("doc_id", "__id")
    rows = docs.join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    rows = materialize(rows.select("__id", "text", "label"), "toxicity-sample")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most_chars:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * most_chars / size * (1 << 30)))
    return rows.select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Lexicon:
    """Fits lexicon and weights; ``docs`` has id and text."""
    sample = training_rows(docs, labels, most)
    toxic, n = sample.agg(F.sum("label"), F.count("*")).first()
    if not toxic or toxic == n:
        return Lexicon([])
    rate = toxic / n
    terms = candidates(term_counts(sample), rate)
    lexicon = Lexicon(choose(varied(sample, terms, rate)))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column(0).to_pylist():
                tokens = (text or "").encode("utf-8", "surrogatepass").split()
                seen.update(plain(tokens[i]) for i, _, edits in sent.value.hits(tokens) if edits)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    lexicon.known = {r.word for r in sample.where("label = 0").select("text").mapInArrow(near, "word string").distinct().collect()}
    fitted = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fitted.value.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in got], pa.int64()) for k in range(4)), b.column(1)], names=[*"abcd", "label"])

    # equal counts are grouped, so a few rows tell all
    rows = sample.mapInArrow(features, "a long, b long, c long, d long, label int").groupBy(*"abcd", "label").agg(F.count("*").alias("n")).collect()
    counts, label, times = np.array([list(r[:4]) for r in rows]), np.array([r.label for r in rows]), np.array([r.n for r in rows])
    lexicon.weights = logistic(np.repeat(counts, times, axis=0), np.repeat(label, times).astype(float))
    return lexicon


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the scoring is one scan without a shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(rows, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lexicon = sent.value
            got = lexicon.score(np.array([lexicon.features(t) for t in b.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
