"""Operator 1: heuristic quality rules run as a short-circuit cascade.

The contract's base counts are taken of every text. A text that passes the base test then meets further rules,
cheap and selective ones first: :func:`plan` times every rule and counts its rejections on a bounded sample,
and orders the rules by rejections per nanosecond. The order changes the cost only, never the verdict, since a text is
kept if no rule rejects it.

Defined results: a null or empty text has no words, so all counts are 0, ``base_failed`` is true and ``kept`` false.
A repeated row gives its result once for each copy. An empty table gives an empty result. Columns other than the id and the
text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BREAKS, prepare, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 256
#: Tasks that the sample is taken from.
SAMPLE_TASKS = 4

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")
_ALPHA_WORD = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Doc:
    text: str
    words: list[bytes]
    n_symbols: int
    n_dup_lines: int


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by a window that occurs twice or more; windows are compared exactly, by doubling: pairs, fours, eights."""
    n = len(ids)
    if n <= window:
        return 0
    span, key = 1, ids
    while span < window:
        step = min(span, window - span)
        joint = key[:-step] * np.int64(n + 1) + key[step:]
        span += step
        uniq, key, count = np.unique(joint, return_inverse=True, return_counts=True)
        if len(uniq) == len(joint):
            return 0
    start = np.flatnonzero(count[key] > 1)
    if not len(start):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def word_ids(ws: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in ws), np.int64, len(ws))


def base(text: str | None) -> tuple[Doc, dict]:
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if x.strip(WORD_BREAKS)]
    doc = Doc(text, ws, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)))
    n = len(ws)
    repeat = repeated_window_words(word_ids(ws)) if n > WINDOW else 0
    return doc, {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, WORD_BREAKS)),
        "n_symbols": doc.n_symbols,
        "n_dup_lines": doc.n_dup_lines,
        "n_repeat_words": repeat,
        "base_failed": n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n,
    }


def _shouting(d: Doc) -> bool:
    up = len(_UPPER.findall(d.text))
    return up > 30 and up > len(_LOWER.findall(d.text))


def _stuttering(d: Doc) -> bool:
    same = sum(1 for a, b in zip(d.words, d.words[1:], strict=False) if a == b)
    return 10 * same > 3 * len(d.words)


#: A rule tells whether it rejects a text. Thresholds reject what is plainly not prose and leave the doubtful alone.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 4 * d.n_symbols > len(d.words),
    "shouting": _shouting,
    "few_alphabetic_words": lambda d: 2 * sum(1 for w in d.words if _ALPHA_WORD.search(w)) < len(d.words),
    "repeated_lines": lambda d: d.n_dup_lines >= 5 and 2 * d.n_dup_lines > d.text.count("\n") + 1,
    "stuttering": _stuttering,
    "long_words": lambda d: sum(map(len, d.words)) > 40 * len(d.words),
    "exclamations": lambda d: 2 * d.text.count("!!") > len(d.words),
    "ellipsis_lines": lambda d: (n := d.text.count("...") + d.text.count("…")) >= 5 and 2 * n > d.text.count("\n") + 1,
}


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and rejections over the first rows of a task's sample; a task stops reading there."""
    cost, hits, left = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0), SAMPLE_ROWS // SAMPLE_TASKS
    for b in batches:
        for text in b.column(0).to_pylist()[:left]:
            left -= 1
            doc, stats = base(text)
            if stats["base_failed"]:
                continue
            for name, rejects in RULES.items():
                t = time.perf_counter_ns()
                hits[name] += rejects(doc)
                cost[name] += time.perf_counter_ns() - t
        if left <= 0:
            break
    yield pa.RecordBatch.from_pydict({"rule": list(RULES), "ns": list(cost.values()), "rejected": list(hits.values())}, schema=pa.schema([("rule", pa.string()), ("ns", pa.int64()), ("rejected", pa.int64())]))


def plan(docs: DataFrame, text: str = "text") -> list[str]:
    """Names of the rules by estimated rejections per nanosecond, best first. Fitted on at most SAMPLE_ROWS rows of a few tasks; nothing is shuffled."""
    prepare(docs.sparkSession)
    found = docs.select(text).sample(0.02, seed=7).mapInArrow(_estimate, "rule string, ns long, rejected long").take(SAMPLE_TASKS * len(RULES))
    got: dict[str, tuple[int, int]] = {}
    for r in found:
        ns, hit = got.get(r.rule, (0, 0))
        got[r.rule] = (ns + r.ns, hit + r.rejected)
    rate = {k: (hit + 0.01) / (ns + 1.0) for k, (ns, hit) in got.items()}
    return sorted(RULES, key=lambda k: (-rate.get(k, 0.0), k))


def passes(doc: Doc, order: list[str]) -> bool:
    return not any(RULES[name](doc) for name in order)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: its id, the base counts, ``base_failed`` and ``kept``. One scan, no shuffle."""
    prepare(docs.sparkSession)
    order = plan(docs, text) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k, _ in FIELDS}
            for t in b.column(1).to_pylist():
                doc, stats = base(t)
                for k, v in stats.items():
                    out[k].append(v)
                out["kept"].append(not stats["base_failed"] and passes(doc, order))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[k], kind) for k, kind in FIELDS)], names=[b.schema.names[0], *out])

    some = docs.select(doc_id, text)
    kinds = {pa.int64(): "long", pa.bool_(): "boolean"}
    return some.mapInArrow(run, f"`{doc_id}` {some.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{k} {kinds[v]}" for k, v in FIELDS))
