"""Operator 2: secrets in texts.

One Aho-Corasick pass over the ASCII-lower-cased text finds every keyword; only at those places an anchored regular
expression is tried; formats that embed a checksum are kept only if it holds. Runs of hexadecimal digits have no keyword:
a character-class scan finds them.

Kinds, in the order that breaks ties of position: ``assign``, ``access``, ``hex`` (the contract's base, leftmost
non-overlapping for each kind), then the added ``github`` and ``npm`` tokens (CRC-32 of the body in base 62 at the end),
``card`` numbers (an issuer's prefix and length, and the Luhn digit), ``jwt`` (its header must decode to JSON), ``pem`` private-key headers, and the ``slack``, ``google``,
``gitlab`` and ``stripe`` tokens that embed no checksum and are taken by their form. Card numbers have no keyword either and are found like hexadecimal ones.

Defined results: a null or empty text has no spans (``base_sha256`` is that of the empty string, ``spans`` is empty). Repeated
rows give a result each. The time is linear in a text's length, whatever it holds. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

Span = tuple[int, int, str]

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "card", "jwt", "pem", "slack", "google", "gitlab", "stripe")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[opsur]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_CARD = re.compile(r"(?<![0-9])[2-6][0-9]{12,18}(?![0-9])")
#: Forms of tokens without a checksum.
_FORMS = {
    "slack": re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "gitlab": re.compile(r"glpat-[A-Za-z0-9_-]{20}(?![A-Za-z0-9_-])"),
    "stripe": re.compile(r"[rs]k_live_[A-Za-z0-9]{24,}"),
}
#: First and last prefix of each range of an issuer, and the lengths of its numbers.
ISSUERS = [
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)),
    ("3528", "3589", (16, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("62", "62", (16, 17, 18, 19)),
]

#: Keyword to the kind that it announces.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem", "xox": "slack", "aiza": "google", "glpat-": "gitlab", "sk_live_": "stripe", "rk_live_": "stripe"}

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = _BASE62[k] + out
    return out.rjust(6, "0")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    return any(len(digits) in lengths and low <= digits[: len(low)] <= high for low, high, lengths in ISSUERS) and luhn(digits)


def _is_jwt(header: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def _at(text: str, kind: str, start: int) -> tuple[int, bool] | None:
    """End of what the kind's expression matches at a place, and whether it counts as a secret."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= 12) if (m := _ASSIGN.match(text, start)) else None
    if kind == "access":
        return (m.end(), m.end() - start >= 18) if (m := _ACCESS.match(text, start)) else None
    if kind == "pem":
        return (m.end(), True) if (m := _PEM.match(text, start)) else None
    if kind in _FORMS:
        return (m.end(), True) if (m := _FORMS[kind].match(text, start)) else None
    m = (_GITHUB if kind == "github" else _NPM).match(text, start)
    return (m.end(), base62_crc(m[1]) == m[2]) if m else None


class Tokens:
    """JSON web tokens of one text: three runs of base64 with a point between them, the first two beginning with eyJ. A run is walked over once, however many keywords it holds."""

    def __init__(self, text: str):
        self.text, self.end, self.over = text, 0, None

    def at(self, start: int) -> tuple[int, bool] | None:
        """As :func:`_at`; places must ascend."""
        if start >= self.end:
            self.end = _RUN.match(self.text, start).end()
            self.over = self._rest(self.end)  # the same for all places of the run
        if self.over is None or self.end - start < 4 or not self.text.startswith("eyJ", start):
            return None
        return self.over, _is_jwt(self.text[start : self.end])

    def _rest(self, end: int) -> int | None:
        if not self.text.startswith(".eyJ", end):
            return None
        second = _RUN.match(self.text, end + 1).end()
        if second < end + 5 or not self.text.startswith(".", second):
            return None
        third = _RUN.match(self.text, second + 1).end()
        return third if third > second + 1 else None


def scan(text: str | None) -> list[Span]:
    """All spans as (start, kind's number, end), sorted."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # lowers ASCII alone, so places stay
    near = sorted({(last - n + 1, kind) for last, (n, kind) in automaton().iter(low)})
    found, over, tokens = [], dict.fromkeys(KINDS, 0), Tokens(text)
    for start, kind in near:
        if start >= over[kind] and (hit := tokens.at(start) if kind == "jwt" else _at(text, kind, start)):
            over[kind] = hit[0]
            if hit[1]:
                found.append((start, KINDS.index(kind), hit[0]))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    return sorted(found)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, counts of the base kinds, the digest of the base spans, and all spans. One scan, no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans = [scan(t) for t in b.column(1).to_pylist()]
            base = [[s for s in x if s[1] < 3] for x in all_spans]
            cols = [[sum(s[1] == k for s in x) for x in base] for k in range(3)]
            cols += [[hashlib.sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in all_spans]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(cols, FIELDS, strict=True))], names=[b.schema.names[0], *(k for k, _ in FIELDS)])

    some = docs.select(doc_id, text)
    return some.mapInArrow(run, f"`{doc_id}` {some.schema[doc_id].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs``, columns unchanged, with every span of the text replaced by ``mask``; overlapping spans are replaced as one."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not (spans := scan(t)):
            return t
        out, over = [], 0
        for start, _, end in spans:
            if start >= over:
                out += [t[over:start], mask]
            over = max(over, end)
        return "".join(out) + t[over:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
