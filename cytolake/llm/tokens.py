"""Token ids of a byte-level BPE file, at a rate that suits large corpora.

The file's vocabulary is in merge order, so the ids are ranks and a rank-based encoder gives the ids that the file's own
tokenizer gives, several times faster. Texts that contain a special token's string go to the tokenizer itself.

The split pattern looks ahead of white space, and its engine keeps a place to return to for each character, which overflows on
a run of a million. Runs of ``LONG_RUN`` characters or more are therefore cut out first: all of such a run but its last
character (all, at the text's end) is one piece by the pattern, and is merged as one, whatever its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the published split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: white space as the split pattern knows it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 256
_LONG = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest, in order, as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = byte_of_char()
        ranks = {bytes(of[c] for c in word): rank for word, rank in vocab.items() if rank not in added}
        self.size = max([*vocab.values(), *added], default=-1) + 1
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text part by part; a special token's string is ordinary text."""
        at = 0
        for run in _LONG.finditer(text):
            end = run.end() - (run.end() < len(text))
            if run.start() > at:
                yield self.fast.encode_to_numpy(text[at : run.start()], disallowed_special=())
            yield np.array(self.fast._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32)
            at = end
        if at < len(text):
            yield self.fast.encode_to_numpy(text[at:], disallowed_special=())

    def ordinary(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit numbers; a special token's string is ordinary text."""
        found = list(self.parts(text)) if text else []
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint32)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, those of special tokens where their strings stand."""
        if text and any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ordinary(text).astype("<u4", copy=False).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
