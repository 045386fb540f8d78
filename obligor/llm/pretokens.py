"""Pre-tokens of byte-level vocabularies, cut as the tokenizer libraries cut them."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import regex
import tiktoken

#: A private-use character: no letter, digit or space in any version of Unicode.
NO_LETTER = "\ue000"


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """Letters and digits of ``regex`` that the tokenizer libraries' older Unicode lacks.

    A probe of the library: after a character it takes for a letter or digit, "!!" stays
    in the same piece and is one token.
    """
    points = chain(range(0xD800), range(0xE000, 0x110000))
    known = regex.sub(r"[^\p{L}\p{N}]+", "", "".join(map(chr, points)))
    probe = tiktoken.Encoding(
        "probe",
        pat_str=r"[\p{L}\p{N}]!!|(?s:.)",
        mergeable_ranks={**{bytes([b]): b for b in range(256)}, b"!!": 256},
        special_tokens={},
    )
    ids = probe.encode_ordinary("".join(c + "!!" for c in known))
    newer, at = [], 0
    for c in known:
        at += len(c.encode())
        if ids[at] != 256:
            newer.append(c)
        at += 1 if ids[at] == 256 else 2
    return "".join(newer)


class Splitter:
    """Cuts a text by a pattern; ``newer`` characters count as neither letter nor digit."""

    def __init__(self, pattern: str, newer: str = ""):
        self.pattern = regex.compile(pattern)
        self.newer = frozenset(newer)
        self.plain = dict.fromkeys(map(ord, newer), NO_LETTER)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        plain = text.translate(self.plain)
        return [text[slice(*match.span())] for match in self.pattern.finditer(plain)]
