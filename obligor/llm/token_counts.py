"""Token counts without ids: each distinct pre-token is cut into pieces once.

The vocabulary is a table of fixed size: a pre-token that is an entry of it is counted on
the spot, by the number of pieces that the merges really give it. All others are judged
once per corpus through ``blocks`` and joined to the frequencies of each document.

Added tokens (such as an end mark) inside a text are one token each, as the library's
default has it. Defined results: a null text counts as empty, with no tokens; repeated rows
are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obligor.llm import blocks
from obligor.llm.pretokens import Splitter, newer_characters

#: More tokens than this are over the limit.
LIMIT = 512


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the letters from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceCounter:
    """Pieces of pre-tokens by the library's model; one per worker process."""

    def __init__(self, text: str):
        setup = json.loads(text)
        marks = setup["added_tokens"]
        if any(m["lstrip"] or m["rstrip"] or m["single_word"] for m in marks):
            raise ValueError("added tokens that take white space are not supported")
        if setup["normalizer"] or setup["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level vocabularies without a normalizer are supported")
        self.model = Tokenizer.from_str(text).model
        self.letters = byte_letters()
        self.table = {ord(chr(b)): c for b, c in self.letters.items()}
        byte_of = {c: b for b, c in self.letters.items()}
        words = [w for w in setup["model"]["vocab"] if all(c in byte_of for c in w)]
        self.entries = {bytes(byte_of[c] for c in w): len(self.model.tokenize(w)) for w in words}
        marks = sorted((m["content"] for m in marks), key=len, reverse=True)
        self.mark = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def pieces(self, term: bytes) -> int:
        return len(self.model.tokenize(term.decode("latin-1").translate(self.table)))


@lru_cache(maxsize=1)
def _counter(text: str) -> PieceCounter:
    return PieceCounter(text)


def token_counts(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``df``.

    ``path`` names a vocabulary file of the tokenizers library, read by the driver.
    """
    with open(path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast((file.read(), pattern, newer_characters()))

    def reader() -> Callable[[list, list[bytes]], list[blocks.Document]]:
        setup, pattern, newer = shared.value
        counter, split = _counter(setup), Splitter(pattern, newer)
        entries, mark = counter.entries, counter.mark

        def cut(text: bytes) -> blocks.Document:
            whole = text.decode("utf-8", "replace")
            parts = mark.split(whole) if mark else [whole]
            tokens = len(parts) - 1
            rest = []
            for part in parts:
                for piece in split(part):
                    known = entries.get(term := piece.encode())
                    if known is None:
                        rest.append(term)
                    else:
                        tokens += known
            return [len(text), tokens], rest, 0

        return lambda _, texts: [cut(text) for text in texts]

    def count(terms: list[bytes], _: np.ndarray) -> np.ndarray:
        pieces = _counter(shared.value[0]).pieces
        return np.fromiter(map(pieces, terms), np.int64, len(terms))

    def result(facts, document, counts, values):
        extra = np.bincount(document, counts * values, minlength=len(facts)).astype(np.int64)
        n_tokens = facts[:, 1] + extra
        return {"n_bytes": facts[:, 0], "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = blocks.pack(rows, reader)
    judged = blocks.judge(packed, count)
    return blocks.summed(packed, judged, result, "n_bytes long, n_tokens long, over_limit boolean")
