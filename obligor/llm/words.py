"""Words of a text: lower-case ASCII letters, cut at ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null text counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """``bytes.split`` cuts at space and 0x09-0x0D, and drops empty pieces."""
    return text.translate(LOWER).split()


def chunks(texts: list[bytes], size: int) -> Iterator[slice]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
