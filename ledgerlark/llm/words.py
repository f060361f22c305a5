"""Words of whole texts as bytes: maximal runs of ASCII letters and digits and of all bytes beyond ASCII, lower-cased.

In UTF-8 every character beyond ASCII consists of such bytes only, so these are the runs of characters that are neither
ASCII punctuation, space nor control.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands after each text of a batch; no word holds it, and in the texts themselves a space takes its place.
SENTINEL = b"\0"
WORD_OR_SENTINEL = re.compile(rb"[0-9a-z\x80-\xff]+|\0")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of text that are cut into words at once.
BLOCK = 2 << 20


def text_bytes(texts: pa.Array) -> list[bytes]:
    """Each text in UTF-8, with ASCII letters in lower case; null texts are empty."""
    return [s.as_buffer().to_pybytes().lower() if s.is_valid else b"" for s in texts.cast(pa.large_binary())]


def joined(texts: pa.Array) -> bytes:
    """The texts of a batch in one buffer with a sentinel after each."""
    return SENTINEL.join([*(t.replace(SENTINEL, b" ") for t in text_bytes(texts)), b""])


def blocks(buffer: bytes, limit: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of stretches of about ``limit`` bytes that end between words; one longer word stays whole."""
    start = 0
    while start < len(buffer):
        end = start + limit
        if end < len(buffer):
            gap = GAP.search(buffer, end)
            end = gap.start() if gap else len(buffer)
        yield start, buffer[start:end]
        start = end
