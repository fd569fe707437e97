"""Words of whole texts, in blocks of bounded size; shared by the operators on lower-cased words."""

from __future__ import annotations

import re
from collections.abc import Iterator

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # A-Z are lower-cased after the cut
BLOCK_BYTES = 1 << 20


def word_blocks(text: bytes | None, block_bytes: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text with A-Z lower-cased, a list a block; blocks end between words.

    bytes.lower() changes A-Z only, and the word pattern takes every byte of a character
    beyond ASCII, so working on bytes gives the words of the text.
    """
    if not text:
        return
    at = 0
    while at < len(text):
        end = at + block_bytes
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end
