"""Words of UTF-8 texts, read as bytes: only A-Z is lower-cased, and long texts are read piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

PIECE = 1 << 22


def byte_table(separates: Callable[[int], bool]) -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z, bytes that separate become spaces."""
    return bytes(32 if separates(c) else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words ``[^\x20\x09-\x0D]+``.
WORDS = byte_table(lambda c: c == 32 or 9 <= c <= 13)
#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: ASCII letters and everything beyond ASCII, whose UTF-8 bytes are all above 0x7F.
TERMS = byte_table(lambda c: c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F)


def words_in(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from pieces of about ``piece`` bytes; no word is cut."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = len(text) if len(text) - at <= piece else text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
