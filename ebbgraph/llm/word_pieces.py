"""Words of a whole UTF-8 text, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20  # bytes whose words are held together


def words_by_piece(utf8: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """Lists of words, in order. ``table`` (256 bytes) maps separators to spaces and A-Z to a-z; no word is cut."""
    left = b""
    text = utf8 or b""
    for at in range(0, len(text), PIECE):
        part = left + text[at : at + PIECE].translate(table)
        cut = len(part) if at + PIECE >= len(text) else part.rfind(b" ") + 1
        left = part[cut:]
        yield part[:cut].split()


def lowering_table(separators: bytes) -> bytes:
    """A byte table that makes A-Z lower case and every one of ``separators`` a space."""
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))
