"""Letter-and-digit words of whole texts, part by part, and bounded groups of driver-side rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TypeVar

#: A-Z become a-z, every other ASCII character that is not a letter or digit a blank; bytes from 0x80 on stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
Row = TypeVar("Row")


def words(text: bytes) -> list[bytes]:
    """The words `[0-9a-z\\x80-]+` of a UTF-8 text after A-Z are lower-cased."""
    return text.translate(_FOLD).split()


def words_by_part(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same words in lists of about `most` bytes of text each, cut between words, so that a very long text never stands as one list."""
    if len(text) <= most:
        yield words(text)
        return
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + most)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def groups(rows: Iterable[tuple[Row, int]], most: int) -> Iterator[list[Row]]:
    """Rows, given with their sizes, in lists of summed size `most` at most (one row at least)."""
    out, held = [], 0
    for row, size in rows:
        if out and held + size > most:
            yield out
            out, held = [], 0
        out.append(row)
        held += size
    if out:
        yield out
