"""Offsets, lines and columns."""

from __future__ import annotations

from bisect import bisect_right


class LineMap:
    """Line starts of a text; offsets and columns count bytes (or units of the given view)."""

    def __init__(self, text: str):
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def locate(self, offset: int) -> tuple[int, int]:
        """1-based line and column; a negative offset is the start."""
        offset = max(0, offset)
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1

    def offset(self, line: int, col: int) -> int:
        return self.starts[min(max(line, 1), len(self.starts)) - 1] + col - 1


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def byte_to_utf16(line: bytes, col: int) -> int:
    """0-based UTF-16 column of a 0-based byte column; beyond the end is the end."""
    return utf16_units(line[: max(0, col)].decode("utf-8", "replace"))


def utf16_to_byte(line: bytes, col: int) -> int:
    """0-based byte column of a 0-based UTF-16 column; within a pair is its start."""
    seen = at = 0
    for c in line.decode("utf-8", "surrogateescape"):
        width = 2 if ord(c) > 0xFFFF else 1
        if seen + width > col:
            break
        seen += width
        at += len(c.encode("utf-8", "surrogateescape"))
    return at
