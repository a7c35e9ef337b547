"""What an editor asks about a text: words, spans, completion contexts, URIs."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit

from .statements import requirement

#: Bytes of an identifier in an editor: wider than the lexer's words.
IDENT = "[A-Za-z0-9_$\x80-\xff]"
_SPAN = re.compile(f'"[^"]*(?:"|\\Z)|`[^`]*(?:`|\\Z)|\\[[^\\]]*(?:\\]|\\Z)|{IDENT}+', re.S)
_LEADING = re.compile(rf"(?:\s|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))*({IDENT}+)", re.S)


def identifier_span(text: str, start: int) -> tuple[int, int]:
    """The identifier that begins at ``start`` of a Latin-1 view; empty where none does."""
    found = _SPAN.match(text, start) if 0 <= start < len(text) else None
    return (start, found.end()) if found else (start, start)


def word_before(text: str, offset: int) -> str:
    return re.search(f"{IDENT}*\\Z", text[: max(0, offset)])[0]


def _previous_word(text: str) -> tuple[str, int]:
    """The last word of ``text`` before trailing space and comments, and its end."""
    while True:
        shorter = text.rstrip(" \t\n\r\v\f")
        line = shorter[shorter.rfind("\n") + 1 :]
        if shorter.endswith("*/") and "/*" in shorter:
            shorter = shorter[: shorter.rfind("/*")]
        elif mark := re.search(r"--|#", line):
            shorter = shorter[: len(shorter) - len(line) + mark.start()]
        if shorter == text:
            return word_before(text, len(text)), len(text)
        text = shorter


def completion_context(text: str, offset: int) -> tuple[str, str]:
    """``references``, ``directive``, ``on`` or ``none`` at an offset, and the prefix being typed."""
    offset = min(max(0, offset), len(text))
    prefix = word_before(text, offset)
    start = offset - len(prefix)
    line = re.match(r"[ \t\r\v\f]*(?:--|\#)[ \t]*(.*)", text[text.rfind("\n", 0, start) + 1 : start], re.S)
    required = requirement().match(line[1]) if line else None
    if required and (required.end() == len(line[1]) or line[1][required.end()] in " \t"):
        return "directive", prefix
    word, end = _previous_word(text[:start])
    if word.upper() == "REFERENCES":
        return "references", prefix
    if word.upper() == "ON":
        words, at, begun = [], 0, text[text.rfind(";", 0, start) + 1 : end]
        while len(words) < 4 and (m := _LEADING.match(begun, at)):
            words.append(m[1].upper())
            at = m.end()
        if re.match(r"CREATE (UNIQUE )?(INDEX|TRIGGER)\b", " ".join(words)):
            return "on", prefix
    return "none", prefix


def path_of(uri: str) -> str:
    parts = urlsplit(uri)
    if parts.scheme != "file":
        raise ValueError(f"unsupported URI scheme {parts.scheme!r}")
    return unquote(parts.path)


def uri_of(path: str) -> str:
    return "file://" + quote(path)
