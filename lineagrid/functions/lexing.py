"""Dialect-aware tokens and statements of SQL text.

Texts are handled as bytes seen through Latin-1, so every offset is a byte
offset. One pattern for each dialect, with a named group for each token kind,
does the scanning; statements are then cut from the token stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

DIALECTS = ("postgres", "mysql", "sqlite")

WORD, IDENT, STRING, PUNCT, COMMENT = "word", "quoted", "string", "punct", "comment"
#: What is said of a literal that does not end, by the group that finds its start.
_UNTERMINATED = {
    "open_string": "string literal",
    "open_ident": "quoted identifier",
    "open_bracket": "bracketed identifier",
    "open_dollar": "dollar-quoted string",
}
#: Characters that Unicode counts as white space.
UNICODE_SPACE = "\t\n\v\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


class LexError(ValueError):
    """A literal that does not end; the message names its byte offset."""


@dataclass(frozen=True)
class Token:
    kind: str
    raw: str
    value: str
    start: int
    end: int

    def is_word(self, *words: str) -> bool:
        return self.kind == WORD and self.value.upper() in words

    def is_punct(self, mark: str) -> bool:
        return self.kind == PUNCT and self.raw == mark

    @property
    def is_name(self) -> bool:
        return self.kind in (WORD, IDENT)

    @property
    def folded(self) -> str:
        """The identity of an identifier: quoted ones keep their case."""
        return self.value if self.kind == IDENT else self.value.lower()


@dataclass
class Statement:
    text: str
    start: int
    end: int
    comments: list[tuple[str, int]] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)


def check_dialect(name: str) -> str:
    if name not in DIALECTS:
        raise ValueError(f'unknown dialect "{name}" (expected postgres, mysql, or sqlite)')
    return name


@cache
def _grammar(dialect: str) -> re.Pattern[str]:
    mysql, sqlite, postgres = (check_dialect(dialect) == d for d in ("mysql", "sqlite", "postgres"))
    comments = [r"--[^\n]*", r"/\*.*?(?:\*/|\Z)"] + ([r"\#[^\n]*"] if mysql else [])
    body = r"(?:\\.|''|[^'\\])*+" if mysql else r"(?:''|[^'])*+"
    idents = ['"(?:""|[^"])*+"'] + (["`(?:``|[^`])*+`"] if mysql or sqlite else [])
    groups = [("space", r"[ \t\n\r\v\f]+"), (COMMENT, "|".join(comments)), (STRING, f"'{body}'"), (IDENT, "|".join(idents))]
    opens = [("open_string", "'"), ("open_ident", '["`]' if mysql or sqlite else '"')]
    if sqlite:
        groups.append(("bracket", r"\[[^\]]*\]"))
        opens.append(("open_bracket", r"\["))
    if postgres:
        groups.append(("dollar", r"\$(?P<tag>[A-Za-z0-9_]*)\$.*?\$(?P=tag)\$"))
        opens.append(("open_dollar", r"\$[A-Za-z0-9_]*\$"))
    groups += [*opens, (WORD, "[A-Za-z0-9_]+"), (PUNCT, ".")]
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in groups), re.S)


def tokenize(source: str, dialect: str) -> list[Token]:
    """All tokens but white space, comments included, of a Latin-1 view."""
    out = []
    for m in _grammar(dialect).finditer(source):
        kind, raw = m.lastgroup, m[0]
        if m.group("space") is not None:
            continue
        if kind in _UNTERMINATED:
            raise LexError(f"unterminated {_UNTERMINATED[kind]} starting at offset {m.start()}")
        value = raw
        if kind == IDENT:
            value = raw[1:-1].replace(raw[-1] * 2, raw[-1])
        elif kind == "bracket":
            kind, value = IDENT, raw[1:-1]
        elif kind in ("dollar", "tag"):
            kind = STRING
        out.append(Token(kind, raw, value, m.start(), m.end()))
    return out


def _trimmed(source: str, start: int, end: int) -> tuple[int, int]:
    """The span without surrounding white space, Unicode's included."""
    text = source[start:end].encode("latin-1").decode("utf-8", "surrogateescape")
    size = lambda s: len(s.encode("utf-8", "surrogateescape"))
    left = text.lstrip(UNICODE_SPACE)
    return start + size(text) - size(left), start + size(text) - size(left) + size(left.rstrip(UNICODE_SPACE))


def split(source: str, dialect: str) -> list[Statement]:
    """Statements of a Latin-1 view; a semicolon ends one and is left out.

    Comments before a statement belong to it and not to its text; those after
    the last one are dropped. Token offsets are relative to the text.
    """
    out: list[Statement] = []
    waiting: list[tuple[str, int]] = []
    body: list[Token] = []

    def close(end: int) -> None:
        nonlocal waiting, body
        if body:
            start, stop = _trimmed(source, body[0].start, end)
            if stop > start:
                own = [Token(t.kind, t.raw, t.value, t.start - start, t.end - start) for t in body]
                out.append(Statement(source[start:stop], start, stop, waiting, own))
                waiting, body = [], []
                return
            waiting = waiting + [(t.raw, t.start) for t in body if t.kind == COMMENT]
        body = []

    for token in tokenize(source, dialect):
        if token.is_punct(";"):
            close(token.start)
        elif token.kind == COMMENT and not body:
            waiting.append((token.raw, token.start))
        else:
            body.append(token)
    close(len(source))
    return out
