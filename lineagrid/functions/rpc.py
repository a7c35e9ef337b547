"""Framed JSON messages: ``Content-Length`` headers, an empty line, a body."""

from __future__ import annotations

import json
from typing import Any, BinaryIO


def read_message(stream: BinaryIO) -> Any | None:
    """The next message, or None at the end of the stream.

    A body that is no JSON raises ``json.JSONDecodeError``; the stream then
    stands at the next message.
    """
    length = None
    while True:
        line = stream.readline()
        if not line:
            if length is None:
                return None
            raise EOFError("the stream ends within a header")
        if not line.strip():
            break
        name, _, value = line.decode("ascii").partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    if length is None:
        raise ValueError("a message without Content-Length")
    body = stream.read(length)
    if len(body) < length:
        raise EOFError("the stream ends within a message")
    return json.loads(body)


def write_message(stream: BinaryIO, message: Any) -> None:
    body = json.dumps(message, ensure_ascii=False, separators=(",", ":")).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()
