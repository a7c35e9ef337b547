"""Whole-text encoding with a ``tokenizers`` vocabulary, word by word.

Both supported families split a text before merging, and no merge crosses a
split. ``WordEncoder`` therefore cuts texts at places where the vocabulary's
own splitter always cuts, encodes each distinct piece once per memo and joins
the ids. Results equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of a worker's memo (about 150 bytes each), and the longest piece (bytes) that is kept.
MEMO_ENTRIES = 400_000
MEMO_PIECE = 48
#: Word vocabularies drop white space, so any ASCII white space separates.
WORD = "word"
#: Byte-level vocabularies keep a space with what follows it.
BYTE = "byte"

# Bytes of plain prose: letters, digits, white space, full stops, commas and Latin-1 letters.
_PROSE = bytes([*b" \n.,", *range(48, 58), *range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)])
# Runs of marks in prose, and the two Latin-1 characters that are no letters.
_RUNS = (b"..", b".,", b",.", b",,", b"\xc3\x97", b"\xc3\xb7")
# Where a cut before a space is not safe: before white space, or what may start it, or at the end.
_UNSAFE = tuple(b" " + bytes([x]) for x in (*b" \t\n\r\v\f", 0xC2, 0xE1, 0xE2, 0xE3))
# Line breaks that belong to longer white space.
_AFTER_BREAK = (*b" \t\n\r\v\f", 0xC2, 0xE1, 0xE2, 0xE3)
_BEFORE_BREAK = (*b"\t\r\v\f", 0x80, 0x85, 0xA0)
_LONG_BREAKS = (*(b"\n" + bytes([x]) for x in _AFTER_BREAK), *(bytes([x]) + b"\n" for x in _BEFORE_BREAK))
_PROSE_UNSAFE, _PROSE_BREAKS = (b"  ", b" \n"), (b"\n\n", b"\n ")
_SAFE_CUT = re.compile(rb"(?= [^\s\xc2\xe1-\xe3])")
# Marks that end a word in running text; an apostrophe may begin a unit with letters, so it is none.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# Runs of marks whose ids a worker keeps at most.
_MARK_RUNS = 10_000
# Prefixes of pieces in byte vocabularies; other pieces follow a space.
_MARK, _FIRST = b"\x01", b"\x02"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_family(tokenizer: Tokenizer) -> str:
    """``WORD`` when the amount of white space leaves no trace, else ``BYTE``."""
    one, two = (tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "a  b"))
    return WORD if one == two else BYTE


def is_prose(text: bytes) -> bool:
    """No marks but single full stops and commas: these are tokens of their own."""
    return not text.translate(None, _PROSE) and not any(run in text for run in _RUNS)


def separated_words(text: bytes) -> bytes:
    """``text`` with ASCII white space between all pieces, in lower case.

    Word vocabularies fold case. In prose a full stop or comma stands alone,
    so that fewer distinct pieces arise.
    """
    if b"<|" in text:  # may hold special strings, which are told apart by case
        return text
    if is_prose(text):
        text = text.replace(b".", b" . ").replace(b",", b" , ")
    return text.lower()


def separated_spaced(text: bytes) -> bytes | None:
    """``text`` with one space between all pieces, or None where that can't be.

    A piece stands for itself after a space; ``_FIRST`` and ``_MARK`` prefix
    pieces that no space precedes.
    """
    prose = is_prose(text)  # then space and newline are all its white space
    if text[-1:] == b" " or text[:1] == b" " or any(x in text for x in (_PROSE_UNSAFE if prose else _UNSAFE)):
        return None
    if b"\n" in text and not any(x in text for x in (_PROSE_BREAKS if prose else _LONG_BREAKS)):
        if prose:
            text = text.replace(b".\n", b" \x01.\n")
        text = text.replace(b"\n", b" \x01\n \x02")  # a single line break is a token of its own
    if prose:
        text = text.replace(b". ", b" \x01. ").replace(b", ", b" \x01, ")
    return _FIRST + text


class WordEncoder:
    """Encodes UTF-8 texts to packed little-endian ids with a bounded memo."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        self.tokenizer = load_tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.family = tokenizer_family(self.tokenizer)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, [*added, _MARK, _FIRST])))
        self.letters = "".join(sorted(byte_letters(), key=byte_letters().get))  # of byte 0, 1, ...
        self.mark_runs: dict[str, bytes] = {"": b""}
        self.memo_entries = memo_entries
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def encode_text(self, text: bytes) -> bytes:
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype).tobytes()

    def piece_text(self, piece: bytes) -> bytes:
        if self.family == WORD:
            return piece
        return piece[1:] if piece[:1] in (_MARK, _FIRST) else b" " + piece if piece else b""

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece.

        A piece of letters only is one unit of the vocabulary's splitter and
        goes to the library's merge model as it is; so are letters and the
        marks that end the piece, each. Any other goes through the whole
        library.
        """
        tokenize, letters, spaced = self.tokenizer.model.tokenize, self.letters, self.family == BYTE
        code, runs = self.code, self.mark_runs
        out = []
        for piece in pieces:
            if len(piece) <= MEMO_PIECE:
                text, space = piece.decode("utf-8", "replace"), " " if spaced else ""
                if spaced and (piece[:1] == _FIRST or piece[:1] == _MARK):
                    text, space = text[1:], ""
                word = text.rstrip(_MARKS)
                if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                    # Word vocabularies fold case; Latin-1 letters are composed already.
                    unit = space + word if spaced else word.lower()
                    if spaced or not unit.isascii():
                        unit = charmap_decode(unit.encode(), "strict", letters)[0]
                    ids = array(code, [t.id for t in tokenize(unit)]).tobytes()
                    marks = text[len(word) :]
                    if marks not in runs:
                        if len(runs) > _MARK_RUNS:
                            runs.clear()
                            runs[""] = b""
                        runs[marks] = array(code, [t.id for t in tokenize(marks)]).tobytes()
                    out.append(ids + runs[marks])
                    continue
            out.append(self.encode_text(self.piece_text(piece)))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids (``self.dtype``) of each text."""
        out: list[bytes] = [b""] * len(texts)
        fast, at = [], []
        for i, text in enumerate(texts):
            if self.family == WORD:
                plain: bytes | None = separated_words(text)
            elif self.special.search(text):
                out[i] = self.encode_text(text)
                continue
            else:
                plain = separated_spaced(text)
            if plain is None:
                cut = [x for x in _SAFE_CUT.split(text) if x]
                out[i] = b"".join(self.look_up([x[1:] if _SAFE_CUT.match(x) else _FIRST + x for x in cut]))
            elif text:
                fast.append(plain)
                at.append(i)
        if fast:
            for i, ids in zip(at, self._encode_separated(fast)):
                out[i] = ids
        return out

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, from the memo or newly encoded.

        The memo has two halves: when the younger is full it becomes the older,
        whose pieces move back as they are used.
        """
        if len(self.memo) > self.memo_entries // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        found = list(map(memo.get, pieces))
        at = [i for i, ids in enumerate(found) if ids is None]
        if at:
            held = [older.get(pieces[i]) for i in at]
            new = [pieces[i] for i, ids in zip(at, held) if ids is None]
            made = iter(self.encode_pieces(new))
            for i, ids in zip(at, held):
                found[i] = ids = next(made) if ids is None else ids
                if len(pieces[i]) <= MEMO_PIECE:
                    memo[pieces[i]] = ids
        return found

    def _encode_separated(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array(texts, type=pa.binary()).view(pa.string())
        split = pc.ascii_split_whitespace(column) if self.family == WORD else pc.split_pattern(column, " ")
        coded = split.values.dictionary_encode()
        found = self.look_up(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(found), dtype=self.dtype)
        widths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        firsts = np.concatenate(([0], np.cumsum(widths)))
        pieces = coded.indices.to_numpy()
        width = widths[pieces]
        ends = np.concatenate(([0], np.cumsum(width)))
        flat = ids[np.repeat(firsts[pieces] - ends[:-1], width) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary in this process: later tasks of a worker find its memo filled."""
    return WordEncoder(path)
