"""Personal data: exact base patterns, and a BiLSTM-CRF tagger that adds spans.

Base spans follow fixed patterns and checks. The tagger is trained on windows
around labelled spans: base spans in a bounded sample of the corpus, and made
ones in other ways of writing (phones without a plus, e-mail with a written
at-sign or dot), among look-alikes that are no personal data. What it is taught
holds a digit, an at-sign (``@``, ``[at]``, ``(at)``) or a written dot, so only
windows that reach one, or the rest of its address, are decoded; overlapping
windows are reconciled by letting each character take its tag from the window
that sees it most centrally. The tagger decides: a span of whole words in which
each character has a posterior of ``MIN_POSTERIOR`` stands.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Tagger, classes_of
from .common import bound_batches, map_batches, record_batch

KINDS = ("email", "ip", "card", "phone")
# Where a part can only match whole, it gives nothing back (++), so that each pattern takes linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|\[at\]|\(at\)|[ \[(]dot[ \])]")
#: Any of which stands in or beside every span, and what a span of each kind holds.
_HINT = r"[0-9]|" + _AT.pattern
_HELD = (re.compile(r"@|\[at\]|\(at\)| at "), *[_DIGIT] * 3)
_BESIDE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Code points of a window and between the starts of windows.
WINDOW, STRIDE = 64, 32
#: Windows of the corpus that train the tagger at most, and made ones.
SAMPLE_WINDOWS, MADE_WINDOWS = 1500, 2000
#: The least posterior of a character's kind in a span that the tagger adds.
MIN_POSTERIOR = 0.8

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start; failing matches are dropped without retries."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # what stands before an at-sign belongs to no other one
        a = at
        while a > done and text[a - 1] in _BESIDE_AT:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on a fixed grid, that hold a digit or part of what stands around an at-sign."""
    grid: set[int] = set()
    for m in _DIGIT.finditer(text):
        k = m.start() // STRIDE
        grid.add(k)
        if k:
            grid.add(k - 1)  # the window before reaches over this one
    for m in _AT.finditer(text):
        a, b = m.span()
        a -= text[a - 1 : a] == " "
        while a and text[a - 1] in _BESIDE_AT:
            a -= 1
        b += text[b : b + 1] == " "
        while b < len(text) and text[b] in _BESIDE_AT:
            b += 1
        grid.update(range(max(0, a // STRIDE - 1), (b - 1) // STRIDE + 1))
    return [k * STRIDE for k in sorted(grid)]


def _made_windows(n: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """Windows with personal data in several ways of writing, and look-alikes without."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(k: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def word() -> str:
        made = "".join(letters[i] for i in rng.integers(0, 26, int(rng.integers(2, 9))))
        return made.capitalize() if rng.random() < 0.1 else made

    def card() -> str:
        head = digits(15)
        return head + next(d for d in "0123456789" if luhn(head + d))

    def one(kind: int) -> str:
        style = rng.random()
        if kind == 0:
            at = "@" if style < 0.45 else (" [at] " if style < 0.57 else ("(at)" if style < 0.69 else " at "))
            dot = " dot " if at == " at " else "."
            host = word() + (digits(1) if rng.random() < 0.5 else "") + (dot + word() if rng.random() < 0.3 else "")
            return f"{word()}{'.' + digits(2) if rng.random() < 0.5 else ''}{at}{host}{dot}{('com', 'org', 'net')[int(rng.integers(0, 3))]}"
        if kind == 1:
            return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
        if kind == 2:
            c = card()
            sep = "" if style < 0.6 else (" " if style < 0.8 else "-")
            return sep.join(c[i : i + 4] for i in (0, 4, 8, 12))
        a, b, c = digits(3), digits(3), digits(4)
        forms = (f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+44 {digits(4)} {digits(6)}", f"{a}.{b}.{c}")
        return forms[int(rng.integers(0, len(forms)))]

    def alike() -> str:
        k = int(rng.integers(0, 12))
        return (
            f"version {digits(1)}.{digits(1)}", digits(4), f"{digits(2)}.{digits(2)}.{digits(4)}", digits(12), digits(20),
            f"AKIA{digits(3).replace('0', 'Q')}{word().upper()}{digits(4)}", f"password={digits(3)}{word()}{digits(5)}",
            f"@{word()}", f"{digits(1)},{digits(3)},{digits(3)}", f"{word()} at {word()}", "dot", f"20{digits(2)}-{digits(2)}-{digits(2)}",
        )[k]

    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        while len(text) < WINDOW + 20:
            r = rng.random()
            if r < 0.18:
                kind = int(rng.integers(0, 4))
                piece = one(kind)
                own.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = alike() if r < 0.3 else word()
            text += piece + (" " if rng.random() < 0.8 else (". ", "\n", ", ", "; ", ") ")[int(rng.integers(0, 5))])
        cut = int(rng.integers(0, 20))
        end = cut + (WINDOW if rng.random() < 0.8 else int(rng.integers(8, WINDOW)))  # a text may end within a window
        texts.append(text[cut:end])
        spans.append([(k, max(0, a - cut), min(end, b) - cut) for k, a, b in own if b > cut and a < end])
    return texts, spans


def _tags(spans: list[Span], length: int = WINDOW) -> np.ndarray:
    """0 outside; 1 + 2 kind begins a span, 2 + 2 kind continues it."""
    out = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def _padded(text: str) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.uint8)
    found = classes_of(text)
    out[: len(found)] = found
    return out


@dataclass
class Finder:
    """The trained tagger."""

    tagger: Tagger

    def all_spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and added spans of each text."""
        base = [base_spans(t) for t in texts]
        starts = [window_starts(t) for t in texts]
        added: list[list[Span]] = [[] for _ in texts]
        flat = [(i, a) for i, own in enumerate(starts) for a in own]
        by_text: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for at in range(0, len(flat), 4096):
            group = flat[at : at + 4096]
            tags, sure = self.tagger.decode(np.stack([_padded(texts[i][a : a + WINDOW]) for i, a in group]))
            for (i, a), row, own in zip(group, tags, sure):
                by_text.setdefault(i, []).append((a, row, own))
        for i, held in by_text.items():
            if any(row.any() for _, row, _ in held):
                added[i] = _fitting(texts[i], base[i], _reconcile(texts[i], held))
        return list(zip(base, added))


def _reconcile(text: str, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, float]]:
    """One tag for each character, from the window in which it is most central; then runs as spans with their least posterior."""
    out: list[tuple[int, int, int, float]] = []
    starts = [a for a, _, _ in windows]
    size = WINDOW + max(starts)
    tag, central, share = np.zeros(size, np.uint8), np.full(size, -1), np.zeros(size, np.float32)
    inside = np.arange(WINDOW)
    for start, row, sure in windows:
        depth = np.minimum(inside + (WINDOW if start == 0 else 0), WINDOW - 1 - inside)
        better = np.flatnonzero(depth > central[start : start + WINDOW])
        central[start + better], tag[start + better], share[start + better] = depth[better], row[better], sure[better]
    for at in np.flatnonzero(tag[: len(text)]).tolist():
        kind, sure = (int(tag[at]) - 1) // 2, float(share[at])
        if tag[at] % 2 == 0 and out and out[-1][0] == kind and out[-1][2] == at:
            out[-1] = (kind, out[-1][1], at + 1, min(out[-1][3], sure))
        else:
            out.append((kind, at, at + 1, sure))
    return out


def _fitting(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """The tagger's spans of whole words that it is sure of and that touch no base span.

    An e-mail address without an at-sign, any other span without a digit and a
    card with a wrong check digit are none.
    """
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, furthest = [a for a, _ in taken], [], 0
    for _, b in taken:
        furthest = max(furthest, b)
        reach.append(furthest)
    out: list[Span] = []
    for kind, a, b, sure in found:
        while b > a and text[b - 1] in " .,;:!?\n":
            b -= 1
        while a < b and text[a] in " .,;:!?\n":
            a += 1
        cut = (a > 0 and text[a - 1].isalnum() and text[a : a + 1].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1 : b].isalnum())
        k = bisect_left(starts, b)  # base spans that begin before this one ends
        if b <= a or sure < MIN_POSTERIOR or cut or (k and reach[k - 1] > a) or not _HELD[kind].search(text, a, b):
            continue
        if kind == KINDS.index("card") and not luhn("".join(_DIGIT.findall(text[a:b]))):
            continue
        out.append((kind, a, b))
    return out


def train(docs: DataFrame, windows: int = SAMPLE_WINDOWS, made: int = MADE_WINDOWS) -> Finder:
    """Train on a bounded sample of windows around digits and at-signs, labelled by the base patterns, and made ones.

    The sample is the ``windows`` of the smallest hashes; a task hands on no
    more than that many. It does not depend on how rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[str, bytes]] = {}  # of this task, cut back to the smallest ranks as it grows
        limit = 1 << 56
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = None
                for a in window_starts(text):
                    piece = text[a : a + WINDOW]
                    rank = int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                    if rank >= limit or rank in best:
                        continue
                    spans = base_spans(text) if spans is None else spans
                    own = [(k, max(0, x - a), min(WINDOW, y - a)) for k, x, y in spans if y > a and x < a + WINDOW]
                    best[rank] = (piece, _tags(own).astype("u1").tobytes())
                    if len(best) >= 2 * windows + 2:
                        kept = sorted(best)[: windows + 1]
                        best, limit = {r: best[r] for r in kept[:-1]}, kept[-1]
        ranks = sorted(best)[:windows]
        yield record_batch(
            text=pa.array([best[r][0] for r in ranks], type=pa.string()),
            tags=pa.array([best[r][1] for r in ranks], type=pa.binary()),
            rank=pa.array(ranks, type=pa.int64()),
        )

    bound_batches(docs.sparkSession)
    hinted = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(_HINT))
    found = hinted.mapInArrow(run, "text string, tags binary, rank bigint").dropDuplicates(["rank"])
    rows = found.orderBy("rank", "text").limit(windows).collect()
    texts, spans = _made_windows(made, seed=5)
    chars = np.stack([_padded(t) for t in texts] + [_padded(r["text"]) for r in rows])
    gold = np.stack([_tags(s) for s in spans] + [np.frombuffer(r["tags"], "u1").astype(np.int64) for r in rows])
    tagger = Tagger(tags=1 + 2 * len(KINDS))
    tagger.fit(chars, gold)
    return Finder(tagger)


def find_personal_data(docs: DataFrame, finder: Finder) -> DataFrame:
    """``doc_id, base, added`` for each row: spans as ``kind:start:end`` strings, code points, end exclusive.

    A null text is empty; repeated rows stay; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = finder.all_spans(batch.column(1).to_pylist())
            base, added = zip(*found) if found else ((), ())
            return record_batch(
                doc_id=batch.column(0),
                base=pa.array([[f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(s)] for s in base], type=pa.list_(pa.string())),
                added=pa.array([[f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(s)] for s in added], type=pa.list_(pa.string())),
            )

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
    return map_batches(rows, make, "doc_id bigint, base array<string>, added array<string>")


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """``docs`` with each span replaced by ``[KIND]`` and, where there is such a column, ``n_chars`` counted anew."""
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            found = finder.all_spans([t or "" for t in texts])
            out = []
            for text, (base, added) in zip(texts, found):
                out.append(text if text is None else _without(text, base + added))
            columns = list(batch.columns)
            columns[at] = pa.array(out, type=columns[at].type)
            if counted is not None:
                held = columns[counted].to_pylist()
                n = [h if t is None else len(t) for t, h in zip(out, held)]
                columns[counted] = pa.array(n, type=columns[counted].type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_batches(docs, make, docs.schema)


def _without(text: str, spans: list[Span]) -> str:
    """Overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
