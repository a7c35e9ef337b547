"""Patched frame-of-reference coding of token ids.

A segment is one binary value: a header, per-block tables and the payload.

    magic "PFR1" | ids u32 | blocks u32 | outliers u32
    block minimum        u32 x blocks
    block width (bits)   u8  x blocks
    block start (words)  u32 x (blocks + 1)      index into the packed words
    outlier start        u32 x (blocks + 1)      index into the outlier lists
    packed words         u64                     4 * width words a block
    outlier position     u8  x outliers          within the block
    outlier remainder    u32 x outliers          bits above the width

A block holds ``BLOCK`` ids; the last one is filled with its first id.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
_LANE = 64
#: The share of a block's ids that must fit its width; the others are outliers.
FIT = 0.9
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIII")


def _widths(deltas: np.ndarray, fit: float) -> np.ndarray:
    """For each block, the least width that holds the share ``fit`` of its values."""
    need = int(np.ceil(deltas.shape[1] * fit))
    top = int(deltas.max(initial=0)).bit_length()
    width = np.full(len(deltas), top, dtype=np.uint8)
    for less in range(top - 1, -1, -1):
        fits = np.count_nonzero(deltas < np.uint32(1 << less), axis=1) >= need
        if not fits.any():
            break
        width[fits] = less
    return width


def pack(ids: np.ndarray, fit: float = FIT) -> bytes:
    """Encode unsigned 32-bit ids; an empty array is valid."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.uint32)
    full[:n] = ids
    if blocks:
        full[n:] = full[(blocks - 1) * BLOCK]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1, initial=0xFFFFFFFF) if blocks else np.zeros(0, np.uint32)
    deltas = rows - low[:, None]
    width = _widths(deltas, fit) if blocks else np.zeros(0, np.uint8)
    most = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    at_block, at = np.nonzero(deltas > most[:, None])
    rest = deltas[at_block, at] >> width[at_block].astype(np.uint32)
    outlier_start = np.concatenate(([0], np.cumsum(np.bincount(at_block, minlength=blocks)))).astype(np.uint32)
    lanes = BLOCK // _LANE
    start = np.concatenate(([0], np.cumsum(width.astype(np.int64) * lanes)))
    words = np.zeros(start[-1], dtype=np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        mask = np.uint32((1 << w) - 1)
        values = np.ascontiguousarray((deltas[chosen] & mask).reshape(-1, _LANE).T).astype(np.uint64)
        packed = np.zeros((w, values.shape[1]), dtype=np.uint64)
        for i in range(_LANE):
            word, shift = divmod(i * w, 64)
            packed[word] |= values[i] << np.uint64(shift)
            if shift + w > 64:
                packed[word + 1] |= values[i] >> np.uint64(64 - shift)
        places = start[chosen][:, None] + np.arange(lanes * w)
        words[places] = packed.T.reshape(len(chosen), lanes * w)
    return b"".join((
        _HEAD.pack(MAGIC, n, blocks, len(rest)),
        low.astype("<u4").tobytes(), width.tobytes(), start.astype("<u4").tobytes(),
        outlier_start.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
        at.astype(np.uint8).tobytes(), rest.astype("<u4").tobytes(),
    ))


class Segment:
    """Random access to the blocks of an encoded segment."""

    def __init__(self, data: bytes):
        magic, self.n, self.blocks, outliers = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        self.low = take("<u4", self.blocks)
        self.width = take("u1", self.blocks)
        self.start = take("<u4", self.blocks + 1)
        self.outlier_start = take("<u4", self.blocks + 1)
        self.words = take("<u8", int(self.start[-1]))
        self.outlier_at = take("u1", outliers)
        self.outlier_rest = take("<u4", outliers)

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end``; only the blocks that hold them are decoded."""
        end = self.n if end is None else end
        if end <= begin:
            return np.zeros(0, dtype=np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        width = self.width[first:last]
        rows = np.zeros((last - first, BLOCK), dtype=np.uint64)
        lanes = BLOCK // _LANE
        for w in np.unique(width[width > 0]).tolist():
            chosen = np.flatnonzero(width == w)
            places = self.start[first:last][chosen].astype(np.int64)[:, None] + np.arange(lanes * w)
            packed = np.ascontiguousarray(self.words[places].reshape(-1, w).T)
            mask = np.uint64((1 << w) - 1)
            values = np.empty((_LANE, packed.shape[1]), dtype=np.uint64)
            for i in range(_LANE):
                word, shift = divmod(i * w, 64)
                value = packed[word] >> np.uint64(shift)
                if shift + w > 64:
                    value |= packed[word + 1] << np.uint64(64 - shift)
                values[i] = value & mask
            rows[chosen] = values.T.reshape(len(chosen), BLOCK)
        a, b = int(self.outlier_start[first]), int(self.outlier_start[last])
        if b > a:
            counts = np.diff(self.outlier_start[first : last + 1].astype(np.int64))
            at_block = np.repeat(np.arange(last - first), counts)
            rows[at_block, self.outlier_at[a:b]] |= self.outlier_rest[a:b].astype(np.uint64) << width[at_block].astype(np.uint64)
        rows += self.low[first:last].astype(np.uint64)[:, None]
        return rows.reshape(-1)[begin - first * BLOCK : end - first * BLOCK].astype(np.uint32)
