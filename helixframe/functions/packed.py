"""Spellings of up to 31 bases as 64-bit codes (two bits a base, A < C < G < T): array kernels for tasks, and column functions.

The kernels serve what no built-in function does in one pass over a read: all its windows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 31
#: Codes of bases in either case; 4 is any other letter.
_CODE = np.full(256, 4, np.uint8)
for _n, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODE[[ord(c) for c in _letters]] = _n


def base_codes(data: np.ndarray) -> np.ndarray:
    return _CODE[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty), and each row's first byte, with the end."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    whole = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The code and the reverse complement's code of every window of k bases (codes above 3 count as A: mask these windows)."""
    forward = (codes & 3).astype(np.uint64)
    backward = np.uint64(3) - forward
    out: tuple[np.ndarray, np.ndarray] | None = None
    size, held = 1, 0  # of `forward`, of `out`
    n = len(codes) - k + 1
    while True:
        if k & size:  # append the current block behind what is held
            if out is None:
                out, held = (forward, backward), size
            else:
                rest = len(out[0]) - size
                out = (out[0][:rest] << np.uint64(2 * size)) | forward[held : held + rest], (backward[held : held + rest] << np.uint64(2 * held)) | out[1][:rest]
                held += size
        if held == k:
            return out[0][:n], out[1][:n]
        rest = len(forward) - size
        forward, backward = (forward[:rest] << np.uint64(2 * size)) | forward[size:], (backward[size:] << np.uint64(2 * size)) | backward[:rest]
        size *= 2


def clean(bad: np.ndarray, k: int) -> np.ndarray:
    """Whether each window of k places holds no bad one."""
    sums = np.zeros(len(bad) + 1, np.int64)
    np.cumsum(bad, out=sums[1:])
    return sums[k:] == sums[:-k] if len(bad) >= k else np.zeros(0, bool)


def reads_of(seq: pa.Array, qual: pa.Array, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base codes of all reads with one bad place behind each, which places are bad, and each read's first place (with the end)."""
    data, firsts = text_bytes(seq)
    letters, starts = text_bytes(qual)
    n = len(firsts) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(firsts))
    codes = np.full(len(data) + n, 4, np.uint8)
    codes[at] = base_codes(data)
    bad = codes > 3
    if len(letters):  # reads without qualities have none
        has = np.diff(starts) > 0
        if (np.diff(starts)[has] != np.diff(firsts)[has]).any():
            raise ValueError("a read and its qualities differ in length")
        bad[at[np.repeat(has, np.diff(firsts))]] |= letters < 33 + minimum
    return codes, bad, firsts + np.arange(n + 1)


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    held, have = values, 1
    while have < size:
        step = min(have, size - have)
        held = np.minimum(held[: len(held) - step], held[step:])
        have += step
    return held


#: Groups of bits that change places with their neighbours, and which bits the lower ones of a pair are.
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def revcomp_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes (unsigned) of the reverse complements of coded spellings of k bases."""
    x = ~codes
    for bits, mask in _SWAPS:
        n, low = np.uint64(bits), np.uint64(mask)
        x = ((x & low) << n) | ((x >> n) & low)
    return x >> np.uint64(64 - 2 * k)


def revcomp_code(c, k: int) -> Column:
    """The code of the reverse complement of a coded spelling of k bases: swaps of ever larger groups of bits."""
    x = F.bitwise_not(F.col(c) if isinstance(c, str) else c)
    for bits, mask in _SWAPS:
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), bits).bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(low))
    return F.shiftrightunsigned(x, 64 - 2 * k)
