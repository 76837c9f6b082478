"""Small helpers shared by the text operators: byte words, slices of Arrow batches, vector hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

T = TypeVar("T")

#: The bytes that separate words: space and 0x09 to 0x0D. ``bytes.split()`` splits at the same ones.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

#: Texts are worked on in slices of about this many bytes, so that a task's memory does not depend on the batch size.
SLICE_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3 over an array (a new array)."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


#: Powers of the hash's base are held for places of three digits of so many bits: for texts of any length that Arrow holds.
_DIGIT = 14


@lru_cache(2)
def _powers(bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the base, and of its inverse, of every value of each of the three digits of a place."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        tables = []
        for digit in range(3):
            step = pow(base, 1 << bits * digit, 1 << 64)
            table, k = np.ones(1 << bits, np.uint64), 1
            while k < len(table):
                table[k : 2 * k] = table[:k] * np.uint64(pow(step, k, 1 << 64))
                k *= 2
            tables.append(table)
        out.append(tables)
    return tuple(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each byte span of `data` (of less than 2^42 bytes); equal bytes give equal hashes wherever they stand."""
    n, bits = len(data), _DIGIT
    mask = (1 << bits) - 1
    up, down = _powers(bits)
    sums = np.zeros(n + 1, np.uint64)
    inner = sums[1:]
    inner += data
    inner += np.uint64(1)
    for k, first in enumerate(range(0, n, 1 << bits)):
        part = inner[first : first + (1 << bits)]
        middle, high = k & mask, k >> bits
        part *= up[0][: len(part)] * (up[1][middle : middle + 1] * up[2][high : high + 1])
    np.cumsum(inner, out=inner)
    back = down[0][starts & mask] * down[1][starts >> bits & mask]
    if n >> 2 * bits:
        back *= down[2][starts >> 2 * bits]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a buffer."""
    space = _IS_SPACE[data]
    edge = np.empty(len(data) + 1, np.int8)
    edge[0] = 1
    edge[-1] = 1
    edge[1:-1] = space[:-1] != space[1:]
    if len(data):
        edge[0], edge[-1] = not space[0], not space[-1]
    else:
        edge[:] = 0
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a newline between two; and each text's first byte, with one more entry for the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=firsts[1:])
    return np.frombuffer(b"\n".join(texts), np.uint8), firsts


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8, nulls as empty texts."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at least one row and about `size` bytes of text, and their texts as UTF-8.

    They are cut by Arrow's offsets, so only one slice at a time becomes Python objects.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            after = min(len(ends), int(np.searchsorted(ends, before + size)) + 1)
            part = batch.slice(first, after - first)
            yield part, utf8(part.column(column))
            first = after


_HELD: dict = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one table, made anew where another key's was there.

    Workers serve tasks of all operators in turn, so tables that each operator kept for itself would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what this worker keeps: for tasks that need its memory, and no table."""
    _HELD.clear()


def shape(**fields: DataType | str) -> StructType:
    """A schema of names and types; unlike DDL it holds structs whose fields have any names."""
    out = StructType()
    for name, kind in fields.items():
        out.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType if isinstance(kind, str) else kind)
    return out


def row_and_text(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`row`, a struct of the columns to keep but the text, and `text`: so that a text is sent to a worker once."""
    others = [F.col(quoted(c)).alias(c) for c in keep if c != "text"]
    return df.select((F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("row"), "text")


def kept_columns(keep: tuple[str, ...]) -> list[Column]:
    """The kept columns of what a worker gave back for `row_and_text`."""
    return [F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in keep]


def quoted(name: str) -> str:
    """A column's name for Spark's parser, whatever letters are in it."""
    return "`" + name.replace("`", "``") + "`"


def results(made: tuple[str, ...], keep: tuple[str, ...]) -> list[Column]:
    """The result columns beside kept ones. One whose name a kept column has takes `_2` (or 3, ...) behind it, so neither is lost."""
    taken, out = {c.lower() for c in keep}, []
    for name in made:
        free, n = name, 1
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(F.col(name).alias(free))
    return out
