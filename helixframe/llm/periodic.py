"""Periodic runs of words by block convolution.

A run of period q with at least four periods holds a whole aligned block of B words, B the largest power of two up to q,
that occurs again q words later. So for every scale B each block is compared with the window of the 2 * B words behind it:
the sum of squared differences of word numbers at all distances from B to 2 * B - 1 is one cyclic convolution, done
exactly with number-theoretic transforms modulo as many primes as its largest value asks for. Where it is zero, block and window
agree. Neighbouring blocks that agree at one distance make up a stretch; a stretch that may be long enough is
extended word by word, by less than a block on either side, and its exact length decides.

A stretch in a run of a smaller period is no run of its own; that run was found at a smaller scale, so the
stretch is left out before it is extended. Words that occur fewer than four times in a document stand in no run; they cut it
into segments, and only blocks within segments of four blocks are convolved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import release, shape, slices

#: A run has at least so many periods, and so many words.
PERIODS, WORDS = 4, 6
#: Primes with a primitive root each, for transforms of up to 2^26 words (fixed values).
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Words of windows that are transformed at a time, and bytes of text that are searched together.
CHUNK, SLICE = 1 << 16, 1 << 20


def _reduced(x: np.ndarray, prime: int) -> np.ndarray:
    """x mod prime (division by a scalar is vectorised, the remainder is not)."""
    return x - x // np.uint64(prime) * np.uint64(prime)


@lru_cache(64)
def _roots(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """The first `half` powers of a root of unity of order 2 * half (or of its inverse), as a column."""
    root = pow(generator, (prime - 1) // (2 * half), prime)
    root = pow(root, -1, prime) if inverse else root
    out, k = np.ones(half, np.uint64), 1
    while k < half:
        out[k : 2 * k] = _reduced(out[:k] * np.uint64(pow(root, k, prime)), prime)
        k *= 2
    return out[:, None]


def _transform(a: np.ndarray, prime: int, generator: int) -> None:
    """In place, along the first axis; frequencies stand in bit-reversed order."""
    n, m = a.shape
    p, half = np.uint64(prime), n // 2
    while half:
        pairs = a.reshape(n // (2 * half), 2, half, m)
        u, v = pairs[:, 0], pairs[:, 1]
        low = u + v
        pairs[:, 1] = _reduced((u - v + p) * _roots(prime, generator, half, False), prime)
        pairs[:, 0] = np.minimum(low, low - p)  # unsigned: what is below p wraps round
        half //= 2


def _back(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of `_transform`."""
    n, m = a.shape
    p, half = np.uint64(prime), 1
    while half < n:
        pairs = a.reshape(n // (2 * half), 2, half, m)
        u, v = pairs[:, 0], _reduced(pairs[:, 1] * _roots(prime, generator, half, True), prime)
        low, high = u + v, u - v + p
        pairs[:, 0] = np.minimum(low, low - p)
        pairs[:, 1] = np.minimum(high, high - p)
        half *= 2
    return _reduced(a * np.uint64(pow(n, -1, prime)), prime)


def mismatches_vanish(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For columns of B words and of 2 * B words (numbers from 0): whether the block equals the window at shift 0 to B - 1.

    The sum of squared differences is zero if it is zero modulo primes whose product is larger than it can be.
    """
    size, m = blocks.shape
    largest = size * int(max(blocks.max(initial=0), windows.max(initial=0))) ** 2
    zero, modulus = np.ones((size, m), bool), 1
    for prime, generator in PRIMES:
        a, b = np.zeros((2 * size, m), np.uint64), _reduced(windows.astype(np.uint64), prime)
        a[:size] = _reduced(blocks[::-1].astype(np.uint64), prime)
        own = _reduced(_reduced(a * a, prime).sum(axis=0), prime)
        sums = np.zeros((2 * size + 1, m), np.uint64)
        np.cumsum(_reduced(b * b, prime), axis=0, out=sums[1:])
        squares = _reduced(sums[size : 2 * size] - sums[:size], prime) + own
        _transform(a, prime, generator)
        _transform(b, prime, generator)
        cross = _back(_reduced(a * b, prime), prime, generator)[size - 1 : 2 * size - 1]
        zero &= _reduced(squares + np.uint64(2) * (np.uint64(prime) - cross), prime) == 0
        modulus *= prime
        if modulus > largest:
            return zero
    raise ValueError("a document of more than 2^26 words")


def _stretches(x: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, distance) of the neighbouring blocks that agree with what stands a distance of size to 2 * size - 1 behind."""
    padded = np.concatenate([x, np.zeros(3 * size, x.dtype)])
    at, apart = [], []
    columns = max(1, CHUNK // (2 * size))
    for first in range(0, len(starts), columns):
        part = starts[first : first + columns]
        equal = mismatches_vanish(padded[part + np.arange(size)[:, None]], padded[part + size + np.arange(2 * size)[:, None]])
        shift, block = np.nonzero(equal)
        at.append(part[block])
        apart.append(shift + size)
    at, apart = np.concatenate(at), np.concatenate(apart)
    order = np.lexsort((at, apart))
    at, apart = at[order], apart[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(apart) != 0) | (np.diff(at) != size)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], at[last] + size, apart[first]


def _agreeing(x: np.ndarray, at: int, apart: int, most: int, ahead: bool) -> int:
    """How many words from `at` on (or, not ahead, just before it), of at most `most`, equal those `apart` behind them."""
    done, step = 0, 64
    while done < most:
        k = min(step, most - done)
        first = at + done if ahead else at - done - k
        here = x[first : first + k]
        differs = np.flatnonzero((here != x[first + apart : first + apart + k]) | (here == 0))
        if len(differs):
            return done + (int(differs[0]) if ahead else k - 1 - int(differs[-1]))
        done, step = done + k, 2 * step
    return most


def find(x: np.ndarray) -> np.ndarray:
    """All runs of a sequence of word numbers, rows (start, length, period); a zero is a break that no run holds."""
    n = len(x)
    breaks = np.concatenate([[-1], np.flatnonzero(x == 0), [n]])
    lengths = np.diff(breaks) - 1
    of = np.repeat(np.arange(len(lengths)), np.diff(breaks))[:n]  # a break belongs to the segment before it
    ends = breaks[1:]
    runs, size = np.zeros((0, 3), np.int64), 1
    while len(lengths) and lengths.max() >= max(WORDS, PERIODS * size):
        starts = np.arange(0, n - size + 1, size)
        inside = (x[starts] != 0) & (ends[of[starts]] - starts >= size) & (lengths[of[starts]] >= max(WORDS, PERIODS * size))
        first, end, apart = _stretches(x, starts[inside], size)
        able = end - first + 2 * (size - 1) >= (PERIODS - 1) * apart
        first, end, apart = first[able], end[able], apart[able]
        if len(runs) and len(first):
            known = runs[np.argsort(runs[:, 0], kind="stable")]
            reach = known[:, 0] + known[:, 1]
            far = np.maximum.accumulate(reach)
            which = np.maximum.accumulate(np.where(reach == far, np.arange(len(known)), 0))
            before = np.searchsorted(known[:, 0], first, "right") - 1
            # Of the runs that start before, only the one that reaches farthest can hold a stretch of two periods.
            held = (before >= 0) & (far[before] >= end + apart) & (apart % known[which[before], 2] == 0)
            first, end, apart = first[~held], end[~held], apart[~held]
        found = []
        for s, e, d in zip(first.tolist(), end.tolist(), apart.tolist(), strict=True):
            s -= _agreeing(x, s, d, min(size - 1, s), ahead=False)
            e += _agreeing(x, e, d, min(size - 1, n - d - e), ahead=True)
            if e - s >= (PERIODS - 1) * d and e - s + d >= WORDS:
                found.append((s, e - s + d, d))
        if found:
            runs = np.concatenate([runs, np.array(found, np.int64)])
        size *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of a document's words: equal for equal words, 0 for those that occur too rarely to stand in a run."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    frequent = np.bincount(ids, minlength=len(index)) >= PERIODS
    return (np.cumsum(frequent) * frequent)[ids] if len(ids) else ids


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of several documents, searched together with a break between two."""
    parts, firsts, at = [], [], 0
    for words in documents:
        x = numbered(words)
        firsts.append(at)
        parts += [x, np.zeros(1, np.int64)]
        at += len(x) + 1
    found = find(np.concatenate(parts)) if parts else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(found[:, 0], [*firsts, at]).tolist()
    return [found[a:b] - np.array([first, 0, 0]) for a, b, first in zip(cuts, cuts[1:], firsts, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that stand behind the first period of a run, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length and period in words, by start, then period), collapsed (the
    text's words, joined by a space, each run cut down to its first period).

    A run is a maximal stretch of words with smallest period q that is at least 4 * q and at least 6 words long. Words are
    what the bytes space and 0x09 to 0x0D part. Null and empty texts have no words, no runs and an empty
    `collapsed`. Repeated rows stay repeated, a null doc_id stays null, other columns are not read, an empty table
    gives an empty result. A text is searched whole, in its worker, in memory in proportion to its length (up to 2^27 words).
    """
    given = docs.select(F.col("doc_id").alias("key"), "text")
    kind, run = given.schema["key"].dataType, pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches, size=SLICE):
            documents = [t.split() for t in texts]
            found = runs_of(documents)
            flat = np.concatenate(found)
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run)))
            texts_left = pa.array([collapsed(w, r) for w, r in zip(documents, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(map(len, documents)), pa.int64()), lists, texts_left], names=["key", "n_words", "runs", "collapsed"])

    schema = shape(key=kind, n_words="long", runs="array<struct<start:long,length:long,period:long>>", collapsed="string")
    return given.mapInArrow(search, schema).withColumnRenamed("key", "doc_id")


def looped(docs: DataFrame) -> DataFrame:
    """The documents, one in ten with its rest made periodic: doc_id, text.

    With h the CRC-32 of the decimal doc_id and g = h div 10: if h % 10 is 0, each word from a = g % n on becomes the word at
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). A text without words and a row without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    found = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr("0L").alias("zero"), F.floor(h / 10).alias("g"))
    sized = found.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) as int) + 1)), ' ')")
    return period.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def strongest() -> Column:
    """Of `runs` the one with the greatest length / period; of equal ones the first. Null without a run."""
    better = "r.length * best.period > best.length * r.period"
    return F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> if(best is null or {better}, r, best))")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without one), runs_sha256, collapsed_sha256."""
    found = periodic_runs(docs).withColumn("best", strongest())
    spelled = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
