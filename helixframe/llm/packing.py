"""Packing of tokenised documents into fixed windows by minimum bin slack.

Documents are cut at multiples of the window; what is left of each, shorter than a window, is packed
with others. Only the histogram of these lengths (fewer than `window` numbers, whatever the input)
reaches the driver. There, minimum bin slack fills one window at a time: the longest length left is
taken, a subset-sum table over bitsets picks the multiset of the others that comes closest to the
capacity, backtracking gives its counts, and the pattern repeats as often as the histogram allows.
Pieces then find their place by their rank among the pieces of their length. A task counts its own
pieces by length as it cuts them; the tasks' counts, added up in order, give each task its first rank of every
length, so no length is sorted or gathered, however frequent it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.durable import cut_lineage
from helixframe.llm.common import shape, slices
from helixframe.llm.encoders import byte_encoder


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the longest in it, whose sum is closest to the capacity: length -> count.

    Among equal sums the one found first, longer lengths before shorter ones.
    """
    first = max(length for length, n in counts.items() if n > 0)
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n > (x == first) and x <= room), reverse=True):
        most = min(counts[length] - (length == first), room // length)
        before, taken = reach, 1
        while most > 0:  # counts in binary parts
            part = min(taken, most)
            reach |= (reach << (part * length)) & full
            most -= part
            taken <<= 1
        steps.append((length, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out = {first: 1}
    for length, before in reversed(steps):
        while not before >> at & 1:
            out[length] = out.get(length, 0) + 1
            at -= length
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, length -> count) patterns that together use the whole histogram.

    A pattern repeats until fewer of some length are left than it takes, at most capacity // length. So there are
    at most about capacity * (1 + ln capacity) patterns (8,000 for 1024), whatever the input.
    """
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        pattern = fill(left, capacity)
        repeats = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
        out.append((repeats, pattern))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, count in a sequence, offset in a sequence)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + n * repeats
            out.append((length, first, used[length], sequence, n, offset))
            offset += n * length
        sequence += repeats
    return out


def pieces(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """The documents' token ids, cut at multiples of the window: doc_id, start, length, ids_crc32, doc_tokens,
    part (the task) and nth (the number of pieces of this length before, in this task)."""
    given = docs.select(F.col("doc_id").alias("key"), "text")
    kind = given.schema["key"].dataType
    made = ("start", "length", "ids_crc32", "doc_tokens", "part", "nth")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(vocabulary), np.array([end_id], "<u4")
        part, counts = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch, texts in slices(batches):
            row, out = [], []
            for k, text in enumerate(texts):
                ids = np.concatenate([encoder.encode(text.decode()), end])
                for s in range(0, len(ids), window):
                    piece = ids[s : s + window]
                    row.append(k)
                    out.append((s, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, counts[len(piece)]))
                    counts[len(piece)] += 1
            columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), *columns], names=["key", *made])

    return given.mapInArrow(cut, shape(key=kind, **dict.fromkeys(made, "long"))).withColumnRenamed("key", "doc_id")


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty: their document is the end id alone. Repeated rows are packed as often
    as they occur; a null doc_id stays null. Other columns of `docs` are not read. No row is dropped. An empty table
    gives an empty result. A text of any length is encoded whole, in its worker.
    """
    # Written once, so that parts and ranks are fixed whatever is lost later.
    cut = cut_lineage(pieces(docs, vocabulary, window, end_id))
    counts = cut_lineage(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    slots = docs.sparkSession.createDataFrame(places(plan(histogram, window)), "length long, first long, last long, sequence long, each long, at long")
    # A window's group has one row for each task.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("before", before)
    met = ranges.join(F.broadcast(slots), "length").filter((F.col("first") < F.col("before") + F.col("n")) & (F.col("last") > F.col("before")))
    of_part = met.groupBy("part", "length").agg(F.first("before").alias("before"), F.collect_list(F.struct("first", "last", "sequence", "each", "at")).alias("slots"))
    ranked = cut.join(of_part, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    slot = F.expr("element_at(filter(slots, s -> s.first <= rank and rank < s.last), 1)")
    placed = ranked.withColumn("slot", slot).withColumn("within", F.col("rank") - F.col("slot.first"))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.expr("slot.sequence + within div slot.each").alias("sequence_id"),
        F.expr("slot.at + (within % slot.each) * length").alias("offset"),
    )
