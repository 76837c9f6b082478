"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments, 32 small numbers. One
differing bit changes one number by one, so the Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. The segments form three blocks; if two fingerprints differ
in at most four bits, two of the blocks together are within Manhattan distance two of each other. For
each pair of blocks the embedding is a point of an integer grid, and every point goes to its own cell
and those one step away: two points within distance two meet in a cell. In the cells, pairs are
verified exactly on the 64 bits.

Copies share a fingerprint, so only distinct fingerprints are joined. A cell yields at most one link
per member (a spanning forest of its verified links), not all pairs. Cells over CELL members are not
searched pair by pair: their members are linked through the points of Hamming space within two bits of
them, which two fingerprints share exactly if they differ in at most four bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.durable import cut_lineage
from helixframe.llm.common import quoted, release, shape, slices
from helixframe.operators.components import connected_components

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Bits of a segment, and blocks of segments. Two random fingerprints meet in a cell with about one chance in a million; with
#: segments of one bit, for corpora beyond some 10 million distinct texts, with one in a billion, for half as many cells more.
SEGMENT_BITS, BLOCKS = 2, 3
#: Members up to which a cell is searched pair by pair.
CELL = 2048


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; of no words, zero."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(body, SEED)]
    else:
        starts = [0]
        at = 0
        for w in words:
            at += len(w) + 1
            starts.append(at)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)]
    bits, n = np.zeros(64, np.int64), len(hashes)
    for first in range(0, n, 65536):
        part = np.array(hashes[first : first + 65536], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column and fp (the fingerprint as a signed 64-bit integer) of every row.

    Null texts count as empty, and these have fingerprint zero. Repeated rows stay repeated and null keys null;
    no other column is read. An empty table gives an empty result. A text of any length is read whole.
    """
    given = docs.select(F.col(quoted(key)).alias("key"), "text")
    kind = given.schema["key"].dataType

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches):
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], names=["key", "fp"])

    return given.mapInArrow(hashed, shape(key=kind, fp="long")).withColumnRenamed("key", key)


def cells(fps: np.ndarray, segment_bits: int = SEGMENT_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, index of the fingerprint) arrays: each point's own cell and those one step away, for each pair of blocks."""
    segments = 64 // segment_bits
    block = np.arange(segments) * BLOCKS // segments
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(len(fps), segments, segment_bits).sum(axis=2, dtype=np.int64)
    everyone = np.arange(len(fps))
    for k, pair in enumerate(combinations(range(BLOCKS), BLOCKS - 1)):
        chosen = np.flatnonzero(np.isin(block, pair))
        weight = (segment_bits + 1) ** np.arange(len(chosen), dtype=np.int64)
        own = counts[:, chosen] @ weight + (np.int64(k) << 56)
        yield own, everyone
        for j, segment in enumerate(chosen):
            for step in (-1, 1):
                at = np.flatnonzero((counts[:, segment] + step >= 0) & (counts[:, segment] + step <= segment_bits))
                yield own[at] + step * weight[j], at


def _in_cells(segment_bits: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for first in range(0, len(fps), 4096):
                part = fps[first : first + 4096]
                found = list(cells(part.view(np.uint64), segment_bits))
                cell = np.concatenate([c for c, _ in found])
                at = np.concatenate([a for _, a in found])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[at])], names=["cell", "fp"])

    return place


def forest(fps: np.ndarray) -> np.ndarray:
    """Rows (fingerprint, smallest fingerprint linked to it) that connect what is within DISTANCE, nothing else."""
    fps = np.sort(fps)
    bits, n = fps.view(np.uint64), len(fps)
    label, todo = np.full(n, -1), np.arange(n)
    for seed in range(n):  # breadth first from each fingerprint that is not reached yet
        if label[seed] >= 0:
            continue
        label[seed] = seed
        todo = todo[label[todo] < 0]
        wave = np.array([seed])
        while len(wave) and len(todo):
            near = np.zeros(len(todo), bool)
            for part in np.array_split(wave, max(1, len(wave) * len(todo) >> 20)):
                near |= (np.bitwise_count(bits[part][:, None] ^ bits[todo][None, :]) <= DISTANCE).any(axis=0)
            wave = todo[near]
            label[wave] = seed
            todo = todo[~near]
    out = np.flatnonzero(label != np.arange(n))
    return np.stack([fps[out], fps[label[out]]], axis=1)


def _linked(most: int):
    """Links of the cells of a partition that is sorted by cell. Over `most` members: each member with a null partner."""

    def rows(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)], names=["u", "v"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()

        def searched(members: np.ndarray) -> Iterator[pa.RecordBatch]:
            links = forest(members) if len(members) > 1 else ()
            new = [x for x in map(tuple, links.tolist()) if x not in known] if len(links) else []
            if new:
                if len(known) > 50_000:
                    known.clear()
                known.update(new)
                yield rows(*np.array(new, np.int64).T.copy())

        cell, kept, large = None, np.zeros(0, np.int64), False
        for batch in batches:
            at, fps = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            runs = np.flatnonzero((np.diff(edges) > 1) | (edges[:-1] == 0) | (edges[1:] == len(at)))  # the others are cells of one
            for a, b in zip(edges[runs].tolist(), edges[runs + 1].tolist(), strict=True):
                if a == b:
                    continue
                if at[a] != cell:
                    if not large:
                        yield from searched(kept)
                    cell, kept, large = at[a], fps[a:b], False
                else:
                    kept = np.concatenate([kept, fps[a:b]])
                if large or len(kept) > most:
                    yield rows(kept, None)
                    kept, large = kept[:0], True
        if not large:
            yield from searched(kept)

    return link


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.concatenate([np.zeros(1, np.uint64), one, [a | b for a, b in combinations(one, DISTANCE // 2)]])
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for first in range(0, len(fps), 64):
            part = fps[first : first + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["point", "fp"])


def links(fps: DataFrame, segment_bits: int = SEGMENT_BITS, cell: int = CELL) -> DataFrame:
    """Links u, v of distinct fingerprints whose components are those of all pairs within DISTANCE."""
    # Some hundred rows come of each fingerprint, so a small table is spread before.
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = spread.mapInArrow(_in_cells(segment_bits), "cell long, fp long")
    found = cut_lineage(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linked(cell), "u long, v long").distinct())
    dense = found.filter("v IS NULL").select(F.col("u").alias("fp")).distinct()
    points = dense.mapInArrow(_around, "point long, fp long")
    hubs = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).filter("v <> w").drop("w")
    stars = points.join(hubs, "point").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct()
    return found.filter("v IS NOT NULL").unionByName(stars)


def _components(prints: DataFrame, least, segment_bits: int) -> DataFrame:
    """fp, and `first`, the smallest `least` of any row of its component."""
    distinct = prints.groupBy("fp").agg(F.min(least).alias("least"))
    members = connected_components(links(distinct, segment_bits))
    labelled = distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Cut off, so that the join by component is not bound to this aggregate's partitions and can be split.
    firsts = cut_lineage(labelled.groupBy("component").agg(F.min("least").alias("first")))
    return labelled.join(firsts, "component").select("fp", "first")


def near_duplicates(docs: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows stay
    repeated and are linked. A null doc_id is never a component_id unless no other is reachable. Other
    columns of `docs` are not read. An empty table gives an empty result. A text of any length is read whole.
    """
    prints = cut_lineage(fingerprints(docs))
    of = _components(prints, "doc_id", segment_bits).select("fp", F.col("first").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The rows of `docs` without their near-duplicates: of each component one row, all its columns unchanged.

    That is the row with the smallest doc_id (null ids last), of equal ids one text of them; ids that stand for
    different texts lose none of these. Null and empty texts are one component. An empty table stays empty.
    """
    whole = F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])
    # A row goes by two hashes of its id and text, 128 bits; rows alike in both are one row here.
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2")).alias("key"), "text", whole.alias("row"))
    prints = cut_lineage(fingerprints(rows, "key"))
    first = _components(prints, "key", segment_bits).select("first.k1", "first.k2").distinct()
    kept = rows.select("key.k1", "key.k2", "row").join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
