"""BPE encoding and decoding with reuse of content-defined chunks.

A hash of the last bytes rolls over every text; where it meets a fixed pattern a chunk ends, so equal
passages of different documents fall into equal chunks wherever they stand. Each distinct chunk is
encoded once by a worker (a bounded table, chunks compared by their bytes).

A chunk's ids hold only away from its ends, since its neighbours may change what stands there. So every
join is repaired: the text from the left chunk's last words to the right chunk's first ones is encoded
again. Its ids must agree exactly with the left chunk's in a whole word before the join, and with the right
chunk's in one behind it, and only what lies between is replaced; if they do not agree, twice as many
words on either side are encoded again, and so on until they do. Words here end at spaces, which always
end a pre-token of the vocabulary, so beyond a word that agrees nothing of the other side is felt. A chunk
with too few spaces is encoded again whole.

The table lives in the worker, across the batches and tasks that it runs: joining chunks across the
cluster would move every text and all its ids, which costs more disk than the input has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import held, joined, mix, shape, slices
from helixframe.llm.encoders import WordEndEncoder

#: Bytes that the rolling hash sees, bits that end a chunk (512 bytes on average), and the bytes of text the table may hold.
ROLL, CHUNK_BITS, TABLE_BYTES = 16, 9, 6 << 20
#: Words on either side of a join that are encoded again at first; the outer one must agree.
REACH = 2


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """The bytes of a buffer before which a chunk ends: only the content of the ROLL bytes before counts.

    Of a run of neighbouring ends the first stays, and none falls inside a UTF-8 character.
    """
    if len(data) < ROLL:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint64)
    h = np.zeros(len(data) - ROLL + 1, np.uint64)
    for k in range(ROLL):
        h *= np.uint64(0x100000001B3)
        h += x[k : k + len(h)]
    at = np.flatnonzero(mix(h) & np.uint64((1 << CHUNK_BITS) - 1) == 0) + ROLL
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    return at[np.diff(at, prepend=-ROLL) >= ROLL] if len(at) else at


class ChunkTable:
    """Distinct chunks and their ids."""

    def __init__(self, encoder: WordEndEncoder):
        self.encoder, self.held = encoder, 0
        self.known: dict[bytes, np.ndarray] = {}
        self.cuts: dict[tuple[bytes, int], tuple | None] = {}
        self.seen = self.reused = self.grown = 0

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the chunks that are not known, in one call."""
        if self.held > TABLE_BYTES:
            self.known, self.cuts, self.held = {}, {}, 0
        new = [c for c in chunks if c not in self.known]
        self.known.update(zip(new, self.encoder.encode_many([c.decode() for c in new]), strict=True))
        self.held += sum(map(len, new))

    def _cut(self, chunk: bytes, reach: int) -> tuple | None:
        """A chunk cut `reach` spaces from its ends: text before, ids of the word before the cut, ids between the
        cuts, ids of the word behind the second cut, text behind it. None without so many spaces."""
        key = chunk, reach
        if key not in self.cuts:
            self.cuts[key] = self._cut_anew(chunk, reach)
        return self.cuts[key]

    def _cut_anew(self, chunk: bytes, reach: int) -> tuple | None:
        pieces = chunk.split(b" ", reach)
        if len(pieces) <= reach or pieces[-1].count(b" ") < reach:
            return None
        tail = pieces[-1].rsplit(b" ", reach)[1:]
        ids, words = self.known[chunk], self.encoder.words
        ends = np.concatenate([[0], np.flatnonzero(self.encoder.is_end[ids]) + 1])
        before, last = words(b" ".join(pieces[:-1]).decode()), words(pieces[-2].decode())
        behind, first = words(b" ".join(tail).decode()), words(tail[0].decode())
        low, high = ends[before], ends[len(ends) - 1 - behind]
        return b" ".join(pieces[:-1]), ids[ends[before - last] : low], ids[low:high], ids[high : ends[len(ends) - 1 - behind + first]], b" ".join(tail)

    def _planned(self, chunks: list[bytes], reach: int) -> tuple[list[bytes], list[tuple]]:
        """The stretches to encode again, one more than the cut chunks between them."""
        stretches, cores, open_ = [], [], b""
        for c in chunks:
            cut = self._cut(c, reach)
            if cut is None:
                open_ += c
            else:
                stretches.append(open_ + cut[0])
                cores.append(cut)
                open_ = cut[4]
        return [*stretches, open_], cores

    def _agree(self, again: list[np.ndarray], cores: list[tuple]) -> bool:
        """Whether each stretch ends with the ids of the word before a chunk's core, and starts with those of the word behind it."""
        same = lambda a, b: len(a) == len(b) and bool((a == b).all())
        return all(same(left[len(left) - len(core[1]) :], core[1]) and same(right[: len(core[3])], core[3]) for left, core, right in zip(again, cores, again[1:], strict=False))

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        encoder = self.encoder
        data, firsts = joined(texts)
        ends, buffer = chunk_ends(data), data.tobytes()
        lows, highs = np.searchsorted(ends, firsts[:-1], "right"), np.searchsorted(ends, firsts[1:] - 1, "left")
        cut: dict[int, list[bytes]] = {}
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k, (low, high) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
            if not texts[k]:
                continue
            if encoder.plain(text := texts[k].decode()):
                at = [int(firsts[k]), *ends[low:high].tolist(), int(firsts[k + 1]) - 1]
                cut[k] = [buffer[a:b] for a, b in pairwise(at)]
            else:
                out[k] = encoder.whole(text)
        chunks = {c for x in cut.values() for c in x}
        self.seen += sum(map(len, cut.values()))
        self.reused += sum(map(len, cut.values())) - sum(c not in self.known for c in chunks)
        self.learn(chunks)
        reach = REACH
        while cut:
            plans = {k: self._planned(x, reach) for k, x in cut.items()}
            distinct = list({s for stretches, _ in plans.values() for s in stretches})
            ids = dict(zip(distinct, encoder.encode_many([s.decode() for s in distinct]), strict=True))
            for k, (stretches, cores) in plans.items():
                again = [ids[s] for s in stretches]
                if self._agree(again, cores):
                    out[k] = np.concatenate([x for s, core in zip(again, cores, strict=False) for x in (s, core[2])] + [again[-1]])
                    del cut[k]
            self.grown += len(cut)
            reach *= 2
        return out


def _table(vocabulary: str) -> ChunkTable:
    return held(("chunks", vocabulary), lambda: ChunkTable(WordEndEncoder(vocabulary)))


def _mapped(docs: DataFrame, vocabulary: str, made: dict[str, str], row) -> DataFrame:
    given = docs.select(F.col("doc_id").alias("key"), "text")
    kind = given.schema["key"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)
        for batch, texts in slices(batches):
            columns = row(table.encode_many(texts), table.encoder)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns.values()], names=["key", *columns])

    return given.mapInArrow(encode, shape(key=kind, **made)).withColumnRenamed("key", "doc_id")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded: the whole texts' ids and what decoding them gives.

    Null and empty texts have no ids. Repeated rows stay repeated, a null doc_id stays null, and no
    other column of `docs` is read. An empty table gives an empty result. A text of any length is encoded whole,
    in its worker.
    """

    def row(found: list[np.ndarray], encoder: WordEndEncoder) -> dict[str, pa.Array]:
        lengths = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ids = pa.array(np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(pa.array(lengths), ids), "decoded": pa.array([encoder.decoded(x).decode() for x in found], pa.string())}

    return _mapped(docs, vocabulary, {"ids": "array<int>", "decoded": "string"}, row)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encodings, without moving them out of the worker."""

    def row(found: list[np.ndarray], encoder: WordEndEncoder) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([len(x) for x in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(encoder.decoded(x)).hexdigest() for x in found], pa.string()),
        }

    return _mapped(docs, vocabulary, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, row)
