"""Token counts of a document's sections, from one encoding of the whole document.

Each token keeps its span in the text, each section its own; the two ordered lists of intervals are
merged (a search of every token's ends among the sections' starts). A token over a boundary is
counted once: for the section that holds most of its bytes, the earlier one on a tie. So a document's
section counts always add up to its token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import quoted, shape, slices
from helixframe.llm.encoders import byte_encoder


def owners(token_ends: np.ndarray, section_starts: np.ndarray) -> np.ndarray:
    """The section of each token. `section_starts` ascends from 0; of equal starts only the last section can hold bytes."""
    starts = np.concatenate([token_ends[:1] * 0, token_ends[:-1]])
    low = np.searchsorted(section_starts, starts, "right") - 1
    high = np.searchsorted(section_starts, np.maximum(token_ends - 1, starts), "right") - 1
    for k in np.flatnonzero(low != high).tolist():
        edges = np.clip(section_starts[low[k] : high[k] + 1], starts[k], None)
        held = np.diff(np.append(edges, token_ends[k]))
        low[k] += int(np.argmax(held))  # the first of the largest
    return low


def section_tokens(docs: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("text",), by_line: bool = True) -> DataFrame:
    """One row per section: doc_id, section_no, field, start_char, end_char, n_tokens.

    The document that is encoded is its fields joined by a newline; a section is a field or, with
    `by_line`, a line of one with its newline. A null field counts as empty. An empty document has one
    section of no characters and no tokens, as has every empty field. Repeated rows stay repeated, a
    null doc_id stays null, and no other column of `docs` is read. An empty table gives an empty result. A
    text of any length is encoded whole, in its worker.
    """
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        for batch, texts in slices(batches):
            row, number, field, first, last, tokens = [], [], [], [], [], []
            ends = [np.cumsum(encoder.token_bytes[encoder.encode(t.decode())]) for t in texts]
            sizes = batch.column("sizes").to_pylist()
            for k, text in enumerate(texts):
                data = np.frombuffer(text, np.uint8)
                field_starts = np.cumsum([0, *(s + 1 for s in sizes[k][:-1])])
                starts, of = field_starts, np.arange(len(names))
                if by_line:
                    lines = np.flatnonzero(data == 10) + 1
                    lines = lines[(lines < len(data)) & ~np.isin(lines, field_starts)]
                    starts = np.concatenate([field_starts, lines])
                    of = np.concatenate([of, np.searchsorted(field_starts, lines, "right") - 1])
                    order = np.argsort(starts, kind="stable")
                    starts, of = starts[order], of[order]
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                found = np.bincount(owners(ends[k], starts), minlength=len(starts)) if len(ends[k]) else np.zeros(len(starts), np.int64)
                at = chars[np.append(np.minimum(starts, len(data)), len(data))]
                row += [k] * len(starts)
                number += range(len(starts))
                field += [names[x] for x in of.tolist()]
                first += at[:-1].tolist()
                last += at[1:].tolist()
                tokens += found.tolist()
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(long(row)), long(number), pa.array(field, pa.string()), long(first), long(last), long(tokens)], names=["key", "section_no", "field", "start_char", "end_char", "n_tokens"])

    whole = [F.coalesce(F.col(quoted(f)).cast("string"), F.lit("")) for f in names]
    given = docs.select(F.col("doc_id").alias("key"), F.concat_ws("\n", *whole).alias("text"), F.array(*[F.octet_length(x).cast("long") for x in whole]).alias("sizes"))
    kind = given.schema["key"].dataType
    return given.mapInArrow(count, shape(key=kind, section_no="long", field="string", start_char="long", end_char="long", n_tokens="long")).withColumnRenamed("key", "doc_id")
