"""Bounded samples of labelled documents, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many labels are broadcast at most (more are an error), and so many documents of all labels together are sampled at most.
MAX_LABELS, MAX_ROWS = 4096, 6000
#: Samples are drawn among texts of at most so many bytes; scoring is of whole texts of any length. So a sample has 400 MB at the very most.
MAX_BYTES = 1 << 16


def fold(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def sample(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """At most about `bound` rows of each label (null labels: none), those with the smallest hashes of doc_id.

    Which rows are taken depends on ids alone. Labels are counted over all rows; the number kept of a
    label is binomial around the bound where there are more. With many labels the bound is lower, so that
    all together stay within MAX_ROWS.
    """
    known = rows.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy(label).agg(F.count("*").alias("of_label"))
    found = counts.limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels in {label}")
    bound = min(bound, max(1, MAX_ROWS // max(1, len(found))))
    counts = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.join(counts, label).filter(share * F.col("of_label") < bound).drop("of_label")


def stretch(text: str = "text") -> Column:
    """A text, or of one over MAX_BYTES a stretch from its middle: for fits on what is alike all over a text, as a language is."""
    n = MAX_BYTES // 4  # a character has four bytes at most
    middle = F.substr(text, F.floor((F.length(text) - n) / 2).cast("int") + 1, F.lit(n))
    return F.when(F.octet_length(text) <= MAX_BYTES, F.col(text)).otherwise(F.when(F.length(text) <= n, F.col(text)).otherwise(middle))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled documents, ordered by id.

    A document with several labels counts with its largest, one with several texts with the smallest;
    labels other than 0 and 1 are left out. It is drawn among the texts of at most MAX_BYTES. A label that no
    such text has, but longer ones have, is an error: a model without it would tell nothing. Only the sampled ids
    are joined to the texts.
    """
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).filter("label IN (0, 1)")
    sizes = docs.select("doc_id", F.octet_length("text").alias("bytes")).filter(F.col("doc_id").isNotNull() & F.col("bytes").isNotNull())
    known = sizes.join(one, "doc_id").groupBy("doc_id", "label").agg(F.min("bytes").alias("bytes"))
    ids = sample(known.filter(F.col("bytes") <= MAX_BYTES).select("doc_id", "label"), "label", bound)  # two labels: about 2 * bound rows at most, so they can be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") <= MAX_BYTES).select("doc_id", "text", "label").collect()
    least: dict = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["text"])):
        least.setdefault(r["doc_id"], (r["text"], int(r["label"])))
    out = list(least.values())
    if len({y for _, y in out}) < 2:
        lost = {r["label"] for r in known.select("label").distinct().collect()} - {y for _, y in out}
        if lost:
            raise ValueError(f"all texts with {label} {sorted(lost)} have more than {MAX_BYTES} bytes")
    return out
