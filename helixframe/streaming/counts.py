"""k-mer support of a stream of reads, and the check that a stream's ordinals have no gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import kmers


def streaming_counts(frags: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """kmer, support of all fragments so far; for output modes `complete` and `update`."""
    return kmers.count_kmers(frags, k, minimum_quality)


def streaming_window_classes(reads: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """class, windows of all reads so far."""
    return kmers.windows(reads, k, minimum_quality).groupBy("class").agg(F.count("*").alias("windows"))


def ordinal_gaps(rows: DataFrame) -> DataFrame:
    """lane, first, last, fragments: lanes whose fragment ordinals are not one unbroken run; batch or stream."""
    seen = rows.groupBy("lane").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("fragments"))
    return seen.filter("last - first + 1 <> fragments")
