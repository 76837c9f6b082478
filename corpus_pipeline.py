"""A training corpus from raw documents: five stages, each one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. Models are fitted on the labelled documents of the tables in `sf_dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.durable import cut_lineage
from helixframe.llm import packing, quality, simhash, substrings, toxicity
from helixframe.llm.common import kept_columns
from helixframe.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel machine rejects go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    keep = tuple(docs.columns)
    return toxicity.judged(docs, model, keep).filter("predicted = 0").select(*kept_columns(keep))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    keep = tuple(docs.columns)
    return quality.judged(docs, model, quality.THRESHOLD, keep).filter("kept").select(*kept_columns(keep))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest id; no other text goes."""
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that also stand elsewhere are cut out of every text."""
    keep = tuple(docs.columns)
    cut = substrings.cut(docs, keep)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    made = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return cut.select(*[made[c].alias(c) if c in made else kept for c, kept in zip(keep, kept_columns(keep), strict=True)])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token windows of what is left."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack_windows),
]
#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one keeps is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
