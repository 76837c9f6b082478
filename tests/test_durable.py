from pathlib import Path

from pyspark.sql import functions as F

from helixframe import durable
from helixframe.operators import evaluation, exact, graph


def shuffle_files(spark) -> int:
    return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()


def folders(spark) -> set[str]:
    return {p.name for p in Path(durable.shared_folder(spark).removeprefix("file:")).glob("rows-*")}


def test_stored_rows_are_the_same_and_leave_no_shuffle_files(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.array(F.struct("id")).alias("b"), F.lit(None).cast("string").alias("c"))
    summed = rows.repartition("a").groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("b"), F.max("c").alias("c"))
    before = shuffle_files(spark)
    held = durable.stored(summed)
    assert shuffle_files(spark) <= before
    assert held.dtypes == summed.dtypes and sorted(held.collect()) == sorted(summed.collect())
    assert spark.conf.get(durable._FREE, "false") == "false"


def test_only_the_result_of_a_block_is_left(spark):
    counts = spark.createDataFrame([("AAC", 2), ("ACG", 3), ("CGG", 2), ("ACA", 2)], "kmer string, support long")
    before = folders(spark)
    units = durable.settled(spark, lambda: graph.unitigs(counts, 3))
    assert len(folders(spark) - before) == 1
    assert sorted(units.collect()) == sorted(graph.unitigs(counts, 3).collect())


def test_shuffles_of_earlier_steps_are_gone_before_later_ones(spark):
    """Seeds are chosen by counts of postings, and boundaries by windows of truths, before anything else is shuffled."""
    text = "ACGGTCATTGCAGGATCCATTTGACCAGTAACCGTTAGG"
    queries = spark.createDataFrame([("q", "+", text[5:25])], "query string, strand string, s string")
    found = exact.occurrences(queries, spark.createDataFrame([("t", text)], "target string, seq string"), 8, one_piece=True)
    assert [(r.target, r.start) for r in found.collect()] == [("t", 5)]
    assert "partial_count" not in found._jdf.queryExecution().executedPlan().toString()
    truths = spark.createDataFrame([(1, "primary", text)], "molecule long, truth_class string, seq string")
    rows = evaluation.junctions(spark.createDataFrame([("c", text[:20] + "T" + text[22:])], "contig_id string, seq string"), truths, 6, correct=False)
    assert "LeftAnti" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.classification for r in rows.collect()} <= {"false_junction", "indeterminate_unmapped_flank", "indeterminate_ambiguous_flank"} and rows.count() > 0
