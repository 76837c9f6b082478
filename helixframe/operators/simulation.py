"""Truth-known read simulation: every draw is a hash of a seed and a counter, so it is the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna


def molecules(spark: SparkSession, seed: int, length: int, minor_every: int = 50, minor_from: int = 17) -> DataFrame:
    """molecule, truth_class, seq: a primary molecule and a minor one with a substitution at every `minor_every`th base."""
    base = F.substring(F.lit("ACGT"), dna.counter_random(F.lit(f"{seed}:truth"), F.col("id"), 4).cast("int") + 1, 1)
    rows = spark.range(length).select("id", base.alias("b"))
    turned = F.when((F.col("id") >= minor_from) & ((F.col("id") - minor_from) % minor_every == 0), F.translate("b", "ACGT", "CGTA")).otherwise(F.col("b"))
    made = rows.select("id", "b", turned.alias("m")).agg(F.array_sort(F.collect_list(F.struct("id", "b", "m"))).alias("s"))
    spell = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "")
    return made.select(F.explode(F.array(F.struct(F.lit(0).alias("molecule"), F.lit("primary").alias("truth_class"), spell("b").alias("seq")), F.struct(F.lit(1).alias("molecule"), F.lit("minor").alias("truth_class"), spell("m").alias("seq")))).alias("r")).select("r.*")


def simulate(truths: DataFrame, fragments: int, seed: int, read_length: int = 100, insert: int = 250, minor_ppm: int = 100_000, error_ppm: int = 0, low_quality_ppm: int = 0, circular: bool = False) -> DataFrame:
    """fragment_id, role, molecule, first, step, seq, qual, errors: read pairs with their origins.

    `first` is the truth coordinate of the read's first base and `step` its direction; `errors` lists
    (offset, truth base, observed base). A substitution draws one of the three other bases.
    """
    spark = truths.sparkSession
    drawn = spark.range(fragments).select(F.col("id").alias("fragment_id"), (dna.counter_random(F.lit(f"{seed}:class"), F.col("id"), 1_000_000) < minor_ppm).cast("int").alias("molecule"))
    named = truths.select("molecule", "seq", F.length("seq").alias("n"))
    placed = drawn.join(F.broadcast(named), "molecule")
    room = F.col("n") if circular else F.col("n") - insert + 1
    start = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:start:"), F.col("fragment_id").cast("string")), 256), 1, 15), 16, 10).cast("long") % room
    ringed = F.concat("seq", F.left("seq", F.lit(insert))) if circular else F.col("seq")
    insert_seq = F.substr(ringed, start.cast("int") + 1, F.lit(insert))
    mates = placed.select("fragment_id", "molecule", "n", start.alias("start"), insert_seq.alias("f")).select(
        "fragment_id",
        "molecule",
        F.inline(F.array(F.struct(F.lit("R1").alias("role"), F.left("f", F.lit(read_length)).alias("clean"), F.col("start").alias("first"), F.lit(1).alias("step")), F.struct(F.lit("R2").alias("role"), F.left(dna.revcomp("f"), F.lit(read_length)).alias("clean"), ((F.col("start") + insert - 1) % F.col("n")).alias("first"), F.lit(-1).alias("step")))),
    )
    who = F.concat_ws(":", F.col("fragment_id").cast("string"), "role")
    draw = lambda what, i, bound: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}:{what}"), who, i.cast("string")), 256), 1, 15), 16, 10).cast("long") % bound
    at = F.sequence(F.lit(0), F.lit(read_length - 1))
    hits = F.filter(at, lambda i: draw("error", i, 1_000_000) < error_ppm)
    change = lambda i: F.struct(i.alias("offset"), F.substr("clean", i + 1, F.lit(1)).alias("truth_base"), F.substring(F.replace(F.lit("ACGT"), F.substr("clean", i + 1, F.lit(1)), F.lit("")), (draw("base", i, 3) + 1).cast("int"), 1).alias("observed_base"))
    told = mates.withColumn("errors", F.transform(hits, change))
    seq = F.aggregate("errors", F.col("clean"), lambda s, e: F.concat(F.left(s, e["offset"]), e["observed_base"], F.substr(s, e["offset"] + 2)))
    qual = F.array_join(F.transform(at, lambda i: F.when(draw("quality", i, 1_000_000) < low_quality_ppm, "+").otherwise("I")), "")
    return told.select("fragment_id", "role", "molecule", "first", "step", seq.alias("seq"), qual.alias("qual"), "errors")


def replay_errors(reads: DataFrame, truths: DataFrame) -> DataFrame:
    """fragment_id, role of reads that their origin and error ledgers do not give: empty if all is well."""
    n = F.length("truth")
    at = F.sequence(F.lit(0), F.length("seq") - 1)
    told = reads.join(F.broadcast(truths.select("molecule", F.col("seq").alias("truth"))), "molecule")
    base = lambda i: F.substr("truth", dna.truth_coordinate(F.col("first"), F.col("step"), i, n).cast("int") + 1, F.lit(1))
    clean = F.array_join(F.transform(at, lambda i: F.when(F.col("step") < 0, F.translate(base(i), "ACGT", "TGCA")).otherwise(base(i))), "")
    seen = F.aggregate("errors", clean, lambda s, e: F.concat(F.left(s, e["offset"]), e["observed_base"], F.substr(s, e["offset"] + 2)))
    return told.filter(seen != F.col("seq")).select("fragment_id", "role")
