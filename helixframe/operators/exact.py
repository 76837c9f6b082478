"""Exact occurrences of whole spellings in targets of any length, in space that grows with the bases alone.

Targets are posted by grams (a hash, the target, the place), queries by one of their seeds: the first, or where that
is frequent the rarest of several, by posting counts. What meets is compared on pieces of the query and
overlapping blocks of the target, so no row ever carries the rest of a long sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.durable import never_broadcast, stored

#: Bases of a piece, postings up to which the first seed is taken, and seeds that are looked at beyond.
PIECE, RARE, SEEDS = 1024, 16, 16


def _postings(targets: DataFrame, queries: DataFrame, seed: int) -> DataFrame:
    """gram, t1, t2, start of every place of a target; for queries shorter than a seed also of grams of their lengths."""
    lengths = queries.select(F.least(F.length("s"), F.lit(seed)).alias("q")).distinct()  # `seed` rows at most
    named = targets.select(F.xxhash64("target").alias("t1"), F.xxhash64(F.lit(1), "target").alias("t2"), "seq")
    placed = named.join(F.broadcast(lengths), F.length("seq") >= F.col("q")).select("t1", "t2", "seq", "q", F.explode(F.sequence(F.lit(0), F.length("seq") - F.col("q"))).alias("start"))
    return placed.select(F.xxhash64("q", F.substr("seq", F.col("start") + 1, F.col("q"))).alias("gram"), "t1", "t2", "start")


def _chosen(queries: DataFrame, postings: DataFrame, seed: int) -> DataFrame:
    """query, strand, s, gram, shift, n: of every query the seed that is looked up, and its postings; queries without a posting are gone."""
    tally = never_broadcast(postings.groupBy("gram").agg(F.count("*").alias("n")))
    q = F.least(F.length("s"), F.lit(seed))
    at = lambda shift: F.xxhash64(q, F.substr("s", shift + 1, q))
    first = queries.filter(F.length("s") > 0).withColumn("gram", at(F.lit(0))).withColumn("shift", F.lit(0)).join(tally, "gram")
    common = first.filter(F.col("n") > RARE).select("query", "strand", "s", F.explode(F.sequence(F.lit(0), F.least(F.lit((SEEDS - 1) * seed), F.length("s") - q), q)).alias("shift"))
    counted = common.withColumn("gram", at(F.col("shift"))).join(tally, "gram", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)), "shift")
    rarest = counted.groupBy("query", "strand").agg(F.min_by(F.struct("s", "gram", "shift", "n"), rank).alias("x")).filter("x.n IS NOT NULL")
    return first.filter(F.col("n") <= RARE).select("query", "strand", "s", "gram", "shift", "n").unionByName(rarest.select("query", "strand", "x.s", "x.gram", "x.shift", "x.n"))


def occurrences(queries: DataFrame, targets: DataFrame, seed: int, piece: int = PIECE, one_piece: bool = False) -> DataFrame:
    """query, strand, target, start, seed_postings: every place where a whole query stands in a target, and how many places its seed has.

    `queries` has query, strand and s (not null; empty ones have no place), `targets` has target and seq. With
    `one_piece` no query is longer than a piece, so the pieces of a place need not be counted together.
    """
    # A place in a string is found by counting letters from its start, in bytes at once.
    queries, targets = queries.withColumn("s", F.col("s").cast("binary")), targets.withColumn("seq", F.col("seq").cast("binary"))
    postings = _postings(targets, queries, seed)
    # The seeds are stored, so that what counting the postings shuffled is gone before they are shuffled themselves.
    met = stored(_chosen(queries, postings, seed)).join(never_broadcast(postings), "gram").filter("start >= shift").select("query", "strand", "s", "n", "t1", "t2", (F.col("start") - F.col("shift")).alias("start"))
    number = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / piece).cast("int")))
    cut = targets.select("target", F.xxhash64("target").alias("t1"), F.xxhash64(F.lit(1), "target").alias("t2"), "seq", F.explode(number).alias("block"))
    blocks = cut.select("target", "t1", "t2", "block", F.substr("seq", F.col("block") * piece + 1, F.lit(2 * piece)).alias("text"))
    pieces = F.floor((F.length("s") - 1) / piece).cast("int") + 1
    parts = met.select("query", "strand", F.col("n").alias("seed_postings"), "t1", "t2", "start", pieces.alias("pieces"), F.posexplode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.substr("s", p * piece + 1, F.lit(piece)))).alias("p", "part"))
    placed = parts.withColumn("at", F.col("start") + F.col("p") * piece).withColumn("block", F.floor(F.col("at") / piece).cast("int"))
    same = placed.join(never_broadcast(blocks), ["t1", "t2", "block"]).filter(F.substr("text", F.col("at") - F.col("block") * piece + 1, F.length("part")) == F.col("part"))
    if one_piece:
        return same.select("query", "strand", "target", "start", "seed_postings")
    return same.groupBy("query", "strand", "target", "start", "seed_postings", "pieces").agg(F.count("*").alias("n")).filter("n = pieces").select("query", "strand", "target", "start", "seed_postings")
