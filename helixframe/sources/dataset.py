"""Data sets with known truth: a manifest of files, truth sequences, and ledgers that say where every read comes from.

A data set is a folder with dataset.json, which lists every other file with its size and digest. Ledgers are
tables of fixed columns; their rules are checked by joins, each broken rule giving rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.sources import bundle
from helixframe.sources.fastx import InputError, records, sources

# The columns of the ledgers (fixed values of the formats), and their types.
LEDGERS = {
    "origins": "schema_version string, fragment_ordinal long, read_id string, mate_role string, molecule_id string, topology string, strand string, first_truth_base_zero_based long, truth_step int, read_length int, outer_fragment_start_zero_based long, outer_fragment_span long, wraps_origin boolean, pre_error_sequence_sha256 string, observed_sequence_sha256 string, quality_phred_sequence_sha256 string",
    "errors": "schema_version string, read_id string, observed_offset_zero_based int, truth_coordinate_zero_based long, error_kind string, truth_base string, observed_base string",
    "quality_events": "schema_version string, read_id string, observed_offset_zero_based int, event_kind string, quality_phred int",
}


def read_fasta(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """contig_id, seq of a FASTA file. A file without records is an error unless `allow_empty`, and then an empty table."""
    rows = records(spark, sources(spark, [path]))
    nothing = F.col("error") == "no records"
    bad = rows.filter(F.col("error").isNotNull() & ~nothing if allow_empty else F.col("error").isNotNull()).select("idx", "error").orderBy("idx").first()
    if bad is not None:
        raise InputError(f"{path}: {bad['error']}")
    return rows.filter("error IS NULL").select(F.col("read_id").alias("contig_id"), "seq")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, role, visibility, bytes, sha256 of the files that dataset.json lists."""
    listed = spark.read.option("multiLine", "true").json(f"{root}/dataset.json")
    if "files" not in listed.columns:
        raise InputError("dataset.json lists no files")
    return listed.select(F.inline("files")).select("path", "role", "visibility", F.col("bytes_decimal").cast("long").alias("bytes"), "sha256")


def manifest_errors(spark: SparkSession, root: str) -> DataFrame:
    """path, problem: files that leave the folder, are missing, unlisted, listed twice, of another size or changed."""
    listed = manifest(spark, root).groupBy("path").agg(F.count("*").alias("n"), F.min("bytes").alias("want_bytes"), F.min("sha256").alias("want"))
    both = listed.join(bundle.digests(spark, root).filter("path <> 'dataset.json'"), "path", "full")
    outside = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    problem = F.when(outside, "unsafe path").when(F.col("n") > 1, "duplicate").when(F.col("sha256").isNull(), "missing").when(F.col("n").isNull(), "unlisted").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def truths(spark: SparkSession, root: str) -> DataFrame:
    """molecule, truth_class, topology, seq: the truth sequences with what the manifest says of them. Raises where they differ."""
    described = spark.read.option("multiLine", "true").json(f"{root}/dataset.json").select("evaluation_truth.*")
    path = described.first()["fasta_path"]
    molecules = described.select(F.inline("molecules")).select(F.col("molecule_id").alias("molecule"), "truth_class", "topology", F.col("length_bases_decimal").cast("long").alias("n"), F.col("sequence_sha256").alias("digest"))
    both = molecules.join(read_fasta(spark, f"{root}/{path}").withColumnRenamed("contig_id", "molecule"), "molecule", "full")
    wrong = both.filter(F.col("n").isNull() | F.col("seq").isNull() | (F.length("seq") != F.col("n")) | (F.sha2("seq", 256) != F.col("digest"))).select("molecule").first()
    if wrong is not None:
        raise InputError(f"truth {wrong['molecule']} is not as described")
    return both.select("molecule", "truth_class", "topology", "seq")


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A ledger of tab-separated rows under exactly its header; a value of another type is an error when it is read."""
    want = [x.split()[0] for x in LEDGERS[kind].split(", ")]
    head = spark.read.text(path).first()
    if head is None or head["value"].split("\t") != want:
        raise InputError(f"{path}: not the header of {kind}")
    return spark.read.csv(path, sep="\t", header=True, schema=LEDGERS[kind], mode="FAILFAST", nullValue="NA", quote="")


def ledger_errors(reads: DataFrame, known: DataFrame, origins: DataFrame, errors: DataFrame, quality_events: DataFrame) -> DataFrame:
    """read_id, rule: every broken rule. `reads` has read_id, role, seq, qual, and `known` is `truths`.

    Every read has one origin and every origin a read of its length and digest; the truth at the origin has the digest
    before errors; every error's bases stand in truth and read at its places, and there are as many errors as
    differences; every quality event stands in the read.
    """
    key = F.concat_ws(" ", "read_id", "role")
    named = reads.select(key.alias("id"), "read_id", "seq", "qual")
    mates = origins.withColumn("role", F.when(F.col("mate_role").isin("R1", "R2"), F.col("mate_role")).otherwise("S")).withColumn("id", key)
    both = named.join(mates.drop("read_id"), "id", "full").join(known.select(F.col("molecule").alias("molecule_id"), F.col("topology").alias("shape"), F.col("seq").alias("truth")), "molecule_id", "left")
    n, size = F.length("truth"), F.col("read_length")
    low = F.when(F.col("truth_step") == 1, F.col("first_truth_base_zero_based")).otherwise(F.col("first_truth_base_zero_based") - size + 1)
    ring = F.col("shape") == "circular"
    text = F.substr(F.when(ring, F.concat("truth", "truth")).otherwise(F.col("truth")), (F.when(ring, F.pmod(low, n)).otherwise(low) + 1).cast("int"), size)
    told = both.withColumn("clean", F.when(F.col("truth_step") == 1, text).otherwise(dna.revcomp(text)))
    differences = F.size(F.filter(F.zip_with(F.split("clean", ""), F.split("seq", ""), lambda a, b: a != b), lambda x: x))
    counted = errors.groupBy("read_id").agg(F.count("*").alias("stated"))
    rules = {
        "a read without an origin": F.col("molecule_id").isNull(),
        "an origin without a read": F.col("seq").isNull(),
        "an origin on no truth": F.col("molecule_id").isNotNull() & F.col("truth").isNull(),
        "topology": F.col("topology") != F.col("shape"),
        "read length": F.length("seq") != size,
        "observed digest": F.sha2("seq", 256) != F.col("observed_sequence_sha256"),
        "digest before errors": F.sha2("clean", 256) != F.col("pre_error_sequence_sha256"),
    }
    told = told.withColumn("differences", differences)
    broken = told.select(F.coalesce("read_id", F.split("id", " ")[0]).alias("read_id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    sums = told.groupBy("read_id").agg(F.sum("differences").alias("differences")).join(counted, "read_id", "left").filter(F.col("differences") != F.coalesce("stated", F.lit(0))).select("read_id", F.lit("number of errors").alias("rule"))
    base = lambda c, i: F.substr(F.col(c), i + 1, F.lit(1))
    offset = F.col("observed_offset_zero_based")
    at = errors.join(told.select("read_id", "seq", "clean"), "read_id", "left")
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))  # noqa: E731 a mate of the read must fit
    wrong = at.groupBy("read_id", "observed_offset_zero_based", "truth_base", "observed_base").agg(some((base("seq", offset) == F.col("observed_base")) & (base("clean", offset) == F.col("truth_base"))).alias("fits")).filter("NOT fits").select("read_id", F.lit("an error that is not there").alias("rule"))
    event = quality_events.join(told.select("read_id", "qual"), "read_id", "left").groupBy("read_id", "observed_offset_zero_based", "quality_phred").agg(some(F.ascii(base("qual", offset)) - 33 == F.col("quality_phred")).alias("fits")).filter("NOT fits").select("read_id", F.lit("a quality that is not there").alias("rule"))
    return broken.unionByName(sums).unionByName(wrong).unionByName(event)
