"""Result bundles: FASTA, GFA, TSV, JSON and HTML, with digests and a manifest.

Tables are written by Spark, each as a folder of part files in presentation order; nothing is gathered
on the driver but counts, digests and a report of bounded length. A bundle is staged, checked and then
renamed, and never replaces another one. Files go through Hadoop's file system, so any store works.
"""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_lines(units: DataFrame, width: int = 80) -> DataFrame:
    """value: one FASTA record per row, longest first; equal lengths by sequence and id."""
    fields = [F.concat(F.lit(f" {c}="), F.col(c).cast("string")) for c in ("topology", "edge_steps", "canonical_kmers", "minimum_support", "lower_median_support", "maximum_support")]
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    text = F.concat(F.lit(">"), "unitig_id", F.lit(" length="), F.length("seq").cast("string"), *fields, F.lit("\n"), wrapped)
    return units.orderBy(F.length("seq").desc(), "seq", "unitig_id").select(text.alias("value"))


def gfa_lines(units: DataFrame, linked: DataFrame, k: int) -> DataFrame:
    """value: GFA 1 header, segments and links."""
    head = units.sparkSession.createDataFrame([(0, "", "H\tVN:Z:1.0")], "section int, ord string, value string")
    segment = F.concat_ws("\t", F.lit("S"), "unitig_id", "seq", F.concat(F.lit("TP:Z:"), "topology"), F.concat(F.lit("ES:i:"), F.col("edge_steps").cast("string")), F.concat(F.lit("CK:i:"), F.col("canonical_kmers").cast("string")), F.concat(F.lit("SH:H:"), "sequence_sha256"))
    link = F.concat_ws("\t", F.lit("L"), "from_segment", "from_orientation", "to_segment", "to_orientation", F.lit(f"{k - 1}M"))
    rows = head.unionByName(units.select(F.lit(1).alias("section"), F.col("unitig_id").alias("ord"), segment.alias("value"))).unionByName(linked.select(F.lit(2).alias("section"), link.alias("ord"), link.alias("value")))
    return rows.orderBy("section", "ord").select("value")


def tsv_lines(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """value: a header row first, NA for null, in the given order."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns]
    body = df.orderBy(*order).select(F.concat_ws("\t", *values).alias("value"))
    return df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").unionByName(body)


def report_html(units: DataFrame, title: str, rows: int = 100) -> str:
    """An offline page of the first `rows` unitigs (the report's length is a parameter, its totals are of all)."""
    total = units.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")).first()
    shown = units.select("unitig_id", F.length("seq").alias("length"), "topology", "lower_median_support").orderBy(F.col("length").desc(), "unitig_id").limit(rows).collect()
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in shown)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{total['n']} unitigs, {total['bases']} bases; {len(shown)} shown</p><table><tr><th>unitig</th><th>length</th><th>topology</th><th>support</th></tr>{cells}</table>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), sha256, bytes of every file under a folder, computed where the files are read."""
    fs, where, _ = _fs(spark, root)
    top = fs.resolvePath(where).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring_index("path", top, -1)
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter("path NOT LIKE '\\\\_SUCCESS' AND path NOT LIKE '%/\\\\_SUCCESS'")


def scientific_digest(listed: list[tuple[str, str]]) -> str:
    """SHA-256 over path, NUL, digest and a line feed of each artifact, in order of paths."""
    return hashlib.sha256("".join(f"{p}\x00{d}\n" for p, d in sorted(listed)).encode()).hexdigest()


def write_bundle(spark: SparkSession, root: str, tables: dict[str, DataFrame], run: dict, report: str | None = None) -> str:
    """Write text tables, report.html, run.json and manifest.sha256 under `root`; the scientific digest is returned.

    An existing `root` is an error, and stays as it is.
    """
    fs, where, jvm = _fs(spark, root)
    if fs.exists(where):
        raise FileExistsError(root)
    staging = f"{root.rstrip('/')}._staging"
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    for name, df in tables.items():
        df.write.text(f"{staging}/{name}")

    def put(name: str, text: str) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staging}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    listed = [(r["path"], r["sha256"]) for r in digests(spark, staging).collect()]
    science = scientific_digest(listed)
    put("run.json", json.dumps(run | {"scientific_digest": science}, sort_keys=True, indent=1))
    if report is not None:
        put("report.html", report)
    every = sorted((r["path"], r["sha256"]) for r in digests(spark, staging).collect())
    put("manifest.sha256", "".join(f"{d}  {p}\n" for p, d in every))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), where):
        raise OSError(f"{staging} could not be renamed")
    return science


def verify_bundle(spark: SparkSession, root: str) -> DataFrame:
    """path, problem: files that are missing, unlisted, listed twice or changed. Empty if the bundle is whole."""
    lines = spark.read.text(f"{root}/manifest.sha256").select(F.substring("value", 1, 64).alias("listed"), F.substr("value", F.lit(67)).alias("path"))
    listed = lines.groupBy("path").agg(F.min("listed").alias("listed"), F.count("*").alias("n"))
    found = digests(spark, root).filter("path <> 'manifest.sha256'")
    both = listed.join(found, "path", "full")
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")
