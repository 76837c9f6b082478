"""FASTA and FASTQ, plain or gzip by content, single or paired, into the reads table.

Files are read by Spark (any file system it knows); a parser turns each file into record rows inside a
task, and everything after that, headers, roles, pairing and validation, is DataFrame operations.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.durable import cut_lineage
from helixframe.functions import dna

_RECORD = "path string, raw_sha256 string, decoded_sha256 string, format string, idx long, header string, seq string, qual string, error string"


class InputError(ValueError):
    """A source that cannot be read as supplied."""


def decode(raw: bytes) -> bytes:
    """The decoded bytes: gzip is told by its first two bytes; all members are decoded, and rubbish after them is an error."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(raw))
        except zlib.error as e:
            raise InputError("corrupt gzip") from e
        if not member.eof:
            raise InputError("truncated gzip")
        raw = member.unused_data
    return b"".join(out)


def _lines(data: bytes) -> list[bytes]:
    return [x.rstrip(b"\r") for x in data.split(b"\n")]


def fasta_records(data: bytes) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    header, parts = None, []
    for line in _lines(data):
        if line.startswith(b">"):
            if header is not None:
                yield header, b"".join(parts), None
            header, parts = line[1:], []
        elif line.strip():
            if header is None:
                raise InputError("sequence before the first header")
            parts.append(line.strip())
    if header is not None:
        yield header, b"".join(parts), None


def fastq_records(data: bytes) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    """Sequence and quality may be wrapped; quality lines are read until they are as long as the sequence."""
    lines, k = _lines(data), 0
    while k < len(lines):
        if not lines[k].strip():
            k += 1
            continue
        if not lines[k].startswith(b"@"):
            raise InputError("record does not start with @")
        header, seq, k = lines[k][1:], [], k + 1
        while k < len(lines) and not lines[k].startswith(b"+"):
            if not lines[k]:
                raise InputError("blank sequence line")
            seq.append(lines[k])
            k += 1
        if k == len(lines) or not seq:
            raise InputError("record without sequence or + line")
        if len(lines[k]) > 1 and lines[k][1:].split()[:1] != header.split()[:1]:
            raise InputError("+ line names another record")
        whole, k = b"".join(seq), k + 1
        qual, held = [], 0
        while held < len(whole):
            if k == len(lines) or not lines[k]:
                raise InputError("quality is shorter than sequence")
            qual.append(lines[k])
            held += len(lines[k])
            k += 1
        if held > len(whole):
            raise InputError("quality is longer than sequence")
        yield header, whole, b"".join(qual)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.int64() if n == "idx" else pa.string() for n in names]
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows, head = [], [path, hashlib.sha256(raw).hexdigest()]
            try:
                data = decode(raw)
                head.append(hashlib.sha256(data).hexdigest())
                first = data.lstrip()[:1]
                kind = {b">": "fasta", b"@": "fastq"}.get(first)
                if kind is None:
                    raise InputError("no records" if not first else "neither FASTA nor FASTQ")
                for k, (header, seq, qual) in enumerate((fasta_records if kind == "fasta" else fastq_records)(data)):
                    rows.append((*head, kind, k, header.decode("latin-1"), seq.decode("latin-1"), None if qual is None else qual.decode("latin-1"), None))
                    if len(rows) == 20_000:
                        yield _rows(rows, names, kinds)
                        rows = []
            except InputError as e:
                rows.append((*head, *[None] * (3 - len(head)), None, None, None, None, None, str(e)))
            yield _rows(rows, names, kinds)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _place(spark: SparkSession, path: str) -> str:
    """A file's full name, links and dots resolved, so that two spellings of one file are told."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(where).toUri()
    return os.path.realpath(full.getPath()) if full.getScheme() == "file" else full.toString()


def sources(spark: SparkSession, single: list[str] = (), r1: list[str] = (), r2: list[str] = ()) -> DataFrame:
    """lane, role, path of the declared files, in order. Lists of mates must be as long; no file may occur twice."""
    if bool(single) == bool(r1 or r2):
        raise InputError("give single files, or both lists of mates")
    if len(r1) != len(r2):
        raise InputError("as many first as second mate files are needed")
    rows = [(k, "S", p) for k, p in enumerate(single)] or [x for k, (a, b) in enumerate(zip(r1, r2, strict=True)) for x in ((k, "R1", a), (k, "R2", b))]
    if len({_place(spark, p) for *_, p in rows}) < len(rows):
        raise InputError("a source occurs twice")
    return spark.createDataFrame(rows, "lane int, role string, path string")


def header_identity(header) -> Column:
    """The first token of a header, without a final /1 or /2."""
    return F.regexp_replace(F.regexp_extract(header, r"^(\S+)", 1), "/[12]$", "")


def header_role(header) -> Column:
    """The mate that a header names by /1, /2 or a second token 1: or 2:; null without one, 'conflict' if both differ."""
    slash = F.regexp_extract(header, r"^\S+/([12])(\s|$)", 1)
    token = F.regexp_extract(header, r"^\S+\s+([12]):", 1)
    named = F.when(slash != "", slash).when(token != "", token)
    return F.when((slash != "") & (token != "") & (slash != token), "conflict").when(named.isNotNull(), F.concat(F.lit("R"), named))


def records(spark: SparkSession, declared: DataFrame) -> DataFrame:
    """One row per record of the declared files, with lane and role; `error` tells what is wrong, or is null."""
    paths = [r["path"] for r in declared.select("path").collect()]
    read = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_parse, _RECORD)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+(?=[^/])", "/")
    named = declared.select("lane", F.col("role").alias("role"), F.regexp_replace("path", "^[a-z0-9]+:/+(?=[^/])", "/").alias("plain"))
    rows = named.join(read.withColumn("plain", plain), "plain", "left")  # a file without bytes has no row of its own
    seq = F.upper("seq")
    stated = header_role(F.col("header"))
    wrong = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("idx").isNull(), "no records")
        .when(F.length("seq") == 0, "empty sequence")
        .when(~seq.rlike(f"^[{dna.IUPAC}]+$"), "invalid nucleotide")
        .when(F.col("qual").isNotNull() & ~F.col("qual").rlike("^[!-~]+$"), "invalid quality")
        .when(header_identity(F.col("header")) == "", "empty identity")
        .when(stated.isNotNull() & (F.col("role") != "S") & (stated != F.col("role")), "pair role")
    )
    return rows.select("lane", "role", "path", "raw_sha256", "decoded_sha256", "format", "idx", header_identity(F.col("header")).alias("read_id"), stated.alias("stated_role"), seq.alias("seq"), "qual", wrong.alias("error"))


def pair_errors(rows: DataFrame) -> DataFrame:
    """lane, idx, error: records without a mate, of another identity, or of another format."""
    a = rows.filter("role = 'R1'").select("lane", "idx", F.col("read_id").alias("x"), F.col("format").alias("xf"))
    b = rows.filter("role = 'R2'").select("lane", "idx", F.col("read_id").alias("y"), F.col("format").alias("yf"))
    error = F.when(F.col("x").isNull() | F.col("y").isNull(), "pair order or cardinality").when(F.col("x") != F.col("y"), "pair identity").when(F.col("xf") != F.col("yf"), "pair format")
    return a.join(b, ["lane", "idx"], "full").select("lane", "idx", error.alias("error")).filter("error IS NOT NULL")


def read_fastx(spark: SparkSession, single: list[str] = (), r1: list[str] = (), r2: list[str] = ()) -> DataFrame:
    """fragment_id, lane, role, read_id, seq, qual. The first error found raises InputError.

    fragment_id counts records within lanes, in lane order: a lane's offset is the number of fragments of
    the lanes before it.
    """
    rows = cut_lineage(records(spark, sources(spark, single, r1, r2)))  # so that no file is parsed more than once
    bad = rows.filter("error IS NOT NULL").select("path", "idx", "error").orderBy("path", "idx").first()
    if bad is None and not single:
        bad = pair_errors(rows).orderBy("lane", "idx").first()
    if bad is not None:
        raise InputError(", ".join(f"{k} {v}" for k, v in bad.asDict().items() if v is not None))
    sizes = rows.filter("role <> 'R2'").groupBy("lane").agg(F.count("*").alias("n"))
    before = sizes.alias("s").join(sizes.alias("t"), F.col("t.lane") < F.col("s.lane"), "left").groupBy("s.lane").agg(F.coalesce(F.sum("t.n"), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "lane").select((F.col("before") + F.col("idx")).alias("fragment_id"), "lane", "role", "read_id", "seq", "qual")


def source_digests(rows: DataFrame) -> DataFrame:
    """lane, role, format, raw_sha256, decoded_sha256, records, bases, roles_inferred."""
    inferred = F.count_if((F.col("role") != "S") & F.col("stated_role").isNull())
    return rows.groupBy("lane", "role", "format", "raw_sha256", "decoded_sha256").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"), inferred.alias("roles_inferred"))


