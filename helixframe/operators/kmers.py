"""Windows of reads, their classes, canonical k-mer support, retention and digests.

A fragment is one row: fragment_id, lane, and reads, an array of (role, seq, qual) with one or two mates.
So counting each k-mer once per fragment needs no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna, packed
from helixframe.operators import limits

#: Bases that a task turns into windows at once.
SLICE = 1 << 19


def fragments(reads: DataFrame) -> DataFrame:
    """Fragments of single reads (fragment_id, lane, role, seq, qual)."""
    return reads.groupBy("fragment_id", "lane").agg(F.array_sort(F.collect_list(F.struct("role", "seq", "qual"))).alias("reads"))


def reads_of(frags: DataFrame) -> DataFrame:
    return frags.select("fragment_id", "lane", F.inline("reads"))


def ambiguity_mask(seq) -> Column:
    """A '1' for every ambiguous base, '0' for an exact one."""
    return F.translate(F.upper(seq), dna.EXACT + dna.AMBIGUOUS, "0" * 4 + "1" * len(dna.AMBIGUOUS))


def quality_mask(seq, qual, minimum: int) -> Column:
    """A '1' for every base of a quality below `minimum` (Phred+33); none without qualities."""
    every = "".join(map(chr, range(33, 127)))
    return F.coalesce(F.translate(qual, every, "1" * minimum + "0" * (len(every) - minimum)), F.repeat(F.lit("0"), F.length(seq)))


def windows(reads: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """One row per window: fragment_id, lane, role, pos (from 0), window, kmer (canonical; null unless accepted), class.

    Reads shorter than k have none. A window with both faults is a class of its own.
    """
    seq = F.upper("seq")
    # Once per read, below the generator: masks, whether they mark anything, and the reverse complement.
    masked = reads.filter(F.length("seq") >= k).select("fragment_id", "lane", "role", seq.alias("seq"), dna.revcomp(seq).alias("back"), ambiguity_mask(seq).alias("n"), quality_mask(seq, F.col("qual"), minimum_quality).alias("q"))
    known = masked.withColumn("any_n", F.instr("n", "1") > 0).withColumn("any_q", F.instr("q", "1") > 0)
    placed = known.select("*", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    part = lambda c: F.substr(F.col(c), F.col("pos") + 1, F.lit(k))
    n, q = F.col("any_n") & (F.instr(part("n"), "1") > 0), F.col("any_q") & (F.instr(part("q"), "1") > 0)
    kind = F.when(n & q, "ambiguity_and_quality").when(n, "ambiguity_only").when(q, "quality_only").otherwise("accepted")
    back = F.substr("back", F.length("seq") - F.col("pos") - k + 1, F.lit(k))
    return placed.select("fragment_id", "lane", "role", "pos", part("seq").alias("window"), F.when(~n & ~q, F.least(part("seq"), back)).alias("kmer"), kind.alias("class"))


def window_stats(reads: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """possible, accepted, ambiguity_only, quality_only, ambiguity_and_quality."""
    of = lambda c: F.count_if(F.col("class") == c).alias(c)
    return windows(reads, k, minimum_quality).agg(F.count("*").alias("possible"), *map(of, ("accepted", "ambiguity_only", "quality_only", "ambiguity_and_quality")))


def _accepted(read: Column, k: int) -> Column:
    """The canonical accepted k-mers of a struct of upper-case bases s, their reverse complement r and masks n and q, as an array."""
    at = F.when(F.length(read["s"]) >= k, F.sequence(F.lit(1), F.length(read["s"]) - k + 1)).otherwise(F.array().cast("array<int>"))
    sound = lambda c, i: F.instr(F.substr(read[c], i, F.lit(k)), "1") == 0
    faulty = (F.instr(read["n"], "1") > 0) | (F.instr(read["q"], "1") > 0)
    clean = F.when(faulty, F.filter(at, lambda i: sound("n", i) & sound("q", i))).otherwise(at)
    return F.transform(clean, lambda i: F.least(F.substr(read["s"], i, F.lit(k)), F.substr(read["r"], F.length(read["s"]) - i - k + 2, F.lit(k))))


def row_slices(batches: Iterator[pa.RecordBatch], lengths) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about SLICE bases, one row at least. `lengths`: the bases of each row of a batch."""
    for batch in batches:
        ends, first = np.cumsum(lengths(batch)), 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            after = min(len(ends), int(np.searchsorted(ends, before + SLICE)) + 1)
            yield batch.slice(first, after - first)
            first = after


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows, so that what is dealt out by buckets has more than a few of each."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bases(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def fragment_bases(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("reads")
    sums = np.concatenate([[0], np.cumsum(bases(lists.flatten().field("seq")))])
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])


def _slice_counts(counts: np.ndarray, codes: np.ndarray, bad: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical codes of a slice's accepted windows, rising, with windows and fragments of each. `counts`: the reads of each fragment."""
    sound = np.flatnonzero(packed.clean(bad, k))
    forward, backward = packed.windows(codes, k) if len(sound) else (np.zeros(0, np.uint64),) * 2
    fragment = np.repeat(np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.diff(firsts))[sound]
    return _tally(np.minimum(forward[sound], backward[sound]), fragment)


def _tally(canonical: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, rising, with windows and fragments of each; windows come fragment by fragment."""
    bits = int(fragment.max(initial=0)).bit_length()
    if int(canonical.max(initial=0)).bit_length() + bits <= 64:  # both fit in one number, which sorts faster
        both = np.sort((canonical << np.uint64(bits)) | fragment.astype(np.uint64))
        canonical, fragment = both >> np.uint64(bits), both & np.uint64((1 << bits) - 1)
    else:
        order = np.argsort(canonical, kind="stable")  # fragments stay in order within a code
        canonical, fragment = canonical[order], fragment[order]
    new = np.ones(len(canonical), bool)
    new[1:] = canonical[1:] != canonical[:-1]
    pair = new.copy()
    pair[1:] |= fragment[1:] != fragment[:-1]
    at = np.flatnonzero(new)
    held = np.add.reduceat(pair.astype(np.int64), at) if len(at) else at
    return canonical[at].astype(np.int64), np.diff(np.append(at, len(canonical))), held


#: A run of windows of a read: the first window's code, the bases behind it, its fragment in its slice, and its windows.
_RUN = np.dtype([("first", "<u8"), ("rest", "<u4"), ("fragment", "<u4"), ("windows", "u1")])
#: Bases of a minimizer, buckets of minimizers, windows of a run at most (16 bases are behind the first), windows that are counted at a time.
MINIMIZER, BUCKETS, RUN, COUNTED = 11, 4096, 17, 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(minimizers: np.ndarray) -> np.ndarray:
    """Canonical codes of m bases in an order of their own."""
    mixed = minimizers * _ODD
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _bucket(least: np.ndarray) -> np.ndarray:
    return ((least * _ODD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def code_buckets(code: np.ndarray, k: int) -> np.ndarray:
    """The buckets of the minimizers of coded spellings of k bases."""
    m = min(MINIMIZER, k)
    least = np.full(len(code), np.iinfo(np.uint64).max, np.uint64)
    for behind in range(k - m + 1):
        part = (code >> np.uint64(2 * behind)) & np.uint64(4**m - 1)
        least = np.minimum(least, _mixed(np.minimum(part, packed.revcomp_codes(part, m))))
    return _bucket(least)


def cut_runs(at: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows at the places `at` (rising, each exact) as runs with one minimizer: place, windows, first code, bases behind it, bucket."""
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(np.uint32), at.astype(np.int32)
    m = min(MINIMIZER, k)
    least = packed.sliding_minimum(_mixed(np.minimum(*packed.windows(codes, m))), k - m + 1)[at]
    start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(at) != 1)]))
    size = np.diff(np.append(start, len(at)))
    parts = -(-size // RUN)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    size, start = np.minimum(np.repeat(size, parts) - RUN * number, RUN), np.repeat(start, parts) + RUN * number
    place = at[start]
    rest = packed.windows(np.concatenate([codes, np.zeros(RUN - 1, np.uint8)]), RUN - 1)[0][place + k]
    return place, size, packed.windows(codes, k)[0][place], rest, _bucket(least[start])


def _runs(counts: np.ndarray, codes: np.ndarray, bad: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of accepted windows with one minimizer, by bucket, and their buckets. A k-mer and its reverse complement have one bucket."""
    place, size, first, rest, bucket = cut_runs(np.flatnonzero(packed.clean(bad, k)), codes, k)
    runs = np.zeros(len(place), _RUN)
    runs["first"], runs["rest"], runs["windows"] = first, rest, size
    runs["fragment"] = np.repeat(np.arange(len(counts)), counts)[np.searchsorted(firsts, place, "right") - 1]
    order = np.argsort(bucket, kind="stable")
    return runs[order], bucket[order]


def run_codes(runs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical codes of all windows of runs, and where those of each begin."""
    many = runs["windows"].astype(np.int64)
    begin = np.cumsum(many) - many
    forward, code = np.empty(many.sum(), np.uint64), runs["first"].copy()
    mask = np.uint64((1 << 2 * k) - 1)
    for j in range(int(many.max(initial=0))):
        left = many > j
        if j:
            base = (runs["rest"] >> np.uint32(2 * (RUN - 1 - j))) & np.uint32(3)
            code = ((code << np.uint64(2)) | base.astype(np.uint64)) & mask
        forward[begin[left] + j] = code[left]
    return np.minimum(forward, packed.revcomp_codes(forward, k)), begin


def _packed_runs(runs: np.ndarray, bucket: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs as they are shipped: a byte each (its windows, and in the top bit whether a fragment begins in its bucket), their bases, four in a byte, and the bytes of each."""
    new = np.ones(len(runs), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (runs["fragment"][1:] != runs["fragment"][:-1])
    rest = runs["rest"].astype(np.uint64) << np.uint64(32)
    halves = np.empty((len(runs), 2), ">u8")
    halves[:, 0] = (runs["first"] << np.uint64(64 - 2 * k)) | (rest >> np.uint64(2 * k))
    halves[:, 1] = rest << np.uint64(64 - 2 * k)
    size = (k + runs["windows"].astype(np.int64) + 2) // 4
    return runs["windows"] | (new.astype(np.uint8) << np.uint8(7)), halves.view(np.uint8).reshape(-1, 16)[np.arange(16) < size[:, None]], size


def _unpacked_runs(heads: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Runs from their bytes; fragments are numbered from 1 over all of them."""
    runs = np.zeros(len(heads), _RUN)
    runs["windows"], runs["fragment"] = heads & 127, np.cumsum(heads >> 7)
    whole = np.zeros((len(heads), 16), np.uint8)
    whole[np.arange(16) < (k + runs["windows"].astype(np.int64)[:, None] + 2) // 4] = data
    halves = whole.view(">u8").astype(np.uint64)
    runs["first"] = halves[:, 0] >> np.uint64(64 - 2 * k)
    runs["rest"] = ((halves[:, 0] << np.uint64(2 * k)) | (halves[:, 1] >> np.uint64(64 - 2 * k))) >> np.uint64(32)
    return runs


def _run_counts(runs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, windows and fragments of runs."""
    return _tally(run_codes(runs, k)[0], np.repeat(runs["fragment"], runs["windows"]))


def _merged(one: tuple, other: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of two sets of runs without a common fragment as one."""
    if other is None or not len(other[0]):
        return one
    code, many, held = (np.concatenate(x) for x in zip(one, other, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[at], np.add.reduceat(many[order], at), np.add.reduceat(held[order], at)


def _bucketed_spectra(frags: DataFrame, ks: list[int], minimum_quality: int) -> DataFrame:
    """k, code, occurrences, fragments: windows go to the bucket of their minimizer as runs, several in one row, and are counted there.

    A run has one code and the bases behind it for all its windows, so that less is shuffled than one row per k-mer of a slice. A
    bucket of many windows is counted in parts, and what is held is the counts of its distinct k-mers.
    """

    limit = COUNTED

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, fragment_bases):
            lists = batch.column("reads")
            reads = lists.flatten()
            given = packed.reads_of(reads.field("seq"), reads.field("qual"), minimum_quality)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for k in ks:
                runs, bucket = _runs(counts, *given, k)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                heads, data, size = _packed_runs(runs, bucket, k)
                ends = np.append(first, len(runs)).astype(np.int32)
                behind = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)[ends]
                blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(x), pa.py_buffer(y.tobytes())]) for x, y in ((ends, heads), (behind, data))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(bucket[first]), *blobs], names=["k", "bucket", "heads", "runs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "code", "occurrences", "fragments"]
        held, size, kept = [], 0, None  # runs that wait (k, bucket, bytes of a row), their windows, and the counts of the last bucket (its k, itself, they)

        def row(k: int, found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), k, np.int32)), *map(pa.array, found)], names=names)

        def counted(rows: list, k: int) -> tuple:
            heads, data = (np.frombuffer(b"".join(x[i] for x in rows), np.uint8) for i in (2, 3))
            return _run_counts(_unpacked_runs(heads, data, k), k)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, kept
            while held:
                k = held[0][0]
                same = [x for x in held if x[0] == k]
                held = held[len(same) :]
                if kept and kept[0] != k:
                    yield row(kept[0], kept[2])
                    kept = None
                last = same[-1][1]
                before, tail = [x for x in same if x[1] != last], [x for x in same if x[1] == last]
                if kept and kept[1] != last:
                    yield row(k, _merged(kept[2], counted(before, k) if before else None))
                    kept = None
                elif before:
                    yield row(k, counted(before, k))
                kept = (k, last, _merged(counted(tail, k), kept[2] if kept else None))
            size = 0

        for batch in batches:
            for row_of in zip(*[batch.column(c).to_pylist() for c in ("k", "bucket", "heads", "runs")], strict=True):
                held.append(row_of)
                size += int((np.frombuffer(row_of[2], np.uint8) & 127).sum(dtype=np.int64))
                if size >= limit:
                    yield from flush()
        yield from flush()
        if kept:
            yield row(kept[0], kept[2])

    shipped = frags.select("reads").mapInArrow(ship, "k int, bucket int, heads binary, runs binary").repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    return shipped.mapInArrow(count, "k int, code long, occurrences long, fragments long")


def _partial_spectra(frags: DataFrame, ks: list[int], minimum_quality: int) -> DataFrame:
    """k, code, occurrences, fragments: the counts of every slice on its own, for all k from one reading of its bases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, fragment_bases):
            lists = batch.column("reads")
            reads = lists.flatten()
            codes, bad, firsts = packed.reads_of(reads.field("seq"), reads.field("qual"), minimum_quality)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for k in ks:
                code, many, held = _slice_counts(counts, codes, bad, firsts, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(many), pa.array(held)], names=["k", "code", "occurrences", "fragments"])

    return frags.select("reads").mapInArrow(count, "k int, code long, occurrences long, fragments long")


def spectrum(frags: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """code, occurrences, fragments of the canonical accepted k-mers, k at most 31: all windows and all fragments with one.

    A task takes all windows of some fragments at once; they are shuffled as runs with one minimizer. Null reads and
    sequences have no windows.
    """
    return spectra(frags, [k], minimum_quality).drop("k")


def spectra(frags: DataFrame, ks: list[int], minimum_quality: int = 20) -> DataFrame:
    """k, code, occurrences, fragments of several k, each at most 31: one scan of the fragments and one exchange for all.

    The counts of a stream have to be sums that Spark keeps, so there partial counts of slices are shuffled.
    """
    ks = sorted(set(ks))
    if not ks or not all(1 <= k <= packed.LONGEST for k in ks):
        raise ValueError("k must be 1 to 31")
    if not frags.isStreaming:
        return _bucketed_spectra(frags, ks, minimum_quality)
    return _partial_spectra(frags, ks, minimum_quality).groupBy("k", "code").agg(F.sum("occurrences").alias("occurrences"), F.sum("fragments").alias("fragments"))


def count_kmers(frags: DataFrame, k: int, minimum_quality: int = 20, unit: str = "fragment", with_code: bool = False) -> DataFrame:
    """kmer, support: the number of fragments that hold a canonical k-mer, or (unit 'occurrence') of accepted windows.

    With `with_code` and k up to 31 also `code`, by which graph.unitigs goes on without reading spellings again. Parameters
    outside the limits raise.
    """
    limits.Parameters(k=k, minimum_quality=minimum_quality, unit=unit)
    if k <= packed.LONGEST:
        support = "fragments" if unit == "fragment" else "occurrences"
        return spectrum(frags, k, minimum_quality).select(dna.decode("code", k).alias("kmer"), F.col(support).alias("support"), *["code"] * with_code)
    if unit == "occurrence":
        return windows(reads_of(frags), k, minimum_quality).filter("kmer IS NOT NULL").groupBy("kmer").agg(F.count("*").alias("support"))
    masked = lambda r: F.struct(F.upper(r["seq"]).alias("s"), dna.revcomp(F.upper(r["seq"])).alias("r"), ambiguity_mask(F.upper(r["seq"])).alias("n"), quality_mask(r["seq"], r["qual"], minimum_quality).alias("q"))
    found = F.array_distinct(F.flatten(F.transform(F.transform("reads", masked), lambda r: _accepted(r, k))))
    return frags.select(F.explode(found).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("support"))


def retain(counts: DataFrame, minimum_support: int = 2) -> DataFrame:
    return counts.filter(F.col("support") >= minimum_support)


def retention_decisions(counts: DataFrame, minimum_support: int | None) -> DataFrame:
    """Every key with `decision`: retained or discarded; without a minimum all are retained."""
    keeps = F.lit(True) if minimum_support is None else F.col("support") >= minimum_support
    return counts.withColumn("decision", F.when(keeps, "retained").otherwise("discarded"))


def support_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("support").agg(F.count("*").alias("distinct_canonical_keys"))


def count_summary(counts: DataFrame, minimum_support: int = 2) -> DataFrame:
    """Distinct keys and support mass, observed, retained and removed."""
    kept, mass = F.col("support") >= minimum_support, F.col("support")
    return counts.agg(
        F.count("*").alias("observed_keys"),
        F.coalesce(F.sum(mass), F.lit(0)).alias("observed_mass"),
        F.count_if(kept).alias("retained_keys"),
        F.coalesce(F.sum(F.when(kept, mass)), F.lit(0)).alias("retained_mass"),
        F.count_if(~kept).alias("removed_keys"),
        F.coalesce(F.sum(F.when(~kept, mass)), F.lit(0)).alias("removed_mass"),
    )


def state_digest(counts: DataFrame, label: str) -> DataFrame:
    """label, keys, mass, digest of a set of (kmer, support), the same in any order and partitioning.

    Each row's SHA-256 is cut into four 60-bit numbers, and the numbers are summed: a digest that partial
    aggregates combine, where hashing the rows in key order would pass them all through one task.
    """
    row = F.sha2(F.concat_ws("\t", "kmer", F.col("support").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = [F.coalesce(part(i).cast("decimal(38,0)"), F.lit(0)).cast("string") for i in range(4)]
    return counts.agg(F.lit(label).alias("label"), F.count("*").alias("keys"), F.coalesce(F.sum("support"), F.lit(0)).alias("mass"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest"))


def transform_summary(counts: DataFrame, minimum_support: int = 2) -> DataFrame:
    """Two stages, exact counting and the support filter, with their digests before and after."""
    before, after = state_digest(counts, "observed"), state_digest(retain(counts, minimum_support), "retained")
    return before.unionByName(after)


def two_hit_keys(frags: DataFrame, k: int, minimum_quality: int = 20) -> DataFrame:
    """The k-mers of two fragments or more: exact, so no sieve needs a recount."""
    return count_kmers(frags, k, minimum_quality).filter("support >= 2").select("kmer")


def _minimizers_of(code: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest canonical code of m bases in each coded spelling of k bases, and its place, the leftmost on a tie."""
    least, pos = np.full(len(code), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(code), np.int32)
    for at in range(k - m + 1):
        part = (code >> np.uint64(2 * (k - m - at))) & np.uint64(4**m - 1)
        part = np.minimum(part, packed.revcomp_codes(part, m))
        pos[part < least] = at
        least = np.minimum(least, part)
    return least, pos


def minimizers(counts: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """kmer, support, minimizer, minimizer_pos, bucket_id. k-mers of up to 31 bases go by their codes, from a column `code` if there is one."""
    kind = dict(counts.dtypes)["support"]

    def find_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, pos = _minimizers_of(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), k, m)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("support"), pa.array(least.astype(np.int64)), pa.array(pos)], names=["key", "support", "code", "minimizer_pos"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, lambda b: bases(b.column("key"))):
            codes, _, firsts = packed.reads_of(batch.column("key"), pa.nulls(batch.num_rows, pa.string()), 0)
            forward, backward = packed.windows(codes, m)
            every = np.minimum(forward, backward)[firsts[:-1, None] + np.arange(k - m + 1)]
            pos = every.argmin(axis=1)  # the leftmost on a tie
            code = every[np.arange(len(pos)), pos].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("support"), pa.array(code), pa.array(pos.astype(np.int32))], names=["key", "support", "code", "minimizer_pos"])

    if k <= packed.LONGEST:
        coded = counts.select((F.col("code") if "code" in counts.columns else dna.encode("kmer")).alias("key"), "support")
        found = coded.mapInArrow(find_codes, f"key long, support {kind}, code long, minimizer_pos int").withColumn("kmer", dna.decode("key", k))
    else:
        found = counts.select(F.col("kmer").alias("key"), "support").mapInArrow(find, f"key string, support {kind}, code long, minimizer_pos int").withColumnRenamed("key", "kmer")
    return found.select("kmer", "support", dna.decode("code", m).alias("minimizer"), "minimizer_pos", (F.col("code") % buckets).alias("bucket_id"))


def bucket_counts(counts: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """bucket_id, distinct_keys, occurrences."""
    return minimizers(counts, k, m, buckets).groupBy("bucket_id").agg(F.count("*").alias("distinct_keys"), F.sum("support").alias("occurrences"))


def super_kmers(reads: DataFrame, k: int, m: int, buckets: int, minimum_quality: int = 20) -> DataFrame:
    """Maximal runs of accepted windows of a read with one minimizer: fragment_id, role, first_window, window_count, minimizer, bucket_id.

    A read is one row, so its runs are found inside its task, and nothing is shuffled.
    """
    given = reads.select("fragment_id", "role", "seq", "qual")
    kinds = dict(given.dtypes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, lambda b: bases(b.column("seq"))):
            codes, bad, firsts = packed.reads_of(batch.column("seq"), batch.column("qual"), minimum_quality)
            sound = np.flatnonzero(packed.clean(bad, k))
            if not len(sound):
                continue
            least = packed.sliding_minimum(np.minimum(*packed.windows(codes, m)), k - m + 1)[sound]
            at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(sound) != 1)]))
            row = np.searchsorted(firsts, sound[at], "right") - 1
            of = lambda name: batch.column(name).take(pa.array(row))
            columns = [of("fragment_id"), of("role"), pa.array((sound[at] - firsts[row]).astype(np.int32)), pa.array(np.diff(np.append(at, len(sound)))), pa.array(least[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["fragment_id", "role", "first_window", "window_count", "code"])

    found = given.mapInArrow(find, f"fragment_id {kinds['fragment_id']}, role {kinds['role']}, first_window int, window_count long, code long")
    return found.select("fragment_id", "role", "first_window", "window_count", dna.decode("code", m).alias("minimizer"), (F.col("code") % buckets).alias("bucket_id"))
