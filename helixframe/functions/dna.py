"""Column functions over DNA spellings. k-mers are strings: A < C < G < T is the order of the letters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EXACT = "ACGT"
AMBIGUOUS = "RYSWKMBDHVN"
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(c) -> Column:
    """Reverse complement of an A, C, G, T spelling."""
    return F.reverse(F.translate(_col(c), "ACGT", "TGCA"))


def revcomp_iupac(c) -> Column:
    """Reverse complement over the whole IUPAC alphabet, in upper case."""
    return F.reverse(F.translate(F.upper(_col(c)), IUPAC, IUPAC_COMPLEMENT))


def canonical(c) -> Column:
    return F.least(_col(c), revcomp(c))


def is_palindrome(c) -> Column:
    return _col(c) == revcomp(c)


def base_class(c) -> Column:
    """exact, ambiguous or invalid, of one base."""
    return F.when(F.instr(F.lit(EXACT), _col(c)) > 0, "exact").when(F.instr(F.lit(AMBIGUOUS), _col(c)) > 0, "ambiguous").otherwise("invalid")


def encode(c) -> Column:
    """The 2-bit code of a spelling of up to 31 bases, as a long."""
    return F.conv(F.translate(_col(c), "ACGT", "0123"), 4, 10).cast("long")


#: All spellings of so many bases, one behind the other: where a piece of a code is looked up.
_PIECE = 6
_SPELLINGS = {n: "".join(map("".join, product(EXACT, repeat=n))).encode() for n in range(1, _PIECE + 1)}


def decode(code, k: int) -> Column:
    """The spelling of a code of k bases, put together from pieces that are looked up."""
    def piece(n: int, behind: int) -> Column:
        number = F.shiftrightunsigned(_col(code), 2 * behind).bitwiseAND(F.lit(4**n - 1)).cast("int")
        return F.substr(F.lit(_SPELLINGS[n]), number * n + 1, F.lit(n))

    sizes = [k % _PIECE] * (k % _PIECE > 0) + [_PIECE] * (k // _PIECE)
    return F.concat(*[piece(n, k - sum(sizes[: i + 1])) for i, n in enumerate(sizes)]).cast("string")


def prefix(c, k: int) -> Column:
    return F.substring(_col(c), 1, k - 1)


def suffix(c, k: int) -> Column:
    return F.substring(_col(c), 2, k - 1)


def last_base(c) -> Column:
    return F.right(_col(c), F.lit(1))


def partition_prefix(c, bits: int) -> Column:
    """The first `bits` (even) bits of the code, as its leading bases."""
    return F.left(_col(c), F.lit(bits // 2))


def minimizer(c, k: int, m: int) -> Column:
    """struct(key, pos): the smallest canonical m-mer of a k-mer, the leftmost on a tie."""
    s = _col(c)
    return F.array_min(F.array(*[F.struct(canonical(F.substring(s, i + 1, m)).alias("key"), F.lit(i).alias("pos")) for i in range(k - m + 1)]))


def route(key, m: int, buckets: int) -> Column:
    """The exact 2-bit value of a minimizer of any length, modulo `buckets`."""
    digits = F.translate(_col(key), "ACGT", "0123")
    out = F.lit(0).cast("long")
    for i in range(m):
        out = (out * 4 + F.substring(digits, i + 1, 1).cast("long")) % F.lit(buckets)
    return out


def _framed(c: Column) -> Column:
    """An eight-byte little-endian length, and the bytes."""
    hexed = F.lpad(F.hex(F.octet_length(c)), 16, "0")
    little = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.concat(F.unhex(little), c.cast("binary"))


def identity_digest(c, domain: str = "helixframe/read/1") -> Column:
    """SHA-256 of a domain and a framed identity."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), _framed(_col(c))), 256)


def unitig_id(sequence, topology, k: int, domain: str = "helixframe/unitig/1") -> Column:
    """utg- and the SHA-256 of a domain, k, the topology's tag and the framed sequence."""
    tag = F.when(_col(topology) == "linear", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    return F.concat(F.lit("utg-"), F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.lit(f"{k:02x}")), tag, _framed(_col(sequence))), 256))


def minimum_rotation(c) -> Column:
    """The smallest rotation of a cyclic spelling: only those that start with its smallest 32 letters are compared whole.

    A ring of distinct k-mers has few such places, so memory grows with its length; a ring that repeats itself has more.
    """
    s = _col(c)
    twice, places = F.concat(s, s), F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s)))
    width = F.least(F.length(s), F.lit(32))
    least = F.array_min(F.transform(places, lambda i: F.substr(twice, i, width)))
    return F.array_min(F.transform(F.filter(places, lambda i: F.substr(twice, i, width) == least), lambda i: F.substr(twice, i, F.length(s))))


def flip(orientation) -> Column:
    return F.when(_col(orientation) == "+", "-").otherwise("+")


def canonical_link(a, oa, b, ob) -> Column:
    """The smaller of a link and its reverse; '+' comes before '-'."""
    return F.least(F.struct(_col(a).alias("a"), _col(oa).alias("oa"), _col(b).alias("b"), _col(ob).alias("ob")), F.struct(_col(b).alias("a"), flip(ob).alias("oa"), _col(a).alias("b"), flip(oa).alias("ob")))


def library_orientation(left, right) -> Column:
    pair = F.concat(_col(left), _col(right))
    return F.when(pair == "+-", "FR").when(pair == "-+", "RF").when(pair == "++", "FF").when(pair == "--", "RR")


def ratio_at_least(part, whole, numerator: int, denominator: int) -> Column:
    """part / whole >= numerator / denominator without a float."""
    wide = lambda x: _col(x).cast("decimal(38,0)")
    return wide(part) * F.lit(denominator) >= wide(whole) * F.lit(numerator)


def ratio(numerator, denominator) -> Column:
    """numerator / denominator, truncated to six decimals, as decimal(20,6); null over zero."""
    n, d = _col(numerator).cast("decimal(20,0)"), _col(denominator).cast("decimal(20,0)")
    return F.when(d > 0, (F.floor(n * 1000000 / F.when(d > 0, d)).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(20,6)"))


def quality_value(errors, columns) -> Column:
    """10 log10 of columns over errors, to six decimals; of columns + 1 without an error (a lower bound)."""
    e, n = _col(errors), _col(columns)
    return F.round(10 * F.log10(F.when(e > 0, n / F.when(e > 0, e)).otherwise(n + 1)), 6)


def run_lengths(c) -> Column:
    """A CIGAR from one operation letter per column, for the letters M, X, I, D and =."""
    runs = F.regexp_extract_all(_col(c), F.lit("(M+|X+|I+|D+|=+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))))


def truth_coordinate(first, step, offset, length) -> Column:
    """The coordinate at a read offset on a circular molecule."""
    return F.pmod(_col(first) + _col(step) * _col(offset), _col(length))


def split_is_calibration(c, numerator: int, denominator: int, domain: str = "helixframe/split/1") -> Column:
    """A stable share of identities, by the first 15 hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(domain), _col(c).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(denominator) < F.lit(numerator)


def counter_random(seed, counter, bound: int) -> Column:
    """An integer below `bound` from SHA-256 of a seed and a counter; the same in every partitioning."""
    digest = F.sha2(F.concat_ws(":", _col(seed).cast("string"), _col(counter).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(bound)


def register(spark: SparkSession) -> None:
    """revcomp and canonical_kmer as SQL functions that stay visible to Catalyst."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical_kmer(s STRING) RETURNS STRING RETURN least(s, reverse(translate(s, 'ACGT', 'TGCA')))")
