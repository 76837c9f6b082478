"""Windows, counts and digests against golden values and a plain recount."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna, packed
from helixframe.operators import evidence, graph, kmers

SCHEMA = "fragment_id long, lane int, role string, seq string, qual string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return min(s, rc(s))


def reads(spark, seqs, qual=None):
    return spark.createDataFrame([(i, 0, "S", s, qual) for i, s in enumerate(seqs)], SCHEMA)


def test_toy_reads_have_the_golden_counts(spark):
    rows = reads(spark, ["AACGTTGCAACGTT"] * 3 + ["CGTTGCAACGTTAA"])
    both = {}
    for unit in ("occurrence", "fragment"):
        for r in kmers.count_kmers(kmers.fragments(rows), 5, 0, unit).collect():
            both.setdefault(r.kmer, []).append(r.support)
    assert both == {"AACGT": [14, 4], "CAACG": [8, 4], "CGTTA": [1, 1], "GCAAC": [8, 4], "GTTAA": [1, 1], "TGCAA": [8, 4]}


def test_window_classes_are_exclusive(spark):
    row = kmers.window_stats(reads(spark, ["AACNTACGTACGT"], "II!IIIIII!III"), 5, 20).first()
    assert (row.possible, row.accepted, row.ambiguity_only, row.quality_only, row.ambiguity_and_quality) == (9, 1, 1, 4, 3)


def test_mates_of_a_fragment_count_once(spark):
    rows = spark.createDataFrame([(7, 0, "R1", "AACGT", None), (7, 0, "R2", "ACGTT", None)], SCHEMA)
    assert [tuple(r) for r in kmers.count_kmers(kmers.fragments(rows), 5, 0).collect()] == [("AACGT", 1)]


def test_counts_equal_a_recount_in_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(i // 2, 0, "R1" if i % 2 == 0 else "R2", "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randrange(0, 30))), None) for i in range(60)]
    occurrences, fragments = Counter(), defaultdict(set)
    for f, _, _, s, _ in rows:
        for i in range(len(s) - 6):
            if "N" not in s[i : i + 7]:
                occurrences[canon(s[i : i + 7])] += 1
                fragments[canon(s[i : i + 7])].add(f)
    for parts in (1, 5):
        frame = kmers.fragments(spark.createDataFrame(rows, SCHEMA).repartition(parts))
        assert {r.kmer: r.support for r in kmers.count_kmers(frame, 7, 0, "occurrence").collect()} == occurrences
        assert {r.kmer: r.support for r in kmers.count_kmers(frame, 7, 0).collect()} == {k: len(v) for k, v in fragments.items()}


def test_state_digest_depends_on_rows_only(spark):
    rows = [("AAC", 2), ("ACG", 1), ("CAA", 5)]
    one, two, other = (kmers.state_digest(spark.createDataFrame(r, "kmer string, support long"), "x").first() for r in (rows, rows[::-1], [*rows[:2], ("CAA", 6)]))
    assert one == two and one.digest != other.digest and (one["keys"], one.mass) == (3, 8)
    empty = kmers.state_digest(spark.createDataFrame([], "kmer string, support long"), "x").first()
    assert (empty["keys"], empty.mass) == (0, 0)


def test_scalar_functions(spark):
    row = spark.range(1).select(
        dna.revcomp_iupac(F.lit("acgtryn")).alias("a"),
        dna.decode(dna.encode(F.lit("ACGTACGT")), 8).alias("b"),
        dna.minimum_rotation(F.lit("CAAB")).alias("c"),
        dna.run_lengths(F.lit("==X=II")).alias("d"),
        dna.minimizer(F.lit("TTTTACG"), 7, 3)["key"].alias("e"),
        dna.ratio(F.lit(2), F.lit(3)).cast("string").alias("f"),
        dna.truth_coordinate(F.lit(1), F.lit(-1), F.lit(3), F.lit(10)).alias("g"),
        dna.route(F.lit("TT"), 2, 7).alias("h"),
    ).first()
    assert tuple(row) == ("NRYACGT", "ACGTACGT", "AABC", "2=1X1=2I", "AAA", "0.666666", 8, 15 % 7)


def test_super_kmers_are_runs_of_one_minimizer(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(60))
    k, m = 9, 4
    minimizer = lambda w: min(canon(canon(w)[i : i + m]) for i in range(k - m + 1))
    runs = []
    for i in range(len(seq) - k + 1):
        x = minimizer(seq[i : i + k])
        if runs and runs[-1][2] == x:
            runs[-1][1] += 1
        else:
            runs.append([i, 1, x])
    found = kmers.super_kmers(reads(spark, [seq]), k, m, 16, 0).orderBy("first_window").collect()
    assert [[r.first_window, r.window_count, r.minimizer] for r in found] == runs


def test_operators_obey_the_limits(spark):
    frags = kmers.fragments(reads(spark, ["ACGTACGT"]))
    for wrong in ({"k": 2}, {"k": 128}, {"k": 5, "minimum_quality": 94}, {"k": 5, "unit": "base"}):
        with pytest.raises(ValueError):
            kmers.count_kmers(frags, **wrong)
    with pytest.raises(ValueError, match="3 to 127"):
        graph.unitigs(kmers.count_kmers(frags, 5), 128)
    for ks in ([5], [7, 5], [5, 40]):
        with pytest.raises(ValueError):
            evidence.portfolio_counts(frags, ks)


def test_a_portfolio_from_one_scan_equals_each_k_alone(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = [genome[i : i + 40] for i in range(0, 81, 4)] * 2 + [rc(genome[20:70]), genome[:30] + "N" + genome[31:50], "AC", "", None]
    frags = kmers.fragments(reads(spark, seqs))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    both = evidence.portfolio_counts(frags, [5, 9], 0)
    for k in (5, 9):
        one = both.filter(F.col("k") == k)
        for unit, column in (("fragment", "fragments"), ("occurrence", "occurrences")):
            assert rows(one, "kmer", column) == rows(kmers.count_kmers(frags, k, 0, unit), "kmer", "support")
    for ks in ([7, 9], [9, 33]):
        for k, found in evidence.portfolio(frags, ks, 2, 0).items():
            units = graph.unitigs(kmers.retain(kmers.count_kmers(frags, k, 0)), k)
            ledger = evidence.transition_ledger(frags, k, 0)
            assert rows(found["ledger"], "qmer", "occurrences", "fragments") == rows(ledger, "qmer", "occurrences", "fragments")
            assert rows(found["unitigs"], "unitig_id", "seq") == rows(units, "unitig_id", "seq") != []
            assert rows(found["segments"], "unitig_id", "segment_no", "seq") == rows(evidence.witnessed_segments(units, ledger, k), "unitig_id", "segment_no", "seq")
    none = evidence.portfolio_counts(frags.filter("false"), [5, 9], 0)
    assert none.columns == ["k", "kmer", "fragments", "occurrences"] and none.count() == 0


@pytest.mark.parametrize("k", [3, 11, 21, 31])
def test_counts_in_buckets_equal_a_plain_count(spark, monkeypatch, k):
    rng, turn = random.Random(k), str.maketrans("ACGT", "TGCA")
    genome = "".join(rng.choice("ACGT") for _ in range(120)) + "A" * 60 + "ACAC" * 20

    def cut():
        at = rng.randrange(len(genome) - 20)
        return "".join(rng.choice("N" + 60 * c) for c in genome[at : at + rng.randrange(2, 90)])

    reads = [(i, 0, [("R1", cut(), None), ("R2", cut().translate(turn)[::-1], None)][: 1 + i % 2]) for i in range(150)]
    frags = spark.createDataFrame([*reads, (900, 0, None), (901, 0, [("S", None, None)])], "fragment_id long, lane int, reads array<struct<role:string,seq:string,qual:string>>")
    many, held = {}, {}
    for i, _, mates in reads:
        for w in (s[j : j + k] for _, s, _ in mates for j in range(len(s) - k + 1)):
            if "N" not in w:
                c = min(w, w.translate(turn)[::-1])
                many[c] = many.get(c, 0) + 1
                held.setdefault(c, set()).add(i)
    monkeypatch.setattr(kmers, "COUNTED", 40)  # so that buckets are counted in parts
    found = kmers.spectra(frags.repartition(3), [k, k - 1], 0).filter(F.col("k") == k).select(dna.decode("code", k), "occurrences", "fragments").collect()
    assert sorted(map(tuple, found)) == sorted((c, n, len(held[c])) for c, n in many.items())


def test_runs_of_windows_are_fewer_than_windows():
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(5000))
    given = packed.reads_of(pa.array([seq]), pa.nulls(1, pa.string()), 0)
    runs, _ = kmers._runs(np.array([1]), *given, 21)
    assert runs["windows"].sum() == 4980 and len(runs) < 1250


@pytest.mark.parametrize("k", [4, 5])
def test_contexts_as_bits_equal_contexts_as_rows(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGT") for _ in range(260)) + "ACGTACGT" + "AATTAATT"
    canon = lambda n: sorted({min(w, rc(w)) for i in range(len(text) - n + 1) for w in [text[i : i + n]] if rng.random() < 0.6})
    lower, higher = (spark.createDataFrame([(w, 2) for w in canon(n)], "kmer string, support long") for n in (k, k + 4))
    rows = evidence.multik_contexts(lower, higher, k, k + 4).distinct().collect()
    bases = defaultdict(set)
    for r in rows:
        bases[r.lower_kmer, r.side].add(r.base)
    assert sorted(map(tuple, evidence.multik_conflicts(lower, higher, k, k + 4).collect())) == sorted(tuple(r) for r in rows if len(bases[r.lower_kmer, r.side]) > 1)
    sides = {(r.kmer, s) for r in lower.collect() for s in (["fixed_point"] if r.kmer == rc(r.kmer) else ["left", "right"])}
    assert sorted(map(tuple, evidence.multik_unresolved(lower, higher, k, k + 4).collect())) == sorted(sides - set(bases))


def test_runs_are_shipped_in_few_bytes_and_come_back_whole():
    draw = np.random.default_rng(4)
    for k in (3, 21, 31):
        runs = np.zeros(200, kmers._RUN)
        runs["windows"] = draw.integers(1, kmers.RUN + 1, 200)
        runs["first"] = draw.integers(0, 4**k, 200, dtype=np.uint64)
        runs["rest"] = draw.integers(0, 1 << 32, 200, dtype=np.uint32)
        runs["fragment"], bucket = np.arange(200) // 3, np.arange(200) // 50
        heads, data, size = kmers._packed_runs(runs, bucket, k)
        back = kmers._unpacked_runs(heads, data, k)
        assert (size == -(-(k + runs["windows"].astype(int) - 1) // 4)).all() and len(data) == size.sum() and (back["first"] == runs["first"]).all()
        assert (kmers.run_codes(back, k)[0] == kmers.run_codes(runs, k)[0]).all()
        assert (np.diff(back["fragment"].astype(int)) == ((np.diff(runs["fragment"].astype(int)) != 0) | (np.diff(bucket) != 0))).all()


def test_minimizers_and_transitions_go_by_codes(spark):
    draw = random.Random(8)
    texts = sorted({"".join(draw.choices("ACGT", k=21)) for _ in range(30)} | {"A" * 21, "ACACACACACACACACACACA"})
    counts = spark.createDataFrame([(t, 2) for t in texts], "kmer string, support long")
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {t: min((min(t[i : i + 11], back(t[i : i + 11])), i) for i in range(11)) for t in texts}
    rows = kmers.minimizers(counts, 21, 11, 64)
    assert {r.kmer: (r.minimizer, r.minimizer_pos) for r in rows.collect()} == want
    assert "key#" in rows._jdf.queryExecution().optimizedPlan().toString()  # no spelling goes to Python
    reads = spark.createDataFrame([(0, 0, "S", "ACGTNACGTTG", "IIIIIIIIII!"), (1, 0, "S", "AC", None), (2, 0, "S", "TTTTT", None)], SCHEMA)
    found = evidence.qmer_windows(reads, 3, 20)
    assert sorted(map(tuple, found.collect())) == [(0, "S", 0, "ACGT", "+"), (0, "S", 5, "ACGT", "+"), (0, "S", 6, "AACG", "-"), (2, "S", 0, "AAAA", "-"), (2, "S", 1, "AAAA", "-")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [4, 9])
def test_higher_keys_meet_lower_ones_in_buckets(spark, monkeypatch, k):
    """Contents and sums against a plain count, with repeats inside a higher k-mer, in small parts; no row for each window is shuffled."""
    monkeypatch.setattr(kmers, "COUNTED", 50)
    rng, higher_k = random.Random(k), k + 6
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    canon = lambda s: min(s, turned(s))
    text = "".join(rng.choices("ACGT", k=300)) + "A" * 20 + "AC" * 12 + "ACGT" * 6
    high = {canon(text[i : i + higher_k]): rng.randint(2, 9) for i in range(len(text) - higher_k + 1)}
    low = {w: rng.randint(2, 9) for w in sorted({canon(text[i : i + k]) for i in range(len(text) - k + 1)}) if rng.random() < 0.8}
    lower, higher = (spark.createDataFrame(sorted(x.items()), "kmer string, support long").repartition(3) for x in (low, high))
    inside = [(h, i, canon(h[i : i + k]), "+" if h[i : i + k] == canon(h[i : i + k]) else "-", canon(h[i : i + k]) in low) for h in high for i in range(7)]
    assert sorted(map(tuple, evidence.multik_contains(lower, higher, k, higher_k).collect())) == sorted(inside)
    held = {(h, x) for h, _, x, _, there in inside if there}
    sums = sorted((x, low[x], sum(y == x for _, y in held), sum(high[h] for h, y in held if y == x)) for x in {x for _, x in held})
    found = evidence.multik_supports(lower, higher, k, higher_k)
    assert sorted(map(tuple, found.collect())) == sums
    assert "lower_kmer" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
