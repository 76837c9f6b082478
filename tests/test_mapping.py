"""Placements, audits, evidence, correction, evaluation and simulation on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import correction, evaluation, evidence, graph, kmers, mapping, simulation
from helixframe.plans import adapters

UNITS = "unitig_id string, seq string, topology string"
READS = "fragment_id long, lane int, role string, seq string, qual string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_placements_equal_a_plain_search(spark):
    rng = random.Random(4)
    units = [(f"u{i}", "".join(rng.choice("ACGT") for _ in range(40)), "linear") for i in range(4)] + [("c", "ACGTACGTACGTACGTACGT", "closed_graph_walk")]
    rows = []
    for i in range(40):
        seq = units[i % 4][1]
        a, n = rng.randrange(20), rng.choice([3, 8, 15, 20])
        s = seq[a : a + n]
        rows.append((i, 0, "S", rc(s) if i % 3 == 0 else s, None))
    rows += [(98, 0, "S", "ACGNT", None), (99, 0, "S", "", None)]
    want = set()
    for f, _, role, s, _ in rows[:-2]:
        for u, seq, t in units[:4]:
            for strand, v in (("+", s), ("-", rc(s))):
                want |= {(f, role, u, p, p + len(s), strand) for p in range(len(seq)) if seq[p:].startswith(v)}
    reads, frame = spark.createDataFrame(rows, READS), spark.createDataFrame(units, UNITS)
    placed = mapping.placements(reads, frame, 0)
    assert {(r.fragment_id, r.role, r.unitig_id, r.start, r.end, r.strand) for r in placed.collect()} == want
    states = {r.fragment_id: (r.state, r.n_groups) for r in mapping.audit_reads(reads, placed, 0, max_candidates=30).collect()}
    assert states[98][0] == states[99][0] == "ineligible_ambiguity_or_quality"
    n = sum(1 for w in want if w[0] == 5)
    assert states[5] == ("single_placement_group" if n == 1 else "multiple_placement_groups" if n <= 30 else "indeterminate_candidate_limit", n)


def test_reads_of_a_repeat_leave_at_the_limit(spark):
    """A repeat of tens of thousands of places: its reads are over the limit, others have all their places."""
    rng = random.Random(8)
    bases = "".join(rng.choice("ACGT") for _ in range(400))
    units = spark.createDataFrame([("a", "A" * 50_000 + bases, "linear"), ("b", bases[100:300] + "AC" * 40, "linear")], UNITS)
    rows = [(i, 0, "S", ("A" if i % 2 else "T") * (30 + i % 3), None) for i in range(600)] + [(900, 0, "S", bases[120:180], None), (901, 0, "S", rc(bases[10:70]), None), (902, 0, "S", "ACAC" * 8, None), (903, 0, "S", "G" * 40, None)]
    reads = spark.createDataFrame(rows, READS)
    placed = mapping.placements(reads, units, 0, max_candidates=100)
    states = {r.fragment_id: (r.state, r.n_groups) for r in mapping.audit_reads(reads, placed, 0, 100).collect()}
    assert {states[i] for i in range(600)} == {("indeterminate_candidate_limit", 101)}
    assert states[900] == ("multiple_placement_groups", 2) and states[901] == ("single_placement_group", 1) and states[903] == ("unmapped", 0)
    assert states[902] == ("multiple_placement_groups", 25)
    kept = [tuple(r) for r in placed.filter("fragment_id IN (900, 901)").orderBy("fragment_id", "unitig_id").collect()]
    assert kept == [(900, 0, "S", "a", 50_120, 50_180, "+"), (900, 0, "S", "b", 20, 80, "+"), (901, 0, "S", "a", 50_010, 50_070, "-")]
    assert placed.filter("fragment_id < 600").filter("unitig_id IS NULL AND start IS NULL").count() == 600 == placed.filter("fragment_id < 600").count()
    groups = {r.fragment_id: r.groups for r in mapping.ordered_groups(placed).collect()}
    assert groups[3] is None and [g.unitig_id for g in groups[900]] == ["a", "b"]
    with pytest.raises(Exception, match="more than 50 bases"):
        mapping.placements(reads, units, 0, longest=50).collect()


def test_sides_that_no_higher_window_covers_are_counted(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 5, 7, 9, 30])))
        rows.append((i, 0, "S", "".join("N" if rng.random() < 0.04 else c for c in s), "".join("!" if rng.random() < 0.04 else "I" for _ in s)))
    rows += [(90, 0, "S", "AACGTTAACGTT", None), (91, 0, "S", "acgtac", None), (92, 0, "S", None, None)]
    k, high, want = 4, 7, {}
    for _, _, _, s, q in rows:
        s, q = (s or "").upper(), q or "I" * len(s or "")
        ok = lambda a, n: a >= 0 and a + n <= len(s) and "N" not in s[a : a + n] and "!" not in q[a : a + n]
        for at in range(len(s) - k + 1):
            w = s[at : at + k]
            if not ok(at, k):
                continue
            least = min(w, rc(w))
            for side in ("left", "right"):
                if any(ok(m, high) and m <= at and at + k <= m + high and (m < at if side == "left" else at + k < m + high) for m in range(len(s))):
                    continue
                told = "fixed_point" if w == rc(w) else side if w == least else {"left": "right", "right": "left"}[side]
                want[least, told] = want.get((least, told), 0) + 1
    got = {(r.lower_kmer, r.side): r.lower_window_occurrences for r in evidence.unresolved_sides(spark.createDataFrame(rows, READS), k, high, 20).collect()}
    assert got == want and {s for _, s in got} == {"left", "right", "fixed_point"}


@pytest.mark.parametrize(("k", "high"), [(4, 4), (4, 7), (21, 31), (31, 41), (33, 41)])
def test_bare_sides_go_by_codes_from_fragments_or_reads(spark, k, high):
    rng = random.Random(k + high)
    genome = "".join(rng.choice("ACGT") for _ in range(150)) + "T" * 45 + "A" * 45 + "ACGT" * 12
    rows = []
    for i in range(80):
        at, n = rng.randrange(250), rng.choice([0, k - 1, k, k + 1, high - 1, high, 90])
        s = "".join(rng.choice("NXn") if rng.random() < 0.01 else c.lower() if i % 9 == 0 else c for c in genome[at : at + n])
        rows.append((i // 2, 0, f"R{i % 2 + 1}", s, None if i % 7 == 0 else "".join("!" if rng.random() < 0.01 else "I" for _ in s)))
    rows.append((99, 0, "R1", None, None))
    want = {}
    for _, _, _, s, q in rows:
        sound = "".join(c if c in "ACGT" and x != "!" else "." for c, x in zip((s or "").upper(), q or "I" * len(s or ""), strict=True))
        for stretch in sound.split("."):
            for at in range(len(stretch) - k + 1):
                w = stretch[at : at + k]
                least, room = min(w, rc(w)), len(stretch) >= high
                for side, covered in (("left", room and at > 0), ("right", room and at + k < len(stretch))):
                    told = "fixed_point" if w == rc(w) else side if w == least else {"left": "right", "right": "left"}[side]
                    if not covered:
                        want[least, told] = want.get((least, told), 0) + 1
    reads = spark.createDataFrame(rows, READS)
    for given in (reads, kmers.fragments(reads), kmers.fragments(reads.repartition(3, "fragment_id"))):
        found = evidence.unresolved_sides(given, k, high, 20)
        assert [tuple(r) for r in found.collect() if r.lower_window_occurrences != want.get((r.lower_kmer, r.side))] == [] and found.count() == len(want) > 0
        assert k > 31 or "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each stretch, window or side
    assert evidence.unresolved_sides(reads.filter("fragment_id = 99"), k, high, 20).collect() == []


def test_genomes_of_all_customers_go_neither_through_the_driver_nor_an_exchange(spark):
    for made in (adapters.fragments, adapters.reads):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        assert "md5" in plan and "md5" not in plan.split("REPARTITION_BY_COL")[-1]  # keys are dealt out, genomes made behind


def test_pair_states_follow_their_order_and_links_are_canonical(spark):
    units = spark.createDataFrame([("a", "A" * 10, "linear"), ("b", "C" * 10, "linear")], UNITS)
    audits = [(1, "single_placement_group", "single_placement_group"), (2, "single_placement_group", "single_placement_group"), (3, "unmapped", "ineligible_ambiguity_or_quality"), (4, "multiple_placement_groups", "unmapped"), (5, "single_placement_group", "single_placement_group")]
    rows = [(f, 0, r, s, 1) for f, x, y in audits for r, s in (("R1", x), ("R2", y))]
    placed = [(1, 0, "R1", "a", 4, 6, "+"), (1, 0, "R2", "b", 0, 2, "-"), (2, 0, "R1", "b", 8, 10, "-"), (2, 0, "R2", "a", 0, 2, "+"), (5, 0, "R1", "a", 0, 2, "+"), (5, 0, "R2", "a", 5, 7, "-")]
    pairs = mapping.audit_pairs(spark.createDataFrame(rows, "fragment_id long, lane int, role string, state string, n_groups long"), spark.createDataFrame(placed, "fragment_id long, lane int, role string, unitig_id string, start int, end int, strand string"), units)
    assert {r.fragment_id: r.state for r in pairs.collect()} == {1: "endpoint_tie", 2: "cross_unitig_observation", 3: "mate_ineligible", 4: "mate_unmapped", 5: "same_linear_unitig"}
    link = mapping.pair_links(pairs).collect()
    assert [(x.segment_a, x.end_a, x.segment_b, x.end_b, x.supplied_fragment_instances) for x in link] == [("a", "L", "b", "R", 1)]
    counts = {(r.lane, r.state): r.fragments for r in mapping.pair_states(pairs).collect()}
    assert len(counts) == 14 and counts[None, "endpoint_tie"] == counts[0, "endpoint_tie"] == 1 and counts[0, "mate_multiple_placement_groups"] == 0


def test_segments_are_cut_where_no_read_shows_the_transition(spark):
    seq = "AACGCTAGG"
    units = spark.createDataFrame([("u", seq, "linear")], UNITS)
    seen = [min(seq[i : i + 6], rc(seq[i : i + 6])) for i in (0, 1, 3)]
    ledger = spark.createDataFrame([(q, 1, 1) for q in seen], "qmer string, occurrences long, fragments long")
    parts = evidence.witnessed_segments(units, ledger, 5).orderBy("segment_no")
    assert [(r.first_step, r.edge_steps, r.seq) for r in parts.collect()] == [(0, 3, "AACGCTA"), (3, 2, "GCTAGG")]
    assert evidence.unsupported_adjacencies(parts, ledger, 5).isEmpty()


def test_closed_walks_are_cut_like_linear_ones_and_close_only_if_shown(spark):
    def run(keys, k, shown):
        units = graph.unitigs(spark.createDataFrame([(q, 2) for q in keys], "kmer string, support long"), k)
        ledger = spark.createDataFrame([(q, 2, 1) for q in shown], "qmer string, occurrences long, fragments long")
        parts = evidence.witnessed_segments(units, ledger, k)
        assert evidence.unsupported_adjacencies(parts, ledger, k).isEmpty()
        told = {r.segment_no: (r.topology, r.transitions, r.occurrences, r.fragments) for r in evidence.segment_evidence(parts, ledger, k).collect()}
        return [(r.first_step, r.edge_steps, r.topology, r.seq, *told[r.segment_no][1:]) for r in parts.orderBy("segment_no").collect() if told[r.segment_no][0] == r.topology]

    ring = ["ACA", "CAC"]
    assert run(ring, 3, ["ACAC", "CACA"]) == [(0, 2, "closed_graph_walk", "ACAC", 1, 2, 1)]
    assert run(ring, 3, ["ACAC"]) == [(0, 2, "linear", "ACAC", 1, 2, 1)]
    assert run(ring, 3, ["CACA"]) == [(0, 1, "linear", "ACA", 0, 0, 0), (1, 1, "linear", "CAC", 0, 0, 0)]
    assert run(ring, 3, []) == [(0, 1, "linear", "ACA", 0, 0, 0), (1, 1, "linear", "CAC", 0, 0, 0)]
    assert run(["AAA"], 3, ["AAAA"]) == [(0, 1, "closed_graph_walk", "AAA", 0, 0, 0)]
    assert run(["AAA"], 3, []) == [(0, 1, "linear", "AAA", 0, 0, 0)]


def test_a_single_error_is_corrected_and_ties_are_not(spark):
    truth = "ACGTTGCAAGGCTTAACCGATACG"
    spectrum = kmers.count_kmers(kmers.fragments(spark.createDataFrame([(i, 0, "S", truth, None) for i in range(3)], READS)), 7, 0)
    bad = truth[:10] + "T" + truth[11:]
    qual = "I" * 10 + "!" + "I" * 13
    reads = spark.createDataFrame([(0, 0, "S", bad, qual), (1, 0, "S", truth, "I" * 24)], READS)
    decisions = correction.correct(reads, {7: spectrum}, 20)
    assert {r.fragment_id: (r.state, r.pos, r.new) for r in decisions.collect()} == {0: ("corrected", 10, truth[10]), 1: ("unchanged", None, None)}
    assert {r.seq for r in correction.apply_corrections(reads, decisions).collect()} == {truth}


def test_two_and_three_errors_inside_one_k_are_corrected_together(spark):
    truth = "ACGTTGCAAGGCTTAACCGATACG"
    spectrum = kmers.count_kmers(kmers.fragments(spark.createDataFrame([(i, 0, "S", truth, None) for i in range(3)], READS)), 7, 0)

    def spoil(*places):
        return "".join("T" if i in places else c for i, c in enumerate(truth)), "".join("!" if i in places else "I" for i in range(24))

    reads = spark.createDataFrame([(0, 0, "S", *spoil(10, 14)), (1, 0, "S", *spoil(8, 10, 14)), (2, 0, "S", *spoil(10)), (3, 0, "S", truth, "!" * 24), (4, 0, "S", "C" * 24, "I" * 24), (5, 0, "S", *spoil(2, 19)), (6, 0, "S", *spoil(2, 20))], READS)

    def run(**given):
        decisions = correction.correct(reads, {7: spectrum}, 20, **given)
        rows = decisions.collect()
        told = {r.fragment_id: (r.state, r.reason, sorted((x.pos, x.new) for x in rows if x.fragment_id == r.fragment_id and x.pos is not None)) for r in rows}
        return told, {r.fragment_id: r.seq for r in correction.apply_corrections(reads, decisions).collect()}

    told, seqs = run()
    assert told[0] == ("corrected", None, [(10, truth[10]), (14, truth[14])]) and told[2] == ("corrected", None, [(10, truth[10])])
    assert seqs[0] == seqs[2] == seqs[3] == truth and seqs[1] == spoil(8, 10, 14)[0]
    assert told[1] == ("unchanged", "evidence_below_thresholds", []) and told[3] == ("unchanged", "already_trusted", []) and told[4] == ("unchanged", "no_editable_bases", [])
    assert told[6] == ("corrected", None, [(2, truth[2])]) and truth[20] == "T"  # the other weak base is right
    assert told[5] == ("quarantined", "conflicting_candidates", [])  # each change qualifies alone, and both together
    told, seqs = run(max_substitutions=3)
    assert told[1] == ("corrected", None, [(i, truth[i]) for i in (8, 10, 14)]) and seqs[1] == truth
    assert run(max_candidates=14)[0][0] == ("quarantined", "candidates_exceeded", []) and run(max_candidates=15)[0][0][0] == "corrected"
    assert run(max_sites=1)[0][0] == ("quarantined", "editable_positions_exceeded", [])
    assert run(unresolved="quarantine")[0][1] == run(unresolved="quarantine")[0][4] == ("quarantined", "unresolved_evidence", [])
    assert run(mode="diversity_preserving")[0][0] == ("quarantined", "independent_context_unavailable", [])
    assert {x[:2] for x in run(mode="raw_only")[0].values()} == {("unchanged", "raw_only")}


def test_unresolved_reads_lose_weak_ends_only_where_enough_is_left(spark):
    truth = "ACGTTGCAAGGCTTAACCGATACG"
    spectrum = kmers.count_kmers(kmers.fragments(spark.createDataFrame([(i, 0, "S", truth, None) for i in range(3)], READS)), 7, 0)
    other = "GATTACAGATTACCAGGTCCAATC"  # no window of it is known
    reads = spark.createDataFrame([(0, 0, "S", other, "!!" + "I" * 21 + "!"), (1, 0, "S", other, "I" * 24), (2, 0, "S", other, "!" * 20 + "IIII"), (3, 0, "S", truth, "!!" + "I" * 22), (4, 0, "S", "T" + truth[1:], "!" + "I" * 23)], READS)
    decided = correction.correct(reads, {7: spectrum}, 20, unresolved="trim_low_quality_terminals", minimum_length=10)
    told = {r.fragment_id: (r.state, r.reason, r.start, r.length) for r in decided.collect()}
    missed, cut = "terminal_trim_criteria_not_met", "unresolved_low_quality_or_ambiguous_termini"
    assert told == {0: ("trimmed", cut, 2, 21), 1: ("unchanged", missed, 0, 24), 2: ("unchanged", missed, 0, 24), 3: ("unchanged", "already_trusted", 0, 24), 4: ("corrected", None, 0, 24)}
    after = {r.fragment_id: (r.seq, r.qual) for r in correction.apply_corrections(reads, decided).collect()}
    assert after[0] == (other[2:23], "I" * 21) and after[1] == (other, "I" * 24) and after[4] == (truth, "!" + "I" * 23)
    sums = correction.accounting(reads, decided).collect()
    assert {(r.state, r.emitted_bases, r.trimmed_bases, r.changed_bases) for r in sums} == {("trimmed", 21, 3, 0), ("unchanged", 48, 0, 0), ("unchanged", 24, 0, 0), ("corrected", 24, 0, 1)}


def test_alternatives_are_the_smallest_ids_and_the_digest_covers_all_candidates(spark):
    truth = "ACGTTGCAAGGCTTAACCGATACG"
    spectrum = kmers.count_kmers(kmers.fragments(spark.createDataFrame([(i, 0, "S", truth, None) for i in range(3)], READS)), 7, 0)
    bad, qual = truth[:10] + "T" + truth[11:14] + "R" + truth[15:], "I" * 10 + "!" + "I" * 13
    reads = spark.createDataFrame([(0, 0, "S", bad, qual), (1, 0, "S", truth, "I" * 24), (2, 0, "S", "", ""), (3, 0, "S", "N", None)], READS)
    rows = correction.evaluated_candidates(reads, {7: spectrum}, 20)
    want = {}
    for a in ("", "A", "C", "G"):
        for b in ("", "A", "G"):
            if a or b:
                text = bad[:10] + (a or bad[10]) + bad[11:14] + (b or bad[14]) + bad[15:]
                want[hashlib.sha256((correction.CANDIDATE + text).encode()).hexdigest()] = ",".join([f"10:T>{a}"] * bool(a) + [f"14:R>{b}"] * bool(b))
    mine = [r for r in rows.collect() if r.fragment_id == 0]
    assert {r.candidate_id: r.changes for r in mine} == want and len(mine) == 11
    assert {r.changes for r in mine if r.qualified} == {f"10:T>{truth[10]},14:R>{truth[14]}"}
    best = sorted((r.rank, r.candidate_id) for r in correction.alternatives(rows, 4).collect() if r.fragment_id == 0)
    assert best == list(enumerate(sorted(want)[:4], 1))
    told = {r.fragment_id: r for r in correction.candidate_evidence(rows, 8).collect()}
    assert set(told) == {0, 3}  # a trusted read has no search, an empty one nothing to change
    line = lambda r: "\t".join(map(str, (r.candidate_id, r.changes, int(r.qualified), r.layers, r.trusted_gain, r.support_gain, r.penalty, r.low)))
    chain = "".join(hashlib.sha256(line(r).encode()).hexdigest() for r in sorted(mine, key=lambda r: (r.n_edits, r.changes)))
    assert told[0].digest == hashlib.sha256((correction.CANDIDATES + chain + "11").encode()).hexdigest()
    assert (told[0].evaluated, told[0].qualified, told[0].exact_substitutions, told[0].ambiguity_resolutions, told[0].mixed, told[0].truncated, told[3].truncated) == (11, 1, 9, 8, 6, True, False)
    assert correction.candidate_evidence(rows.filter("false")).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        correction.alternatives(rows, 0)


def test_trimming_cuts_ends_only(spark):
    reads = spark.createDataFrame([(0, 0, "S", "NACGTACGTA", "I" * 9 + "!"), (1, 0, "S", "ACGNTACGTA", "I" * 10), (2, 0, "S", "NNNN", "IIII")], READS)
    assert {r.fragment_id: (r.start, r.length, r.state) for r in correction.trim_ranges(reads, 20, 5).collect()} == {0: (1, 8, "trimmed"), 1: (0, 10, "internal_ambiguity"), 2: (4, 0, "too_short")}


def test_junctions_find_a_chimera(spark):
    rng = random.Random(6)
    one, two = ("".join(rng.choice("ACGT") for _ in range(80)) for _ in range(2))
    truths = spark.createDataFrame([(0, "primary", one), (1, "minor", two)], "molecule int, truth_class string, seq string")
    contigs = spark.createDataFrame([("x", one[10:40] + two[20:50]), ("y", one[5:60])], "contig_id string, seq string")
    rows = evaluation.junctions(contigs, truths, 8)
    assert {(r.contig_id, r.boundary, r.primary_minor_chimera) for r in rows.filter("classification = 'false_junction'").collect()} >= {("x", 30, True)}
    assert {r.classification for r in rows.filter("contig_id = 'y'").collect()} == {"correct_truth_adjacency"}
    placed = evaluation.exact_alignments(contigs, truths)
    assert [(r.contig_id, r.molecule, r.start, r.end) for r in placed.collect()] == [("y", 0, 5, 60)]
    assert {r.molecule: r.covered for r in evaluation.coverage(placed.select("molecule", "truth_class", "start", "end"), truths).collect()} == {0: 55, 1: 0}


def plain_fit(query, reference):
    """(edits, -matches, gaps, start) by comparing tuples in every cell."""
    row = [(0, 0, 0, j) for j in range(len(reference) + 1)]
    for q in query:
        new = [(row[0][0] + 1, row[0][1], row[0][2] + 1, row[0][3])]
        for j, r in enumerate(reference, 1):
            d, u, left = row[j - 1], row[j], new[-1]
            new.append(min((d[0] + (q != r), d[1] - (q == r), d[2], d[3]), (u[0] + 1, u[1], u[2] + 1, u[3]), (left[0] + 1, left[1], left[2] + 1, left[3])))
        row = new
    return min(row)


def test_best_fits_align_all_reads_on_both_strands_and_classes(spark):
    rng = random.Random(9)
    main = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3)]
    rows = [(i, c, s if c == "primary" else s[:30] + ("A" if s[30] != "A" else "C") + s[31:]) for i, s in enumerate(main) for c in ("primary", "minor")]
    reads = []
    for i in range(24):
        s = list(rows[i % 6][2][12:50])
        if i % 4 == 1:
            s[5] = "N"
        if i % 4 == 2:
            del s[20]
        s = "".join(s)
        reads.append((i, 0, "R2" if i % 2 else "R1", rc(s) if i % 3 else s, None))
    reads.append((99, 0, "R1", "N" * 30, None))
    got = evaluation.best_fits(spark.createDataFrame(reads, READS), spark.createDataFrame(rows, "molecule long, truth_class string, seq string"), 8).collect()
    want = {}
    for f, _, role, s, _ in reads[:-1]:
        tried = [((*plain_fit(s, t if strand == "+" else rc(t))[:3], m, c != "primary", strand == "-", plain_fit(s, t if strand == "+" else rc(t))[3]), c, strand) for m, c, t in rows for strand in "+-"]
        (e, x, g, m, _, _, start), c, strand = min(tried)
        want[f, role] = (m, c, strand, e, -x, g, start)
    assert {(r.fragment_id, r.role): (r.molecule, r.truth_class, r.strand, r.edits, r.matches, r.inserted + r.deleted, r.start) for r in got} == want


def test_simulated_reads_replay_from_their_origins(spark):
    truths = simulation.molecules(spark, 7, 500)
    first = simulation.simulate(truths, 60, 7, error_ppm=20_000, low_quality_ppm=20_000)
    assert simulation.replay_errors(first, truths).isEmpty()
    again = simulation.simulate(truths.repartition(3), 60, 7, error_ppm=20_000, low_quality_ppm=20_000)
    assert first.count() == 120 and first.exceptAll(again).isEmpty() and first.selectExpr("sum(size(errors)) AS n").first().n > 50
    held = kmers.retain(kmers.count_kmers(kmers.fragments(simulation.simulate(truths, 400, 3, minor_ppm=0).withColumn("lane", F.lit(0))), 21, 0), 1)
    sequence = truths.filter("molecule = 0").first().seq
    longest = max((r.seq for r in graph.unitigs(held, 21).collect()), key=len)
    assert longest in sequence or longest in rc(sequence)


def test_coded_decisions_equal_those_of_texts_and_move_no_spelling(spark, monkeypatch):
    from helixframe.functions import packed

    rng, k = random.Random(5), 7
    genome = "".join(rng.choices("ACGT", k=400))
    frags = spark.createDataFrame([(i, 0, [("R1", genome[s : s + 40], None)]) for i, s in enumerate(rng.choices(range(360), k=60))], "fragment_id long, lane int, reads array<struct<role:string,seq:string,qual:string>>")
    kept = kmers.retain(kmers.count_kmers(frags, k, 0, with_code=True)).localCheckpoint()
    units = graph.unitigs(kept, k).localCheckpoint()
    links, ledger = graph.links(units, k).localCheckpoint(), evidence.transition_ledger(frags, k, 0, with_code=True).localCheckpoint()
    coded = evidence.transition_decisions(ledger, units, links, kept, k)
    assert "hashpartitioning(qmer" not in coded._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, coded.collect()))
    monkeypatch.setattr(packed, "LONGEST", k)
    assert found == sorted(map(tuple, evidence.transition_decisions(ledger, units, links, kept, k).collect()))
    assert {r[-1] for r in found} >= {"admitted", "excluded_endpoint", "excluded_no_witness"}
