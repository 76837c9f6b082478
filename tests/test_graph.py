"""Compaction against golden values and an independent walk over small and random key sets."""

import itertools
import random

import pytest

from helixframe.functions import dna
from helixframe.operators import components, evidence, graph


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return min(s, rc(s))


def keys(spark, counts):
    return spark.createDataFrame([(canon(s), n) for s, n in counts.items()], "kmer string, support long")


def plain(counts, k):
    """Unitigs (sequence, topology) and links by an independent walk."""
    handles = {s for c in counts for s in (c, rc(c))}
    out, into = {}, {}
    for h in sorted(handles):
        out.setdefault(h[:-1], []).append(h)
        into.setdefault(h[1:], []).append(h)
    fixed = {n for h in handles if h == rc(h) for n in (h[:-1], h[1:])}
    edge = lambda n: len(out.get(n, [])) != 1 or len(into.get(n, [])) != 1 or n == rc(n) or n in fixed
    seen, units = set(), set()
    for h in sorted(handles):
        if edge(h[:-1]):
            walk = [h]
            while not edge(walk[-1][1:]):
                walk.append(out[walk[-1][1:]][0])
            seen.update(walk)
            s = walk[0] + "".join(x[-1] for x in walk[1:])
            units.add((min(s, rc(s)), "linear"))
    for h in sorted(handles - seen):
        if h not in seen:
            walk = [h]
            while out[walk[-1][1:]][0] != h:
                walk.append(out[walk[-1][1:]][0])
            seen.update(walk)
            ring = "".join(x[0] for x in walk)
            turned = min(s[i:] + s[:i] for s in (ring, rc(ring)) for i in range(len(ring)))
            seen.update(rc(x) for x in walk)
            units.add(((turned * k)[: len(ring) + k - 1], "closed_graph_walk"))
    return units


def run(spark, counts, k):
    held = keys(spark, counts)
    units = graph.unitigs(held, k)
    return held, units, {(r.seq, r.topology): r for r in units.collect()}


@pytest.mark.parametrize(
    "counts, k, sequences, n_links",
    [
        ({"AACGC": 3, "ACGCT": 5, "CGCTA": 7}, 5, {"AACGCTA"}, 0),
        ({"TCGCGA": 1, "CGCGAC": 1}, 6, {"CGCGAC", "TCGCGA"}, 2),
        ({"AATT": 13, "ATTG": 5}, 4, {"AATT", "ATTG"}, 2),
        ({"ATA": 4}, 3, {"ATA"}, 2),
        ({"ACA": 2, "CAC": 9}, 3, {"ACAC"}, 1),
        ({"CAA": 2, "AAC": 3, "AAG": 5}, 3, {"CAA", "AAC", "AAG"}, 2),
    ],
)
def test_golden_compactions(spark, counts, k, sequences, n_links):
    held, units, found = run(spark, counts, k)
    assert {s for s, _ in found} == sequences
    linked = graph.links(units, k)
    assert linked.count() == n_links and graph.link_overlaps(units, linked, k).isEmpty() and graph.rc_asymmetry(held, k).isEmpty()


def test_support_summary_uses_the_lower_median(spark):
    row = run(spark, {"AACGC": 3, "ACGCT": 5, "CGCTA": 7}, 5)[2]["AACGCTA", "linear"]
    assert (row.edge_steps, row.canonical_kmers, row.minimum_support, row.lower_median_support, row.maximum_support) == (3, 3, 3, 5, 7)


def test_no_keys_give_no_unitigs(spark):
    held, units, found = run(spark, {}, 5)
    assert not found and graph.links(units, 5).isEmpty()


def test_random_key_sets_equal_the_plain_walk(spark):
    rng = random.Random(5)
    for k in (3, 4, 5):
        universe = sorted({canon("".join(t)) for t in itertools.product("ACGT", repeat=k)})
        for size in (4, 14):
            counts = {s: rng.randrange(1, 9) for s in rng.sample(universe, size)}
            assert set(run(spark, counts, k)[2]) == plain(counts, k)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_unitig_ids_frame_their_sequence(spark):
    import hashlib

    row = spark.createDataFrame([("ACGTA", "linear")], "seq string, topology string").select(dna.unitig_id("seq", "topology", 5).alias("i")).first()
    assert row.i == "utg-" + hashlib.sha256(b"helixframe/unitig/1" + b"\x05" + b"\x00" + (5).to_bytes(8, "little") + b"ACGTA").hexdigest()


def test_forced_paths_join_segments_without_a_choice(spark):
    """Segments of a line are joined to it; a fork stays apart; a ring of segments closes."""
    k = 4
    cut = lambda text, at: [text[a : b + k - 1] for a, b in zip([0, *at], [*at, len(text) - k + 1], strict=True)]
    line, ring = "ACCGATTGCAAGTC", "GGATACTC"
    fork = ["TTTACG", "ACGGA", "ACGCT"]
    parts = [("l", n, x, "linear") for n, x in enumerate(cut(line, [3, 7]))] + [("f", n, x, "linear") for n, x in enumerate(fork)] + [("r", n, x, "linear") for n, x in enumerate(cut(ring + ring[: k - 1], [5]))] + [("c", 0, "AAAATTTA", "closed_graph_walk")]
    segments = spark.createDataFrame(parts, "unitig_id string, segment_no int, seq string, topology string")
    linked = spark.createDataFrame([("l", 0, "+", "l", 1, "+"), ("l", 1, "+", "l", 2, "+"), ("f", 0, "+", "f", 1, "+"), ("f", 0, "+", "f", 2, "+"), ("r", 0, "+", "r", 1, "+"), ("r", 1, "+", "r", 0, "+"), ("c", 0, "+", "c", 0, "+")], "from_unitig string, from_no int, from_orientation string, to_unitig string, to_no int, to_orientation string")
    rows = evidence.forced_paths(segments, linked, k).collect()
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    least = min(x[i:] + x[:i] for x in (ring, turned(ring)) for i in range(len(ring)))
    want = {(min(line, turned(line)), "linear"), *((min(x, turned(x)), "linear") for x in fork), (least + least[: k - 1], "closed_graph_walk"), ("AAAATTTA", "closed_graph_walk")}
    assert {(r.seq, r.topology) for r in rows} == want and len(rows) == len(want)


def test_chains_of_a_slice_end_at_what_is_not_given():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        names = rng.sample(range(1000), 60)
        before, done, at = {}, {}, 0
        while at < len(names):  # walks and rings
            part = names[at : at + rng.randrange(1, 15)]
            ring = rng.random() < 0.3 and len(part) > 1
            for i, x in enumerate(part):
                before[x], done[x] = (part[i - 1] if i or ring else x), not i and not ring
            at += len(part)
        given = rng.sample(names, rng.randrange(1, 61))
        entry, off = graph._chains(np.array(given), np.array([before[x] for x in given]), np.array([done[x] for x in given]))
        for x, e, n in zip(given, entry.tolist(), off.tolist(), strict=True):
            at, steps, seen = x, 0, {x}
            while not done[at] and before[at] in given and before[at] not in seen:
                at, steps = before[at], steps + 1
                seen.add(at)
            if not done[at] and before[at] in given:  # a ring that is given whole
                at, steps = x, 0
            assert (e, n) == (at, steps)


@pytest.mark.parametrize("k", [3, 4, 5, 8])
def test_nodes_from_codes_equal_those_of_handles(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGT") for _ in range(90 if k < 5 else 900)) + "A" * k + "AT" * k + "ACGT" * k
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    found = sorted({min(w, turned(w)) for i in range(len(text) - k + 1) for w in [text[i : i + k]] if rng.random() < 0.7})
    counts = spark.createDataFrame([(w, 2) for w in found], "kmer string, support long")
    coded = graph.nodes_of(counts.withColumn("code", dna.encode("kmer")), k)
    plain = graph.nodes(graph.handles(counts, k))
    assert "node" in coded.columns and sorted(map(tuple, coded.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("size", [4, 1 << 20])
def test_pieces_hold_every_handle_once_and_are_chains(spark, monkeypatch, size):
    rng, k = random.Random(size), 13
    text = "".join(rng.choice("ACGT") for _ in range(1500))
    found = sorted({canon(text[i : i + k]) for i in range(len(text) - k + 1)})
    monkeypatch.setattr(graph, "SLICE", size)
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(found)], "kmer string, support long").repartition(3)
    pieces = graph._linked_pieces(counts, k)
    rows = graph._handles_of(pieces, k).select(dna.decode("id", k), "support", dna.decode("ptr", k)).collect()
    assert sorted((s, n) for s, n, _ in rows) == sorted((s, i + 1) for i, w in enumerate(found) for s in {w, rc(w)})
    assert all(p == s or p[1:] == s[:-1] for s, _, p in rows)
    assert pieces.count() < len(found)  # far fewer rows than the handles


@pytest.mark.parametrize("k", [31, 32, 33, 41])
def test_walks_and_rings_of_long_keys_equal_a_plain_walk(spark, monkeypatch, k):
    """Linear walks, forks, palindromes and a ring, in slices that cut them."""
    monkeypatch.setattr(graph, "SLICE", 64)
    rng = random.Random(k)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    ring, shared, half = text(70), text(50), text(k)
    linear = [text(40) + shared + text(40), text(40) + shared + text(40), half + rc(half)]
    counts = {canon(s[i : i + k]): rng.randint(2, 9) for s in [ring + ring[: k - 1], *linear] for i in range(len(s) - k + 1)}
    _, _, found = run(spark, counts, k)
    assert set(found) == plain(counts, k) and "closed_graph_walk" in {t for _, t in found}
    for (seq, _), row in found.items():
        supports = sorted(counts[canon(seq[i : i + k])] for i in range(len(seq) - k + 1))
        assert (row.edge_steps, row.minimum_support, row.lower_median_support, row.maximum_support) == (len(supports), supports[0], supports[(len(supports) - 1) // 2], supports[-1])
    held = keys(spark, counts)
    assert graph._linked_pieces(held, k).count() < 2 * held.count()  # so fewer rows are ranked than there are handles
