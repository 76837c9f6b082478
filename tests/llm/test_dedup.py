"""SimHash components and repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import simhash, substrings

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(1, 8))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = prose(60)
BASE = prose(120)


def corpus():
    texts = [None, "", "one", "Two Words\tHere", "x y " * 60, "x y " * 61, BASE, BASE, BASE.upper(), BASE + " end", prose(20) + " " + PASSAGE + " " + prose(15), PASSAGE, PASSAGE + "\n" + prose(40), prose(10) + "  " + PASSAGE[40:], "Ä b " * 50]
    for _ in range(12):
        words = BASE.split()
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(RNG.randrange(1, 90)) for _ in range(20)]
    rows = [(i, t, "k", i) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, texts[10], "k", 0), (None, prose(50), "k", 0)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, k1 string, component_id long"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    return label


def check_components(spark):
    found = simhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    prints = [fingerprint(t) for _, t, *_ in ROWS]
    label = components(prints)
    least = {}
    for (i, *_), c in zip(ROWS, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{p:016x}", least.get(c)) for (i, *_), p, c in zip(ROWS, prints, label, strict=True))
    assert Counter(map(tuple, found)) == want


def test_components_equal_brute_force(spark):
    check_components(spark)


def test_crowded_cells_and_short_segments_lose_no_link(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(60):
            prints.add(b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 6), replace=False)))
    prints = sorted(prints)
    fps = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, least long")
    groups = lambda xs: {frozenset(k for k in range(len(fps)) if xs[k] == c) for c in set(xs)}
    want = groups(components(prints))
    for bits, cell in ((2, 2048), (2, 3), (1, 2048), (1, 4)):
        label = {f: f for f in fps}
        for u, v in simhash.links(frame, bits, cell).collect():
            a, b = label[u], label[v]
            label = {k: (a if x == b else x) for k, x in label.items()}
        assert groups([label[f] for f in fps]) == want


def test_embedding_bounds_the_hamming_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    for k in range(200):
        for x in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(x)
    cells = lambda fps: [set(c[i == k].tolist()) for k in range(len(fps)) for c, i in [tuple(map(np.concatenate, zip(*simhash.cells(fps), strict=True)))]]
    assert all(x & y for x, y in zip(cells(a[:40]), cells(b[:40]), strict=True))
    one = lambda fps: [set(c[i == k].tolist()) for k in range(len(fps)) for c, i in [tuple(map(np.concatenate, zip(*simhash.cells(fps, 1), strict=True)))]]
    assert all(x & y for x, y in zip(one(a[:40]), one(b[:40]), strict=True))


def windows_removed(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    counts = Counter(b" ".join(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_repeats_equal_brute_force(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for window in (35, 12):
        want = Counter((i, n, g, hashlib.sha256(k).hexdigest()) for (i, *_), (n, g, k) in zip(ROWS, windows_removed(ROWS, window), strict=True))
        assert Counter(map(tuple, substrings.repeat_digests(frame, window).collect())) == want
    kept = substrings.remove_repeats(frame)
    assert kept.columns == ["doc_id", "text", "k1", "component_id", "n_words", "n_removed", "kept"]
    assert Counter((r.doc_id, r.k1, r.kept) for r in kept.collect()) == Counter((i, "k", k.decode()) for (i, *_), (_, _, k) in zip(ROWS, windows_removed(ROWS, 35), strict=True))


def test_long_prefixes_of_heavy_groups(spark, monkeypatch):
    for heavy in (1, 3):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        check_heavy(spark)


def check_heavy(spark):
    want = Counter((i, n, g) for (i, *_), (n, g, _) in zip(ROWS, windows_removed(ROWS, 35), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.repeat_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == substrings.repeat_digests(empty).count() == 0


def test_spans_of_repeated_rows_are_kept_once(spark):
    """Otherwise their list would grow with the number of copies, and so the result with its square."""
    text = " ".join(f"w{i * i % 4001}" for i in range(400))
    rows = spark.createDataFrame([(1, text)] * 3000 + [(2, "other words")], "doc_id long, text string").repartition(4)
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    found = substrings.repeats(keyed).collect()
    assert len(found) == 1 and len(found[0].found) == len(set(found[0].found)) <= 366
    digests = substrings.repeat_digests(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, digests)) == [(1, 400, 400, 3000), (2, 2, 0, 1)]
