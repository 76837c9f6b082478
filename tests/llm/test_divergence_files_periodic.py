"""Source divergences, token files and periodic runs against plain programs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.durable import new_folder
from helixframe.llm import divergence, periodic, token_files
from helixframe.llm.queries import vocabulary

BYTE = "byte_bpe_50k.json"
RNG = random.Random(4)
SCHEMA = "doc_id long, text string, lang string, source string, key string, term string, value string, n string, `runs` string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", "t", "v", "n", "r") for r in rows], SCHEMA).repartition(parts)


# Divergences


def words(k, n):
    return " ".join(RNG.choices([f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}é" for i in range(k)], [1 / (i + 1) for i in range(k)], k=n))


def audit(rows, documents, ranks):
    pattern, fold = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", pattern.findall((text or "").translate(fold))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, whole, of = Counter(), Counter(), {}
        for g, s, terms in docs:
            if g == lang:
                df.update(set(terms))
                whole.update(terms)
                of.setdefault(s, Counter()).update(terms)
        kept = [t for t, n in df.items() if n >= documents]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            told = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in of if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]}
            for part, items in told.items():
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered) if part == "pair" or k < ranks]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"terms": 3, "tile": 2}])
def test_divergences_equal_a_plain_audit(spark, sizes):
    rows = [(i, words(30, RNG.randrange(40)), RNG.choice(["en", "fr", None, ""]), RNG.choice(["a", "b", "é", "z", None])) for i in range(160)]
    rows += [rows[3]] * 5 + [(None, None, "en", "none"), (1, "", "xx", "one"), (2, "rare words", "xx", "two"), (3, "A_b[C]`d\x00e 1f", "en", "a"), (4, "WaxÉ " * 9000, "en", "a")]
    rows += [(9, "same same", "yy", s) for s in "ab"] * 4  # ties
    got = divergence.divergences(table(spark, rows), documents=4, ranks=7, **sizes)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == audit(rows, 4, 7)
    assert divergence.divergences(table(spark, [], 1)).collect() == []


def test_divergences_equal_their_sql(spark):
    con, path = duckdb.connect(), "/root/testdata/sf0.001/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(divergence.DIVERGENCES_SQL).fetchall()
    assert sorted(map(tuple, divergence.divergences(spark.read.parquet(path)).collect())) == sorted(want)


def test_equal_subtrees_are_one_node_and_large_counts_are_exact():
    counts = np.array([[1, 0, 0, 0, 2, 0, 0, 0], [0, 0, 0, 0, 2, 0, 0, 0]])
    levels = divergence.consed(counts)
    assert [len(nodes) for nodes, _ in levels] == [3, 3, 3, 2] and levels[2][1][0, 1] == levels[2][1][1, 1]
    rng = np.random.default_rng(1)
    for columns in (1, 2, 5, 8, 13):
        counts = rng.integers(0, 3, (6, columns)) * rng.choice([1, 1 << 40])
        total = counts.sum(axis=1) + 5 * columns
        p = [[1 + 10**9 * (int(c) + 5) // int(d) for c in row] for row, d in zip(counts, total, strict=True)]
        left, right = np.array([0, 2, 4, 0]), np.array([1, 3, 5, 5])
        want = [sum(abs(a - b) for a, b in zip(p[i], p[j], strict=True)) for i, j in zip(left, right, strict=True)]
        assert divergence.prices(divergence.consed(counts), total, left, right).tolist() == want


# Token files


def test_token_files_hold_the_ids_of_the_library(spark):
    library = Tokenizer.from_file(vocabulary(BYTE))
    rows = [(i, t, "x", "y") for i, t in enumerate(["", "a", "two words", "<|endoftext|> x", "日本語 é", words(50, 3000)] + [words(20, RNG.randrange(60)) for _ in range(80)])]
    rows += [(-7, None, None, None), (None, "no id", "x", "y"), (None, None, "x", "y"), rows[2], rows[2], (2, "same id", "x", "y"), (500, words(90, 150_000), "x", "y")]
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    path = new_folder(spark, "tokens")
    token_files.write(table(spark, rows), vocabulary(BYTE), path)
    read = token_files.read(spark, path).collect()
    got = sorted(((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read), key=lambda r: (r[0], r[0] + r[2]))
    assert sorted(((r[1] is not None, r[1] or 0), r[3]) for r in got) == sorted(((i is not None, i or 0), ids(t)) for i, t, *_ in rows)
    assert [r[1] is not None for r in got[:2]] == [False, False] and [r[1] for r in got[2:]] == sorted(r[1] for r in got[2:])
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist() and all(r[2] == len(r[3]) for r in got)
    told = token_files.manifest(path)
    flat = [x for r in got for x in r[3]]
    assert told["tokens"] == len(flat) and len(told["files"]) > 1
    for start, length in ((0, 1), (5, 400), (len(flat) // 2, 99_999), (len(flat) - 2, 50), (0, len(flat)), (len(flat), 3)):
        assert token_files.window(path, start, length).tolist() == flat[start : start + length]
    # frequent ids have short codes: ranks fall with counts
    order = np.frombuffer(open(f"{token_files.place_of(path)[1]}/ranks.u32", "rb").read(), "<u4").tolist()
    counts = Counter(flat)
    assert order == sorted(counts, key=lambda x: (-counts[x], x))


def test_files_that_the_manifest_does_not_name_are_not_read_and_damage_is_found(spark):
    path = new_folder(spark, "tokens")
    token_files.write(table(spark, [(i, words(20, 50), "x", "y") for i in range(20)], 1), vocabulary(BYTE), path)
    before, root = token_files.read(spark, path).collect(), token_files.place_of(path)[1]
    name = token_files.manifest(path)["files"][0]["name"]
    data = bytearray(open(f"{root}/{name}", "rb").read())
    open(f"{root}/part-000000-lost.tok", "wb").write(data[: len(data) // 2])  # an attempt that was lost
    assert token_files.read(spark, path).collect() == before
    data[200] ^= 1
    open(f"{root}/{name}", "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        token_files.window(path, 0, 10)


def test_token_digests_of_ids_of_any_type_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "z", 2), (None, None, 3)], "doc_id string, text string, start int")
    got = sorted(map(tuple, token_files.digests(docs, vocabulary(BYTE)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, "a", "b"] and got[0][1:] == (0, 1, zlib.crc32(b"\x02\0\0\0"))
    assert token_files.digests(docs.limit(0), vocabulary(BYTE)).collect() == []


def test_codes_of_every_length_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 1001):
        x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.compress(x)
        assert len(control) == -(-n // 4) and (token_files.decompress(control, data, n) == x).all()


# Periodic runs


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    for _ in range(500):
        n, k = RNG.randrange(110), RNG.choice([1, 2, 2, 3, 6, 40])
        w = [b"%d" % RNG.randrange(k) for _ in range(n)]
        if n and RNG.random() < 0.5:
            a = RNG.randrange(n)
            p = 1 + (n - a) // (3 + RNG.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w
    yield [b"a"] * 300
    yield ([b"a"] * 16 + [b"b"]) * 9
    yield ([b"a", b"b"] * 8 + [b"c"]) * 5 + [b"a", b"b"] * 3


def test_runs_equal_a_plain_search():
    every = list(sequences())
    for first in range(0, len(every), 50):
        part = every[first : first + 50]
        for w, found in zip(part, periodic.runs_of(part), strict=True):
            assert [tuple(r) for r in found.tolist()] == plain_runs(w), w


def test_convolution_is_exact_for_large_numbers():
    rng = np.random.default_rng(2)
    for size in (1, 2, 8, 64):
        blocks = rng.integers(0, 1 << 25, (size, 5))
        windows = rng.integers(0, 1 << 25, (2 * size, 5))
        windows[size // 2 : size // 2 + size, 0] = blocks[:, 0]
        windows[size - 1 : 2 * size - 1, 1] = blocks[:, 1]
        windows[0, 2] = blocks[0, 2] + 2013265921  # a multiple of one prime apart is no match
        want = np.stack([(windows[s : s + size] == blocks).all(axis=0) for s in range(size)])
        assert (periodic.mismatches_vanish(blocks, windows) == want).all() and want[size // 2, 0] and want[size - 1, 1]


def test_a_long_periodic_text_is_searched_whole():
    w = [b"%d" % (i * i % 30011) for i in range(30011)] * 5
    assert periodic.runs_of([w])[0].tolist() == [[0, 5 * 30011, 30011]]


def expected(i, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = best and 1000 * best[1] // best[2]
    return (i, len(runs), *(best or (None,) * 3), milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_digests_equal_a_plain_program(spark):
    texts = [None, "", " ", "a", "b b b b b", "b b b b b b", "x y " * 9, "one\ttwo\x0bone\ntwo one  two one two ", "é " * 700, "\x1c \x1c " * 8, *(b" ".join(w).decode() for w in list(sequences())[:200])]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "b " * 7, "x", "y"), (None, None, "x", "y"), rows[8], rows[8]]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5
    got = [tuple(r) for r in periodic.digests(periodic.looped(table(spark, rows))).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t, *_ in rows), key=key)
    assert periodic.digests(periodic.looped(table(spark, [], 1))).collect() == []
    assert periodic.periodic_runs(table(spark, rows)).columns == ["doc_id", "n_words", "runs", "collapsed"]
