"""Quality rules, toxicity and language identification: exact parts by brute force, models by held-out accuracy."""

import zlib
from collections import Counter

import pytest

from helixframe.llm import langid, quality, toxicity
from helixframe.llm.queries import QUERIES, table

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " \n ", "one two", "a b c a b c a b c", "x\nx\n\nx\ny\n y\ny", "# * $ % & | < >", "é é " * 60, "word " * 3000, "l i k e t h i s"]
SCHEMA = "doc_id long, text string, lang string, score string, kept string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 1 else i, t, "en", "s", "k", "r") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, DATA, "documents"), table(spark, DATA, "labels")


def base(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = [any(grams.get(tuple(words[j : j + 3]), 0) > 1 for j in range(max(0, i - 2), i + 1)) for i in range(len(words))]
    seen, dup = set(), 0
    for line in text.encode().split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, sum(marked)


def test_base_counts_equal_brute_force(odd):
    model = quality.fit([])
    rows = quality.quality(odd, model, keep=("doc_id", "kept", "score")).collect()
    assert {r.kept for r in rows} == {"k"} and {r.kept_2 for r in rows} <= {True, False}
    want = Counter((None if i == 1 else i, *base(t)) for i, t in enumerate([*ODD]))
    want[(4, *base(ODD[4]))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_scores_do_not_depend_on_neighbours():
    model = quality.fit([("good words here and there", 1), ("bad$$$ %%% ||| x", 0)] * 20)
    texts = [b"some text", b"", b"other text entirely", b"abc"]
    together = model.probabilities(texts)
    assert together.tolist() == pytest.approx([model.probabilities([t])[0] for t in texts])


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    train = labels.filter("crc32(cast(doc_id AS string)) % 3 > 0")
    scored = quality.quality(docs, quality.train(docs, train)).join(labels.filter("crc32(cast(doc_id AS string)) % 3 = 0"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in scored) >= 0.97 * len(scored) > 50


def test_toxicity_on_held_out_labels(spark, tables):
    rows = QUERIES["op4_toxicity"](spark, DATA).join(tables[1], "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_gapped_and_spaced_insults_are_found(spark):
    more = "/root/testdata/sf0.1"
    model = toxicity.train(table(spark, more, "documents"), table(spark, more, "labels"))
    memory = toxicity._Memory(model.landmarks)
    of = lambda t: model.scores([t.encode()], memory)[0]
    for insult in ("idiot", "IDIOT!!", "i-d-i-o-t", "i d i o t", "iddiot", "p.a.t.h.e.t.i.c"):
        assert of(f"the and of {insult} is here") > 0.5, insult
    for text in ("the idea of a hill", "", "the and of is here"):
        assert of(text) < 0.5


def test_kernel_equals_its_definition():
    import itertools

    def feature(word):
        out = Counter()
        for c in itertools.combinations(range(len(word)), 3):
            out[bytes(word[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    marks, words = [b"idiot", b"banana"], [b"idiot", b"idxiot", b"bandana", b"on", b"\xc3\xa9t\xc3\xa9", b"a" * 40]
    got = toxicity._Landmarks(marks).similarities(words)
    for i, w in enumerate(words[:5]):
        for j, m in enumerate(marks):
            a, b = feature(w), feature(m)
            k = dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a else 0
            assert got[i, j] == pytest.approx(k**toxicity.POWER if k >= toxicity.FLOOR else 0, abs=1e-4)


def test_odd_texts_score(odd):
    model = toxicity.fit([])
    rows = toxicity.toxicity(odd, model, ("doc_id", "score", "row")).collect()
    assert odd.count() == len(rows) and {r.score for r in rows} == {"s"} and {r.row for r in rows} == {"r"} and all(r.score_2 < 0.5 for r in rows)


def test_scores_equal_a_plain_rescoring(spark, tables):
    """Each text alone, words in a loop and the kernel by its definition, against the query's batches."""
    from itertools import combinations

    model = toxicity.train(*tables)
    feature = lambda w: {k: sum(toxicity.DECAY ** (c[-1] - c[0] + 1) for c in places) for k, places in _subsequences(w).items()}

    def _subsequences(word):
        out = {}
        for c in combinations(range(len(word)), 3):
            out.setdefault(bytes(word[i] for i in c), []).append(c)
        return out

    marks = [feature(w) for w in model.landmarks]
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5

    def kernels(word):
        if not 3 <= len(word) <= toxicity.LONGEST:
            return [0.0] * len(marks)
        f = feature(word)
        found = [sum(v * m.get(k, 0) for k, v in f.items()) / (norm(f) * norm(m)) for m in marks]
        return [x**toxicity.POWER if x >= toxicity.FLOOR else 0.0 for x in found]

    known = {}
    texts = [r for r in tables[0].filter("length(text) < 900").orderBy("doc_id").limit(25).collect()]
    got = {r.doc_id: r.score for r in toxicity.toxicity(tables[0], model).collect()}
    for r in texts:
        folded, starts, ends, sentence, _ = toxicity.sentence_words([r.text.encode()])
        best = model.bias
        for s in set(sentence.tolist()):
            top = [0.0] * len(marks)
            for a, b, n in zip(starts, ends, sentence, strict=True):
                if n == s:
                    word = folded[a:b].tobytes()
                    if word not in known:
                        known[word] = kernels(word)
                    top = [max(x, y) for x, y in zip(top, known[word], strict=True)]
            best = max(best, sum(x * w for x, w in zip(top, model.weights, strict=True)) + model.bias)
        assert got[r.doc_id] == pytest.approx(1 / (1 + 2.718281828459045 ** -(model.slope * best + model.shift)), abs=0.02)


def test_quality_verdicts_equal_a_plain_rescoring(tables):
    import numpy as np

    model = quality.train(*tables)
    for r in [*tables[0].filter("length(text) < 900").orderBy("doc_id").limit(20).collect(), *tables[0].filter("lang <> 'en' AND length(text) < 900").limit(20).collect()]:
        margin, text = model.bias, r.text
        words = text.encode().split()
        bags = [[int(x) for x in _word_buckets(words)]] + [[_gram_bucket(text[i : i + n]) for i in range(len(text) - n + 1)] for n in (3, 4)]
        for weights, bag in zip(model.weights, bags, strict=True):
            margin += float(np.sum(weights[bag])) / max(1, len(bag)) if bag else 0
        assert model.margins([text.encode()])[0] == pytest.approx(margin, abs=1e-4)


def _word_buckets(words):
    import numpy as np

    from helixframe.llm.common import span_hashes

    for w in words:
        yield int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(40)) % quality.BUCKETS


def _gram_bucket(gram):
    code = 0
    for c in gram:
        code = (code << 21) & (1 << 64) - 1 ^ code >> 43 ^ ord(c)
    return (code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & quality.BUCKETS - 1


def test_hashes_do_not_depend_on_the_place():
    import numpy as np

    from helixframe.llm.common import span_hashes

    data = np.frombuffer(b"ab cd " * 20000, np.uint8)
    starts = np.arange(0, len(data), 3)
    hashes = span_hashes(data, starts, starts + 2)
    assert len(np.unique(hashes)) == 2 and (hashes[::2] == hashes[0]).all() and hashes[0] == span_hashes(data[:2], np.array([0]), np.array([2]))[0]


def test_languages_beyond_a_byte():
    import numpy as np

    scores = np.zeros((3, 200), np.float32)
    scores[:, 150] = 5
    assert langid.viterbi(scores, np.array([0, 3]), 1.0).tolist() == [150] * 3
    names = [f"l{k:03}" for k in range(200)]
    words = {n: "".join(chr(97 + int(c)) * 2 for c in n[1:]) for n in names}
    model = langid.fit([(f"{words[n]} " * 30, n) for n in names])
    labels = langid.labelled_words([f"{words[n]} {words[n]}".encode() for n in names], model)[2]
    assert [model.languages[x] for x in labels[::2]] == names


def test_kept_columns_of_languages(odd):
    rows = langid.languages(odd.withColumnRenamed("row", "lang_pred"), langid.fit([("some words", "en")]), ("doc_id", "lang_pred", "text", "score")).collect()
    assert {r.lang_pred for r in rows} == {"r"} and {r.lang_pred_2 for r in rows} == {"en", "und"} and {r.score for r in rows} == {"s"} and len(rows) == odd.count()


def test_languages_on_held_out_documents(spark, tables):
    rows = QUERIES["op8_langid"](spark, DATA).join(tables[0].select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100


def test_odd_texts_and_mixed_spans(spark, odd, tables):
    model = langid.train(tables[0])
    found = {r.doc_id: r for r in langid.languages(odd, model).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {0, None, 2, 6} and found[0].score == 0
    texts = {r.lang: r.text for r in tables[0].filter("length(text) BETWEEN 400 AND 900").dropDuplicates(["lang"]).collect()}
    mixed = " ".join([texts["en"], texts["de"], texts["fr"]])
    parts = langid.spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("span_no").collect()
    assert [p.lang for p in parts] == ["en", "de", "fr"] and sum(p.n_words for p in parts) == len(mixed.split())
    nothing = langid.languages(odd, langid.fit([])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    lengths = [0, 5, 1, 6, 3]
    firsts = np.cumsum([0, *lengths])
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32)
    got = langid.viterbi(scores, firsts, 1.0)
    for a, b in zip(firsts, firsts[1:], strict=False):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - sum(x != y for x, y in zip(p, p[1:], strict=False))
        if b > a:
            assert value(got[a:b].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, quality.train(docs, labels)).count() == toxicity.toxicity(docs, toxicity.train(docs, labels)).count() == langid.languages(docs, langid.train(docs)).count() == 0


def test_span_hashes_do_not_depend_on_the_digits_of_places(monkeypatch):
    import numpy as np

    from helixframe.llm import common

    data = np.frombuffer(("one two three one two " * 22).encode(), np.uint8)
    starts, ends = common.word_spans(data)
    want = common.span_hashes(data, starts, ends)
    monkeypatch.setattr(common, "_DIGIT", 3)  # three digits of three bits: 512 bytes
    assert len(data) > 64 and (common.span_hashes(data, starts, ends) == want).all() and len(np.unique(want)) == 3


def test_samples_are_of_texts_that_fit(spark):
    from helixframe.llm.labelled import MAX_BYTES, labelled_texts

    long = "a long text " * (MAX_BYTES // 12 + 2)
    docs = spark.createDataFrame([(k, long, "xx") for k in range(40)] + [(k, f"short {k}", "yy") for k in range(40, 44)] + [(50, None, "yy")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(44)] + [(50, 1), (None, 1)], "doc_id long, toxic int")
    assert sorted(labelled_texts(docs, labels, "toxic", 4)) == [(f"short {k}", k % 2) for k in range(40, 44)]
    with pytest.raises(ValueError, match="more than"):
        labelled_texts(docs.filter("doc_id < 40 OR doc_id % 2 = 0"), labels, "toxic", 4)
    assert labelled_texts(docs.limit(0), labels, "toxic", 4) == []
    wide = spark.createDataFrame([(1, "\u4e2d" * MAX_BYTES)], "doc_id long, text string")
    from helixframe.llm.labelled import stretch

    assert [len(r[0].encode()) for r in wide.select(stretch()).collect()] == [3 * (MAX_BYTES // 4)]
    assert "xx" in langid.train(docs).languages  # a language of long texts only is learned
