"""One text of some megabytes among short ones, for every operator on texts; and texts alone as in company."""

import random

import pytest
from tokenizers import Tokenizer

from helixframe.llm import chunked_bpe, langid, media, packing, quality, simhash, substrings, token_counts, toxicity
from helixframe.llm.common import slices
from helixframe.llm.queries import table, vocabulary

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randrange(2, 9))) for _ in range(4000)]
LONG = "\n".join(" ".join(RNG.choice(WORDS) for _ in range(40)) for _ in range(12_000))
SHORT = ["one short text", "", LONG[:900]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate([*SHORT, LONG, LONG[500:3000]])], "doc_id long, text string").coalesce(1)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_a_very_long_text_is_read_whole(docs):
    n = len(LONG.split())
    assert len(LONG) > 2_500_000 and n == 480_000
    assert by_id(quality.quality(docs, quality.fit([])))[3].n_words == n
    assert by_id(toxicity.toxicity(docs, toxicity.fit([("what an idiot he is", 1), ("a good day to all", 0)] * 5)))[3].predicted in (0, 1)
    found = by_id(langid.languages(docs, langid.fit([(LONG[:5000], "xx"), ("ganz andere worte hier", "de")])))
    assert found[3].lang_pred == "xx" and found[3].score > 0.9
    cut = by_id(substrings.repeat_digests(docs))
    shared = len(LONG[:3000].split())
    assert cut[3].n_words == n and shared - 4 <= cut[3].n_removed <= shared
    prints = by_id(simhash.fingerprints(docs))
    assert prints[3].fp & (1 << 64) - 1 == simhash.fingerprint(LONG.encode())
    assert by_id(media.digests(media.store(docs)))[3].payload_bytes == -(-len(LONG) // 192) * 192


def test_a_very_long_text_has_the_librarys_tokens(docs):
    want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids
    assert sum(r.n_tokens for r in token_counts.section_tokens(docs.filter("doc_id = 3"), vocabulary("byte_bpe_50k.json")).collect()) == len(want)
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json")).filter("doc_id = 3").collect()
    assert sum(r.length for r in rows) == len(want) + 1 == rows[0].doc_tokens
    found = by_id(chunked_bpe.encode(docs, vocabulary("word_bpe_49k.json")))[3]
    assert found.ids == Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(LONG, add_special_tokens=False).ids


def test_slices_are_cut_by_bytes_and_hold_every_row():
    import pyarrow as pa

    texts = ["x" * 10, None, "y" * 100, "", "z", "w" * 300, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["text", "n"])
    parts = list(slices(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), size=64))
    assert [b.column("n").to_pylist() for b, _ in parts] == [[0, 1, 2], [3, 4, 5], [6], [2], [3, 4]]
    assert [t for _, part in parts[:3] for t in part] == [(t or "").encode() for t in texts]


def test_languages_of_texts_alone_and_in_company(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    together = by_id(langid.languages(docs, model))
    for r in docs.filter("length(text) < 1500").limit(25).collect():
        starts, ends, labels, letters, _, _ = langid.labelled_words([r.text.encode()], model)
        held = {}
        for label, n in zip(labels.tolist(), letters.tolist(), strict=True):
            held[label] = held.get(label, 0) + n
        best = max(sorted(held), key=lambda k: held[k])
        assert together[r.doc_id].lang_pred == model.languages[best] and together[r.doc_id].score == pytest.approx(held[best] / sum(held.values()))
