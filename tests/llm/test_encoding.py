"""Token counts, packing and chunked BPE against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import chunked_bpe, packing, token_counts
from helixframe.llm.encoders import WORD_END, byte_encoder, word_end_encoder
from helixframe.llm.queries import vocabulary

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
RNG = random.Random(9)
SHARED = " ".join("".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(1, 9))) for _ in range(600))
TEXTS = [
    None, "", " ", "\n\n", "a", "two  spaces \n and\t tabs ", " lead", "trail \n", "ünïcödé 漢字 é é ́x", "x <|endoftext|> y", "<|startoftext|>", "it's 12,345 don't!!", "a b   c", "\x1c \x1d a\x85b", "\x01 b \x01",
    SHARED, "before " + SHARED, SHARED[:900] + " other " + SHARED[900:], SHARED, "w" * 5000, "ab " * 3000, "日本語" * 400,
    "don't I'LL we've 'S x'sy " * 90, "e\u0301 \u0301a \u212b ﬁ İstanbul ΣΑΣ ǆ " * 60, "\u180e\u200b\u2028 \ud7ff \ufeff \u20bd 😀🧿 \U0001f9ff ᲀ Ა " * 40, "1234 5.6% $7 " * 100, "<|endoftext" * 50, "\x7f\x00 \x1f" * 80,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[15]], "doc_id long, text string, ids string, sequence_id string").repartition(3)


def ids_of(name, text):
    return Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def test_byte_encoder_equals_the_library():
    for t in TEXTS:
        assert byte_encoder(vocabulary(BYTE)).encode(t or "").tolist() == ids_of(BYTE, t), t


def test_chunked_ids_and_decoding_equal_the_library(docs):
    library = Tokenizer.from_file(vocabulary(WORD))
    rows = {r.doc_id: r for r in chunked_bpe.digests(docs, vocabulary(WORD)).collect()}
    whole = {r.doc_id: r for r in chunked_bpe.encode(docs, vocabulary(WORD)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids, key = ids_of(WORD, t), None if i == 3 else i
        text = library.decode(ids, skip_special_tokens=False)
        assert whole[key].ids == ids and whole[key].decoded == text
        assert (rows[key].n_tokens, rows[key].ids_sha256, rows[key].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_every_name_is_what_its_letters_merge_to():
    """So merging by the ranks of names equals merging by the list of pairs."""
    import json

    spec = json.loads(open(vocabulary(WORD)).read())["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
    rank = {p: n for n, p in enumerate(pairs)}
    assert len({a + b for a, b in pairs}) == len(pairs) and [spec["vocab"][a + b] for a, b in pairs] == sorted(spec["vocab"][a + b] for a, b in pairs)
    for n, (a, b) in enumerate(pairs):
        letters = list((a + b).removesuffix(WORD_END))
        if (a + b).endswith(WORD_END):
            letters[-1] += WORD_END
        while True:
            best, at = min(((rank.get(p, n), k) for k, p in enumerate(zip(letters, letters[1:], strict=False))), default=(n, 0))
            if best >= n:
                break
            letters[at : at + 2] = [letters[at] + letters[at + 1]]
        assert letters == [a, b]


def test_chunks_of_a_shared_passage_are_reused_and_joins_agree(monkeypatch):
    table = chunked_bpe.ChunkTable(word_end_encoder(vocabulary(WORD)))
    table.encode_many([SHARED.encode()])
    before = table.reused
    table.encode_many([b"something else first " + SHARED.encode()])
    assert table.reused - before >= SHARED.count(" ") // 600
    # every place of a cut in a text, with ids of the chunks alone: what disagrees is encoded again over a longer stretch
    rng, text = random.Random(5), "we've  Été e\u0301 12,5 isn't it's ok? ... yes!! x y z a b c d e f g h i j k l m n " * 3
    want, grown = ids_of(WORD, text), 0
    for _ in range(200):
        cuts = sorted(rng.sample([k for k in range(1, len(text.encode())) if text.encode()[k] & 0xC0 != 0x80], 3))
        monkeypatch.setattr(chunked_bpe, "chunk_ends", lambda data, cuts=cuts: np.array(cuts))
        table = chunked_bpe.ChunkTable(word_end_encoder(vocabulary(WORD)))
        assert table.encode_many([text.encode()])[0].tolist() == want
        # where a chunk's ids next to a cut are others than those of the stretch, the stretch grows
        table.cuts = {k: (v[0], v[1][::-1] + 1, *v[2:]) if v else v for k, v in table.cuts.items()}
        assert table.encode_many([text.encode()])[0].tolist() == want
        grown += table.grown
    assert grown > 0


def test_sections_partition_text_and_tokens(docs):
    rows = defaultdict(list)
    for r in token_counts.section_tokens(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), vocabulary(BYTE)).collect():
        rows[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        parts, text = sorted(rows[i], key=lambda r: r.section_no), t or ""
        assert "".join(text[r.start_char : r.end_char] for r in parts) == text
        assert all("\n" not in text[r.start_char : r.end_char - 1] for r in parts)
        assert sum(r.n_tokens for r in parts) == len(ids_of(BYTE, text))


def test_tokens_of_a_section_equal_those_of_the_library_by_characters(docs):
    """The rule anew, from the library's own spans: bytes of each token in each line, the most wins, the earlier on a tie."""
    library = Tokenizer.from_file(vocabulary(BYTE))
    found = defaultdict(list)
    for r in token_counts.section_tokens(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), vocabulary(BYTE)).collect():
        found[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        text = t or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        edges = np.cumsum([0, *(len(x.encode()) for x in lines)])
        counts, at = [0] * len(lines), 0
        for token in library.encode(text, add_special_tokens=False).ids:
            name = library.id_to_token(token)
            size = len(name.encode()) if name in byte_encoder(vocabulary(BYTE)).special else len(name)  # one symbol a byte
            held = [max(0, min(at + size, b) - max(at, a)) for a, b in zip(edges, edges[1:], strict=False)]
            counts[held.index(max(held))] += 1
            at += size
        assert [r.n_tokens for r in sorted(found[i], key=lambda r: r.section_no)] == counts


def test_crossing_tokens_go_to_the_larger_part_or_the_earlier():
    ends = np.array([2, 6, 8])
    assert token_counts.owners(ends, np.array([0, 3])).tolist() == [0, 1, 1]
    assert token_counts.owners(ends, np.array([0, 4])).tolist() == [0, 0, 1]
    assert token_counts.owners(np.array([9]), np.array([0, 2, 4, 8])).tolist() == [2]


def test_fields_are_sections(spark):
    frame = spark.createDataFrame([(1, "a title", "one\ntwo"), (2, None, None)], "doc_id long, title string, body string")
    rows = token_counts.section_tokens(frame, vocabulary(BYTE), ("title", "body"), by_line=False).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.field, r.start_char, r.end_char) for r in rows] == [(1, "title", 0, 8), (1, "body", 8, 15), (2, "title", 0, 1), (2, "body", 1, 1)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == len(ids_of(BYTE, "a title\none\ntwo"))


def test_fill_is_the_closest_sum():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        got, rest = packing.fill(counts, 50), sorted(lengths)[:-1]
        sums = {sum(rest[i] for i in range(len(rest)) if m >> i & 1) for m in range(1 << len(rest))}
        assert sum(k * n for k, n in got.items()) == max(lengths) + max(s for s in sums if s <= 50 - max(lengths))
        assert all(n <= counts[k] for k, n in got.items())


def test_packing_places_every_id_once(docs):
    rows = packing.pack(docs, vocabulary(BYTE), window=64).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, t in enumerate(TEXTS):
        ids = ids_of(BYTE, t) + [0]
        parts = sorted(by_document[None if i == 3 else i], key=lambda r: r.start)
        copies = 2 if i == 15 else 1
        assert sum(r.length for r in parts) == copies * len(ids)
        for r in parts:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    used = sum(r.length for r in rows)
    assert len(by_sequence) * 64 - used < 0.1 * used


def test_a_very_frequent_length_over_many_tasks(spark):
    frame = spark.range(0, 3000, 1, 40).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('a b ', 40) ELSE 'x' END AS text")
    rows = packing.pack(frame, vocabulary(BYTE), window=16).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 16
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, vocabulary(BYTE)).count() == 0
    assert chunked_bpe.digests(empty, vocabulary(WORD)).count() == token_counts.section_tokens(empty, vocabulary(BYTE)).count() == 0
