"""Chat formatting, media columns and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from helixframe.llm import chat, media
from helixframe.llm.queries import ORACLE_SQL, QUERIES, table

DATA = "/root/testdata/sf0.001"


def talks():
    full = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None), ("assistant", "bye")]
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3), (6, 1)):
        rows += [(conv, t, r, x, "extra") for t, (r, x) in enumerate(full[:n])]
    rows += [(5, 0, "user", "hi", ""), (5, 1, "assistant", "other", ""), (7, 0, None, "", ""), (8, None, "user", "b", ""), (8, None, "user", "a", ""), (8, 3, "user", "a", ""), (8, 3, "user", "a", "")]
    rows += [(None, 0, "user", "lost", ""), (None, 4, "user", "lost", ""), (None, 0, "user", "hi", ""), (9, 0, "user", "lone", ""), (None, 0, "user", "lone", "")]
    rows += [(20, 0, "<|im_x", "hello", ""), (21, 0, "<|_im_x", "hello", ""), (22, 0, "<||im_x", "hello", ""), (23, 0, "a\nb", "c", ""), (24, 0, "a", "b\nc", ""), (25, 0, "a\\nb", "c", ""), (26, 0, "", "x", ""), (27, 0, None, "x", ""), (28, 0, "1:a+b", None, ""), (29, 0, "1:a", "b", "")]
    return rows


def test_snapshots_collapse_as_in_sql(spark):
    frame = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string, n long".replace("n long", "n string"))
    got = chat.format_chats(frame)
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    want = con.execute(chat.FORMAT_SQL).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(tuple(None if x != x else x for x in r) for r in want)
    found = {r.conv_id: r for r in got.collect()}
    assert set(found) == {2, 5, 7, 8, 9, *range(20, 30), None} and found[2].n_copies == 2 and "<||im_end|>" in found[2].rendered
    # rows without a conv_id are conversations of their own: one is a prefix of others, one equals a named one
    assert [(r.n_turns, r.n_copies, "lost" in r.rendered) for r in got.collect() if r.conv_id is None] == [(1, 2, True)] and found[9].n_copies == 2
    # other conversations stay other ones, and so do their texts (but for null and empty, which render alike)
    assert len({found[k].rendered for k in range(20, 30)}) == 9
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_query_equals_its_sql_and_is_native(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = QUERIES["op1_chat_format"](spark, DATA)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(ORACLE_SQL["op1_chat_format"]).fetchall())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", [b"", b"x", b"a" * 191, b"b" * 192, b"c" * 193, bytes(range(256)) * 40, b"\xff\xfb\x90\x64" * 500])
def test_stored_bytes_come_back(text):
    payload = media.padded(text)
    stream = media.write(payload)
    found = media.parse(stream)
    assert len(payload) % 192 == 0 and media.read(stream, found) == payload
    assert (found["failed"], found["resyncs"], found["skipped"], found["tags"]) == (0, 0, 0, ["ID3v2"])
    assert found["table"]["frames"] == len(found["frames"]) and found["samples"] == 1152 * len(found["frames"])
    assert found["table"]["bytes"] == len(stream) - (10 + stream[8] * 128 + stream[9])


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 5])
def test_letters_of_end_tags_in_a_text_are_no_tags(blocks):
    for size in (media.BLOCK, media.LARGE):
        for sign in (b"TAG", b"APETAGEX" + b"\xff" * 24, b"APETAGEX" + b"\x00" * 24):
            for at in {87, 183, *range(max(0, size - 170), size - 2, 3)}:
                text = bytearray(b"x" * (media.BLOCK * blocks))
                start = min(max(0, len(text) - size) + at, len(text))
                text[start : start + len(sign)] = sign[: len(text) - start]
                stream = media.write(bytes(text))
                found = media.parse(stream)
                assert media.read(stream, found) == bytes(text)
                assert (found["failed"], found["skipped"], found["tags"], found["table"]["frames"]) == (0, 0, ["ID3v2"], len(found["frames"]))


def test_damaged_streams_are_resynchronised():
    payload = media.padded(b"some words " * 900)
    stream = bytearray(media.write(payload))
    whole = media.parse(bytes(stream))
    third = whole["frames"][2][0]
    stream[third] = 0  # a lost header
    stream[whole["frames"][4][0] + 7] ^= 1  # a broken side information
    damaged = media.parse(b"rubbish\xff\xff" + bytes(stream[10 + 21 :]) + b"TAG" + b"Title".ljust(125, b"\x00"))
    assert len(damaged["frames"]) == len(whole["frames"]) - 1 and damaged["failed"] == 1 and damaged["resyncs"] == 2
    assert damaged["tags"] == ["ID3v1"] and damaged["names"] == {"title": "Title"}
    assert media.parse(b"")["frames"] == media.parse(b"no audio at all")["frames"] == []


def test_headers_of_other_kinds():
    assert media.header(bytes([0xFF, 0xFD, 0x84, 0x00]))[:6] == (384, 1152, 48000, 128, 1, 2)
    assert media.header(bytes([0xFF, 0xF3, 0x80, 0xC0]))[:6] == (208, 576, 22050, 64, 2, 3)
    assert media.header(bytes([0xFF, 0xFF, 0x44, 0x00]))[:6] == (128, 384, 48000, 128, 1, 1)
    assert media.header(bytes([0xFF, 0xFB, 0xF0, 0])) is media.header(bytes([0xFF, 0xEB, 0x90, 0])) is media.header(b"\xfe\xfb\x90\x00") is None


def _frame_of(head, length, body=b""):
    return (head + body).ljust(length, b"\x00")


def test_durations_of_several_rates_are_exact():
    from fractions import Fraction

    at48, at24 = bytes([0xFF, 0xFB, 0x94, 0xC0]), bytes([0xFF, 0xF3, 0x84, 0xC0])
    assert media.header(at48)[:3] == (384, 1152, 48000) and media.header(at24)[:3] == (192, 576, 24000)
    found = media.parse(_frame_of(at48, 384) * 5 + _frame_of(at24, 192))
    assert len(found["frames"]) == 6 and found["resyncs"] == found["skipped"] == 0
    assert Fraction(found["samples"], found["rate"]) == Fraction(144, 1000)
    # a header of another rate inside a stream must lead to a header
    found = media.parse(_frame_of(at48, 384) * 2 + at24 + bytes(50) + _frame_of(at48, 384) * 2)
    assert len(found["frames"]) == 4 and found["samples"] == 4 * 1152 and found["skipped"] == 54 and found["resyncs"] == 1


def _checksum(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = crc << 1 & 0xFFFF
        crc ^= 0x8005 if top else 0
    return crc


def test_checksums_of_all_layers_are_verified():
    rng = random.Random(5)
    assert media.crc16(b"\x12\x34") == _checksum(f"{0x1234:016b}")
    spread = [4] * 11 + [3] * 12 + [2] * 4
    cases = [  # header, length, allocation entries as (bits, channels that share them), scale factor selections
        (bytes([0xFF, 0xFC, 0x84, 0x00]), 384, [4] * 11 * 2 + [3] * 12 * 2 + [2] * 4 * 2, 1),  # layer II, 128 kbit/s stereo: table a
        (bytes([0xFF, 0xFC, 0x84, 0xC0]), 384, spread, 1),  # mono
        (bytes([0xFF, 0xFC, 0x44, 0x00]), 192, [4] * 2 * 2 + [3] * 6 * 2, 1),  # 64 kbit/s stereo: table c
        (bytes([0xFF, 0xF4, 0x84, 0xC0]), 384, [4] * 4 + [3] * 7 + [2] * 19, 1),  # low rates
        (bytes([0xFF, 0xFE, 0x44, 0x00]), 128, [4] * 64, 0),  # layer I stereo
        (bytes([0xFF, 0xFE, 0x44, 0xC0]), 128, [4] * 32, 0),
    ]
    for head, length, widths, factor in cases:
        assert media.header(head)[0] == length and media.header(head)[7]
        stream, spoilt = b"", b""
        for _ in range(4):
            values = [rng.randrange(1 << w) for w in widths]
            bits = "".join(f"{v:0{w}b}" for v, w in zip(values, widths, strict=True))
            bits += "".join(f"{rng.randrange(4):02b}" for v in values if v) * factor
            crc = _checksum(f"{int.from_bytes(head[2:], 'big'):016b}" + bits)
            body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
            stream += _frame_of(head, length, crc.to_bytes(2, "big") + body)
            spoilt += _frame_of(head, length, (crc ^ 1).to_bytes(2, "big") + body)
        found = media.parse(stream)
        assert (len(found["frames"]), found["checked"], found["failed"]) == (4, 4, 0)
        assert media.parse(spoilt)["failed"] == 4
    # joint stereo: subbands from 4 on have one allocation and two selections
    head = bytes([0xFF, 0xFC, 0x84, 0x40])
    values = [1] * 8 + [1] * 23
    widths = [4] * 8 + [4] * 7 + [3] * 12 + [2] * 4
    bits = "".join(f"{v:0{w}b}" for v, w in zip(values, widths, strict=True)) + "10" * (8 + 23 * 2)
    crc = _checksum(f"{int.from_bytes(head[2:], 'big'):016b}" + bits)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    found = media.parse(_frame_of(head, 384, crc.to_bytes(2, "big") + body) * 3)
    assert (found["checked"], found["failed"]) == (3, 0)


def test_free_format_frames_are_as_long_as_the_way_to_the_next():
    head, more = bytes([0xFF, 0xFB, 0x04, 0xC0]), bytes([0xFF, 0xFB, 0x06, 0xC0])
    found = media.parse(b"".join(_frame_of(h, 500 + (h is more), b"\xff\xfb" + bytes(9)) for h in (head, more, head, head, more, head)))
    assert [f[:2] for f in found["frames"]] == [(0, 500), (500, 501), (1001, 500), (1501, 500), (2001, 501), (2502, 500)]
    assert found["kbits"] == {0: 6} and found["skipped"] == found["resyncs"] == 0 and found["samples"] == 6 * 1152
    assert media.parse(head + bytes(600))["frames"] == []


def test_media_query_and_index(spark):
    rows = [(1, "text", "a"), (2, None, "a"), (None, "text", "a"), (3, "é" * 1000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, audio string")
    found = {(r.doc_id, r.n_bytes): r for r in media.digests(media.store(docs)).collect()}
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = found[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert found[1, 4][4:] == found[None, 4][4:]
    seen = media.index(media.store(docs).selectExpr("*", "'x' AS audio").union(spark.sql("SELECT 9L, 0L, CAST(NULL AS BINARY), 'y'")))
    assert {r.audio for r in seen.collect()} == {"x", "y"}
    by_id = {r.doc_id: r.audio_2 for r in seen.collect()}
    assert by_id[9] is None and by_id[3].frames == len(by_id[3].seek) and by_id[3].rate == 48000 and by_id[3].names["TSSE"] == "helixframe"


def test_pipeline_keeps_one_of_each_group_and_packs_the_rest(spark):
    docs = table(spark, DATA, "documents")
    poison = spark.createDataFrame([(10**6, "what an idiot. such a moron and a pathetic loser", "en", "s", 47)], docs.schema)
    one = docs.filter("doc_id = 1").selectExpr("doc_id + 2000000 AS doc_id", "text", "lang", "source", "n_chars")
    given, seen = docs.unionByName(poison).unionByName(one), {}
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, DATA)
        if name != "packing":
            assert given.columns == docs.columns
        seen[name] = given.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert [r for r in seen["toxicity"] if r.doc_id == 1] == [r for r in docs.filter("doc_id = 1").collect()]
    assert 10**6 not in ids["toxicity"] and 2_000_001 in ids["quality rules"]
    assert 2_000_001 not in ids["SimHash near-dedup"] and 1 in ids["SimHash near-dedup"] and ids["substring dedup"] == ids["SimHash near-dedup"] == ids["packing"]
    assert len(ids["quality rules"]) > 0.7 * docs.count()


def test_stages_keep_clashing_columns_and_rows_with_repeated_ids(spark):
    docs = table(spark, DATA, "documents").limit(60)
    names = ("score", "predicted", "kept", "probability", "n_words", "n_removed", "row", "fp", "component_id", "a.b")
    wide = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"cast(doc_id AS string) AS `{n}`" for n in names])
    given = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, DATA)
        assert given.columns == wide.columns, name
    rows = given.collect()
    assert rows and all(r[n] == str(r.doc_id) for r in rows for n in names)


def test_near_duplicates_go_by_rows(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(5, "one text about hills and rivers", "a"), (5, "quite another text of some other things", "b"), (9, "a third one with nothing in common at all", "c")]
    rows += [(7, long, "d"), (7, long, "d"), (3, long, "e"), (None, long, "f"), (None, "no id and no partner here today", "g"), (None, None, "h"), (2, "", "i"), (None, "no id and no partner here today", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(r[2] for r in kept.collect()) == ["a", "b", "c", "e", "g", "i"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text", "`x.y`")
    assert corpus_pipeline.drop_repeated_passages(spark, named, DATA).count() == len(rows)


@pytest.mark.parametrize("sign", [b"TAG", b"APETAGEX", b"ID3\x04", b"\xff\xfb\x90\x64", b"Xing", b"VBRI"])
def test_every_offset_of_a_sign_in_the_payload_comes_back(sign):
    for blocks in (1, 2, 4, 5):
        for at in range(media.BLOCK):
            text = bytearray(b"y" * (media.BLOCK * blocks))
            start = media.BLOCK * (blocks - 1) + at
            text[start : start + len(sign)] = sign[: len(text) - start]
            stream = media.write(bytes(text))
            assert media.read(stream, media.parse(stream)) == bytes(text)
