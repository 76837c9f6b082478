"""Repeated word windows by prefix-partitioned suffix trees.

A window is `window` consecutive words; it is repeated if the same words also start anywhere else. The
trees here are sparse: suffixes start at anchors only. The anchor of a window is the leftmost of its
GRAM-word grams with the smallest hash, so equal windows have equal anchors at equal places, and
consecutive windows mostly share one. The consecutive windows of a document with one anchor are a
segment: a suffix at the anchor, and the words before it that its windows need.

1. Each segment is hashed (64 bits beside the 64 of its gram). Anchors whose gram occurs once are done: their windows are unique.
   Where all segments of a gram are equal, all their windows are repeated, and no text moves.
2. For the others one segment of each distinct content is read (with its number of copies), and the
   suffixes are split into groups by their prefix, the gram.
3. A task takes whole prefix groups, as many as fit its memory (GROUP suffixes), and builds their
   subtree level by level, every branch by one word at a time, and another one leftwards. A window
   with d words before its anchor is a pair of nodes, at depth window - d in the one and d in the other
   tree; nodes with two leaves or more are the deep internal nodes, whose windows are repeats.
4. A prefix with more than HEAVY distinct segments is lengthened, a few words at a time, until a group fits a
   task. There a window goes by its words from the anchor on, then those before the anchor from right to
   left, so that every window of such a group has one spelling and one tree takes them all. Windows that
   are still too many under their whole spelling are equal, so they are repeats without a tree.
5. The repeated windows of a segment's content are joined back to all its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.durable import cut_lineage
from helixframe.llm.common import joined, kept_columns, mix, quoted, release, results, shape, slices, span_hashes, word_spans

#: Words of an anchor's gram.
GRAM = 8
#: Suffixes in the subtrees that a task builds at once, and distinct segments beyond which a prefix is lengthened.
GROUP, HEAVY = 20_000, 20_000
#: Words by which a prefix is longer at every step after the gram (the whole window ends the steps).
STEPS = (1, 1, 2, 4, 8)


def _segments(texts: list[bytes], window: int) -> dict[str, np.ndarray]:
    """Segments of some texts: row, start (word in its text), windows, before (words before the anchor), gram, and a digest of its content."""
    data, firsts = joined(texts)
    starts, ends = word_spans(data)
    n, grams = len(starts), window - GRAM + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "start", "windows", "before", "gram", "seg")}
    if n < window:
        return none
    first_word = np.searchsorted(starts, firsts)
    row = np.repeat(np.arange(len(texts)), np.diff(first_word))
    word = span_hashes(data, starts, ends)
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram += word[k : k + len(gram)]
    gram = mix(gram)
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    held, size = key, 1
    while size < grams:  # minima of runs of `size` grams
        step = min(size, grams - size)
        held = np.minimum(held[: len(held) - step], held[step:])
        size += step
    anchor = (held & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(row[: len(anchor)] == row[window - 1 :])
    if not len(at):
        return none
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)]))
    low = at[new]
    count = np.diff(np.append(new, len(at)))
    anchor = anchor[new]
    buffer = data.tobytes()
    body = b" ".join(buffer.split())
    place = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts + 1, out=place[1:])
    a, b = place[low].tolist(), (place[low + count + window - 1] - 1).tolist()
    digest = hashlib.blake2b
    ids = np.frombuffer(b"".join([digest(body[x:y], digest_size=8).digest() for x, y in zip(a, b, strict=True)]), "<i8")
    of = row[low]
    return {"row": of, "start": low - first_word[of], "windows": count, "before": anchor - low, "gram": gram[anchor].view(np.int64), "seg": ids}


def _read_segments(window: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches):
            s = _segments(texts, window)
            of = lambda name: batch.column(name).take(pa.array(s["row"]))
            place = s["start"] << 16 | s["windows"] << 8 | s["before"]
            yield pa.RecordBatch.from_arrays([of("k1"), of("k2"), *[pa.array(x) for x in (s["gram"], s["seg"].copy(), place)]], names=["k1", "k2", "gram", "seg", "place"])

    return read


def _cut_segments(window: int):
    """The words of wanted segments (wanted: array of structs), for the prefix groups."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        before = None
        for batch, texts in slices(batches):
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            out: dict[str, list] = {k: [] for k in _KINDS}
            for key, text, segments in zip(keys, texts, batch.column("wanted").to_pylist(), strict=True):
                if key == before:  # a repeated row: its segments are known
                    continue
                before, words = key, text.split()
                for s in segments:
                    s["words"] = b" ".join(words[s["start"] : s["start"] + s["windows"] + window - 1])
                    for k, v in out.items():
                        v.append(s[k])
            yield pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for k, v in out.items()], names=list(out))

    return take


_KINDS = {"gram": pa.int64(), "seg": pa.int64(), "windows": pa.int32(), "before": pa.int32(), "copies": pa.int64(), "heavy": pa.bool_(), "words": pa.binary()}
_SCHEMA = "gram long, seg long, windows int, before int, copies long, heavy boolean, words binary"


def _levels(first: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The node of each suffix at every depth of a tree: a branch goes on by one word of `words` at a time."""
    nodes = [np.unique(first, return_inverse=True)[1]]
    size = int(words.max(initial=0)) + 2
    for k in range(words.shape[1]):
        nodes.append(np.unique(nodes[-1] * size + words[:, k] + 1, return_inverse=True)[1])
    return nodes


def repeated_masks(gram: np.ndarray, bodies: list[bytes], windows: np.ndarray, before: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """For each distinct segment of whole prefix groups the windows (bits, the first lowest) that another start shares."""
    names: dict[bytes, int] = {}
    n, left, right = len(bodies), int(before.max(initial=0)), window
    ahead, behind = np.full((n, right), -1, np.int64), np.full((n, left), -1, np.int64)
    for k, body in enumerate(bodies):
        ids = [names.setdefault(w, len(names)) for w in body.split(b" ")]
        b = int(before[k])
        part = ids[b : b + right]
        ahead[k, : len(part)] = part
        behind[k, :b] = ids[:b][::-1]
    forward, backward = _levels(gram, ahead), _levels(gram, behind)
    mask = np.zeros(n, np.int64)
    for d in range(left + 1):
        at = np.flatnonzero((before >= d) & (before - d < windows))
        if len(at):
            leaf = np.unique(forward[window - d][at] * n + backward[d][at], return_inverse=True)[1]
            shared = np.bincount(leaf, weights=copies[at])[leaf] >= 2
            mask[at[shared]] |= np.int64(1) << (before[at[shared]] - d)
    return mask


def repeated_spellings(group: np.ndarray, spellings: list[bytes], copies: np.ndarray, size: int) -> np.ndarray:
    """Of windows in whole groups, each with the `size` words of its spelling behind the group's, those that stand twice or more: the leaves of one tree."""
    names: dict[bytes, int] = {}
    words = np.array([[names.setdefault(w, len(names)) for w in s.split(b" ")] for s in spellings], np.int64).reshape(len(spellings), size)
    leaf = _levels(group, words)[-1]
    return np.bincount(leaf, weights=copies)[leaf] >= 2


def _in_groups(key: str, made: list[str], tree):
    """Apply `tree` to whole groups of a partition that is sorted by `key`, as many at once as have GROUP rows."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def run(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in tree({k: t.column(k) for k in t.column_names})], names=made)

        kept, held = [], 0
        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held >= GROUP:  # whole groups go, the last one may go on
                t = pa.Table.from_batches(kept).combine_chunks()
                keys = t.column(key).to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield run(t.slice(0, last))
                    kept, held = t.slice(last).to_batches(), len(keys) - last
        if held:
            yield run(pa.Table.from_batches(kept))

    return grow


def _subtrees(window: int):
    def tree(of: dict) -> list[np.ndarray]:
        column = lambda k: of[k].to_numpy()
        mask = repeated_masks(column("gram"), of["words"].to_pylist(), column("windows").astype(np.int64), column("before").astype(np.int64), column("copies"), window)
        at = np.flatnonzero(mask)
        return [column("gram")[at], column("seg")[at], mask[at]]

    return _in_groups("gram", ["gram", "seg", "mask"], tree)


def _long_subtrees(rest: int):
    def tree(of: dict) -> list[np.ndarray]:
        column = lambda k: of[k].to_numpy()
        at = np.flatnonzero(repeated_spellings(column("p1"), of["rest"].to_pylist(), column("copies"), rest))
        return [column("gram")[at], column("seg")[at], column("bit")[at]]

    return _in_groups("p1", ["gram", "seg", "mask"], tree)


def _spelled(window: int, before: int, words: int):
    """Every window of the segments, spelled by its words from the anchor on, then those before the anchor from right to left.

    Gives the hashes of its group (gram, place in the window and first words of the spelling) at the length before and at
    this one, and the rest of the spelling: words that a whole group shares need not move.
    """

    def digest(gram: int, ahead: int, part: list[bytes]) -> tuple[int, int]:
        whole = hashlib.blake2b(b"%d %d " % (gram, ahead) + b" ".join(part), digest_size=16).digest()
        return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(first, 256)
                for gram, seg, n, anchor, copies, body in zip(*(part.column(k).to_pylist() for k in ("gram", "seg", "windows", "before", "copies", "words")), strict=True):
                    own = body.split(b" ")
                    for k in range(n):
                        spelling = own[anchor : k + window] + own[k:anchor][::-1]
                        rows.append((gram, seg, 1 << k, copies, *digest(gram, anchor - k, spelling[:before]), *digest(gram, anchor - k, spelling[:words]), b" ".join(spelling[words:])))
                columns = zip(*rows, strict=True) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if k == 8 else pa.int64()) for k, c in enumerate(columns)], names=["gram", "seg", "bit", "copies", "q1", "q2", "p1", "p2", "rest"])

    return spell


def _lengthened(heavy: DataFrame, window: int) -> DataFrame:
    """gram, seg, mask of the repeated windows of segments under heavy prefixes.

    `heavy` is read anew for every length: a segment is far smaller than its windows. Of these only hashes are shuffled
    to count groups, and the rests of those in groups of two and more that fit a task.
    """
    out, before, still = None, GRAM, None
    for step in (*STEPS, window):
        words = min(window, before + step)
        rows = heavy.mapInArrow(_spelled(window, before, words), "gram long, seg long, bit long, copies long, q1 long, q2 long, p1 long, p2 long, rest binary")
        if still is not None:  # groups that were too large so far: one in HEAVY windows at most, which Spark may broadcast by its size
            rows = rows.join(still.withColumnsRenamed({"p1": "q1", "p2": "q2"}), ["q1", "q2"], "left_semi")
        sizes = cut_lineage(rows.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.sum("copies").alias("total")).filter("total > 1").drop("total"))
        if words == window:  # one spelling each: all of a group are equal
            found = rows.select("gram", "seg", F.col("bit").alias("mask"), "p1", "p2").join(sizes.drop("n"), ["p1", "p2"]).select("gram", "seg", "mask")
            return found if out is None else out.unionByName(found)
        light = rows.join(sizes.filter(F.col("n") <= HEAVY).drop("n"), ["p1", "p2"]).select("p1", "gram", "seg", "bit", "copies", "rest")
        grown = light.repartition("p1").sortWithinPartitions("p1").mapInArrow(_long_subtrees(window - words), "gram long, seg long, mask long")
        out = grown if out is None else out.unionByName(grown)
        still = sizes.filter(F.col("n") > HEAVY).drop("n")
        if still.isEmpty():
            return out
        before = words


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """k1, k2 and found, an array of (start, mask): the repeated windows of a document from word `start` on.

    `docs` has k1, k2 (long; they name a document, not null), row and text. Documents without a repeat have
    no row. Steps that read the same exchange ask for the same columns, so that it is made once.
    """
    if not GRAM < window <= GRAM + 61:
        raise ValueError("window must be 9 to 69 words")
    segments = docs.select("k1", "k2", "text").mapInArrow(_read_segments(window), "k1 long, k2 long, gram long, seg long, place long")
    # Written first, so that Spark can split the join where one gram has a large share of all segments.
    grams = cut_lineage(segments.groupBy("gram").agg(F.count("*").alias("n"), (F.min("seg") != F.max("seg")).alias("mixed")).filter("n > 1").drop("n"))
    # A hot gram must not bind the next steps to its task: they go by (mix, seg), which names the same pairs.
    mix = F.col("gram").bitwiseXOR(F.col("seg"))
    live = cut_lineage(segments.join(grams, "gram").select("k1", "k2", mix.alias("mix"), "seg", "place", "mixed"))
    one = live.filter("mixed").groupBy("mix", "seg").agg(F.min(F.struct("k1", "k2", "place")).alias("at"), F.count("*").alias("copies")).withColumn("gram", F.col("mix").bitwiseXOR(F.col("seg")))
    heavy = cut_lineage(one.groupBy("gram").count().filter(F.col("count") > HEAVY).select("gram", F.lit(True).alias("heavy")))
    part = lambda low, bits: F.shiftright("at.place", low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    wanted = F.struct("gram", "seg", F.shiftright("at.place", 16).alias("start"), part(8, 8).alias("windows"), part(0, 8).alias("before"), "copies", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    lists = one.join(heavy, "gram", "left").groupBy("at.k1", "at.k2").agg(F.collect_list(wanted).alias("wanted"))
    taken = docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_cut_segments(window), _SCHEMA)
    any_heavy = not heavy.isEmpty()
    taken = cut_lineage(taken) if any_heavy else taken  # read several times then, and far smaller than the texts
    grown = taken.filter("NOT heavy").drop("heavy").repartition("gram").sortWithinPartitions("gram").mapInArrow(_subtrees(window), "gram long, seg long, mask long")
    if any_heavy:
        grown = grown.unionByName(_lengthened(taken.filter("heavy"), window))
    # Written first, so that Spark can split the join where one segment's copies are a large share of all.
    masks = cut_lineage(grown.select(mix.alias("mix"), "seg", "mask").groupBy("mix", "seg").agg(F.bit_or("mask").alias("mask")))
    every = F.expr("shiftleft(1L, cast(shiftright(place, 8) & 255 AS int)) - 1")
    told = live.filter("mixed").join(masks, ["mix", "seg"]).select("k1", "k2", "place", "mask").unionByName(live.filter("NOT mixed").select("k1", "k2", "place", every.alias("mask")))
    spans = told.select("k1", "k2", F.struct(F.shiftright("place", 16).alias("start"), "mask").alias("x"))
    # Repeated rows share k1 and k2 and have the same spans, which are kept once.
    return spans.groupBy("k1", "k2").agg(F.collect_set("x").alias("found"))


def _removed(n: int, found: list[dict] | None, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for x in found or ():
        mask, at = x["mask"], x["start"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = (~(mask >> low) & ((mask >> low) + 1)).bit_length() - 1
            edge[at + low] += 1
            edge[at + low + run + window - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:n]) > 0


def _with_repeats(docs: DataFrame, keep: tuple[str, ...], window: int) -> DataFrame:
    """row (a struct of the kept columns but the text), text, found. A row goes by two hashes of its id and text."""
    others = [F.col(quoted(c)).alias(c) for c in keep if c != "text"]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    return rows.join(repeats(rows, window), ["k1", "k2"], "left").select("row", "text", "found")


def cut(docs: DataFrame, keep: tuple[str, ...], window: int = 35, digest: bool = False) -> DataFrame:
    """row (a struct of the kept columns but the text), n_words, n_removed, kept or kept_sha256, text: no name can clash."""
    given = _with_repeats(docs, keep, window)
    kind, name = given.schema["row"].dataType, "kept_sha256" if digest else "kept"
    texts_too = not digest

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches):
            words_of, gone, bodies = [], [], []
            for text, spans in zip(texts, batch.column("found").to_pylist(), strict=True):
                words = text.split()
                words_of.append(len(words))
                if spans:
                    out = _removed(len(words), spans, window)
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                body = b" ".join(words)
                bodies.append(hashlib.sha256(body).hexdigest() if digest else body.decode())
            columns = [batch.column("row"), pa.array(words_of, pa.int64()), pa.array(gone, pa.int64()), pa.array(bodies, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * texts_too, names=["row", "n_words", "n_removed", name] + ["text"] * texts_too)

    return given.mapInArrow(trim, shape(row=kind, n_words="long", n_removed="long", **{name: "string"}, **{"text": "string"} if texts_too else {}))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """All columns of `docs` with n_words, n_removed, kept (the words left, joined by a space) added.

    Every word of a window that also starts elsewhere goes, so no occurrence stays; windows are judged on
    the input. Null texts have no words. Repeated rows are documents of their own, so all their windows
    repeat; each keeps its row. doc_id may be null and of any type. A result whose name a column of `docs` has
    takes `_2` behind it. An empty table gives an empty result. A text of any length is read whole, in its worker.
    """
    keep = tuple(docs.columns)
    return cut(docs, keep, window).select(*kept_columns(keep), *results(("n_words", "n_removed", "kept"), keep))


def repeat_digests(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the same removal; other columns of `docs` are not read."""
    return cut(docs, ("doc_id",), window, True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def repeat_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, start_word, n_words, text: the maximal runs of words that repeated windows cover, as they stand.

    Null texts and documents without a repeat have no row; repeated rows have theirs each.
    """
    given = _with_repeats(docs, ("doc_id",), window).filter("found IS NOT NULL")
    kind = given.schema["row"].dataType

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches):
            row, first, length, body = [], [], [], []
            for k, (text, found) in enumerate(zip(texts, batch.column("found").to_pylist(), strict=True)):
                words = text.split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], _removed(len(words), found, window).astype(np.int8), [0]]))).tolist()
                for a, b in zip(edges[0::2], edges[1::2], strict=True):
                    row.append(k), first.append(a), length.append(b - a), body.append(b" ".join(words[a:b]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row, pa.int64())), pa.array(first, pa.int64()), pa.array(length, pa.int64()), pa.array(body, pa.string())], names=["row", "start_word", "n_words", "text"])

    return given.mapInArrow(spans, shape(row=kind, start_word="long", n_words="long", text="string")).select("row.doc_id", "start_word", "n_words", "text")
