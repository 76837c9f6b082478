"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script, by fixed code point ranges, narrows its candidates to the languages that were seen in
that script. Its score for each is a naive Bayes log-likelihood over hashed byte 1- to 4-grams, word
ends included, cut off so that one word cannot decide alone. A Viterbi path over the words of a text,
which pays SWITCH for each change of language, labels spans; the language with most letters in them is
the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import held, joined, kept_columns, results, row_and_text, shape, slices, span_hashes, word_spans
from helixframe.llm.labelled import fold, sample, stretch

#: First code points of ranges and their scripts (fixed values of Unicode blocks).
RANGES = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "other"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
]
_FIRSTS, _NAMES = np.array([a for a, _ in RANGES]), [b for _, b in RANGES]
SCRIPTS = sorted(set(_NAMES))
_SCRIPT = np.array([SCRIPTS.index(b) for b in _NAMES])
#: Hash buckets, the cost of a switch, the largest difference that one word can make, documents per language that the fit sees at most.
BUCKETS, SWITCH, CUT, SAMPLE = 1 << 15, 8.0, 6.0, 1500
#: A language is a candidate in a script that holds this share of its sampled letters. Words that a worker remembers.
SCRIPT_SHARE, MAX_WORDS = 0.01, 400_000


def _letters(word: str) -> tuple[int, int]:
    """(script of most letters, letters) of a word; the script of the first letter on a tie."""
    codes = np.array([ord(c) for c in word if c.isalpha()], np.int64)
    if not len(codes):
        return -1, 0
    scripts = _SCRIPT[np.searchsorted(_FIRSTS, codes, "right") - 1]
    counts = np.bincount(scripts, minlength=len(SCRIPTS))
    return int(scripts[np.argmax(counts[scripts])]), len(codes)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every 1- to 4-gram of lower-cased words between two marks."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), lengths)
    of, buckets = [], []
    for n in range(1, 5):
        if len(data) < n:
            break
        code = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : k + len(code)]
        code *= np.uint64(0x9E3779B97F4A7C15)
        inside = word[: len(code)] == word[n - 1 :]
        of.append(word[: len(code)][inside])
        buckets.append((code >> np.uint64(40)).astype(np.int64)[inside] % BUCKETS)
    return np.concatenate(of), np.concatenate(buckets)


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word. `scores`: words x labels, the texts one after another from `firsts` (with the end)."""
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    first, length = firsts[:-1][order], lengths[order]
    labels = scores.shape[1]
    best = np.empty((len(scores), labels), np.int16)  # where each label's path comes from
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), "left")  # texts longer than t
    value = np.zeros((len(order), labels), np.float32)
    own = np.arange(labels, dtype=np.int16)
    for t in range(longest):
        n = live[t]
        at, v = first[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(n), top] - switch
            stay = v >= jump[:, None]
            best[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, jump[:, None])
        value[:n] = v + scores[at]
    out = np.empty(len(scores), np.int16)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = best[at, state[:n]]
    return out


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # bucket, language
    scripts: np.ndarray  # script, language: is a candidate


class _Memory:
    """Scores and letters of the words that a worker has met; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = np.zeros(0, np.uint64)
        self.scores, self.letters = np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int32)

    def _score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        lowered = [w.decode().lower() for w in words]
        found = [_letters(w) for w in lowered]
        script, letters = np.array([s for s, _ in found]), np.array([n for _, n in found], np.int32)
        bare = ["".join(c for c in w if c.isalpha()).encode() for w in lowered]
        word, bucket = _grams(bare)
        total = np.stack([np.bincount(word, weights=model.logs[bucket, k], minlength=len(words)) for k in range(len(model.languages))], axis=1)
        total /= np.maximum(np.bincount(word, minlength=len(words)), 1)[:, None] ** 0.5
        allowed = model.scripts[script] | ~model.scripts[script].any(axis=1, keepdims=True)
        total = np.where(allowed, total, -np.inf)
        total = np.maximum(total - total.max(axis=1, keepdims=True), -CUT)
        total[letters == 0] = 0
        return total.astype(np.float32), letters

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_WORDS:
            self.__init__(self.model)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if not known.all():
            buffer, new = data.tobytes(), np.flatnonzero(~known)
            scores, letters = self._score([buffer[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            order = np.argsort(every := np.concatenate([self.hashes, distinct[new]]), kind="stable")
            self.hashes = every[order]
            self.scores, self.letters = np.concatenate([self.scores, scores])[order], np.concatenate([self.letters, letters])[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.scores[at][inverse], self.letters[at][inverse]


def _memory(model: Model) -> _Memory:
    """The memory of this worker; it goes on over tasks of the same model."""
    key = ("langid", *model.languages, float(model.logs.sum()), float(np.abs(model.logs[::7]).sum()))
    return held(key, lambda: _Memory(model))


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    counts, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for text, lang in rows:
        k = languages.index(lang)
        lowered = text.lower()
        codes = np.array([ord(c) for c in lowered if c.isalpha()], np.int64)
        scripts[:, k] += np.bincount(_SCRIPT[np.searchsorted(_FIRSTS, codes, "right") - 1], minlength=len(SCRIPTS)) if len(codes) else 0
        bare = [w for w in ("".join(c for c in w if c.isalpha()).encode() for w in lowered.split()) if w]
        if bare:
            counts[:, k] += np.bincount(_grams(bare)[1], minlength=BUCKETS)
    smoothed = counts + 0.5
    logs = np.log(smoothed / smoothed.sum(axis=0, keepdims=True)) if languages else smoothed
    return Model(languages, logs.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1))


def train(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """The model of a bounded sample of the rows that are not held out: at most about `bound` documents of each language, `MAX_ROWS` of all, of longer texts a stretch of `MAX_BYTES` each."""
    known = docs.filter(fold(4) != 2).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", stretch().alias("text"))
    rows = sample(known, "lang", bound).select("doc_id", "text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))])


def labelled_words(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: starts, ends (in the joined buffer), labels, letters; the first word of every text, and the texts' first bytes."""
    data, firsts = joined(texts)
    starts, ends = word_spans(data)
    first_word = np.searchsorted(starts, firsts)
    if not len(starts) or not model.languages:
        return starts, ends, np.zeros(len(starts), np.int16), np.zeros(len(starts), np.int32), first_word, firsts
    scores, letters = _memory(model).of(data, starts, ends)
    return starts, ends, viterbi(scores, first_word, SWITCH), letters, first_word, firsts


def languages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, the share of the letters in spans of that language.

    Null texts, texts without a letter, and all texts where nothing was learned are `und` with score 0.
    On a tie the first language by name. Repeated rows stay repeated; null ids and other columns pass. A result
    whose name a kept column has takes `_2` behind it. An empty table gives an empty result. A text of any
    length is labelled whole, in its worker.
    """
    given, texts_too = row_and_text(docs, keep), "text" in keep
    kind = given.schema["row"].dataType

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = [*model.languages, "und"], len(model.languages)
        for batch, texts in slices(batches, size=4 << 20):
            _, _, labels, letters, first, _ = labelled_words(texts, model)
            row = np.repeat(np.arange(len(texts)), np.diff(first))
            held = np.bincount(row * (k + 1) + labels, weights=letters, minlength=len(texts) * (k + 1)).reshape(len(texts), k + 1)
            total = held.sum(axis=1)
            best = np.where(total > 0, held.argmax(axis=1), k)
            score = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
            columns = [batch.column("row"), pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(score)] + [batch.column("text")] * texts_too
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"] + ["text"] * texts_too)

    schema = shape(row=kind, lang_pred="string", score="double", **{"text": "string"} if texts_too else {})
    return given.mapInArrow(label, schema).select(*kept_columns(keep), *results(("lang_pred", "score"), keep))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per span of one language: doc_id, span_no, lang, start_word, n_words, text.

    Null texts and texts without a word have none, and no text has any where nothing was learned. Repeated rows
    have their spans each; a null doc_id stays null; no other column of `docs` is read.
    """
    kind = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=4 << 20):
            starts, ends, labels, _, first, _ = labelled_words(texts, model)
            buffer = joined(texts)[0].tobytes()
            rows: dict[str, list] = {k: [] for k in ("row", "span_no", "lang", "start_word", "n_words", "text")}
            for k in range(len(texts)):
                a, b = int(first[k]), int(first[k + 1])
                edges = [a, *(a + 1 + np.flatnonzero(np.diff(labels[a:b]))).tolist(), b] if b > a and model.languages else []
                for number, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in zip(rows, (k, number, model.languages[labels[x]], x - a, y - x, buffer[starts[x] : ends[y - 1]].decode()), strict=True):
                        rows[name].append(v)
            columns = [pa.array(rows[n], t) for n, t in (("span_no", pa.int32()), ("lang", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows["row"], pa.int64())), *columns], names=["doc_id", "span_no", "lang", "start_word", "n_words", "text"])

    return docs.select("doc_id", "text").mapInArrow(cut, shape(doc_id=kind, span_no="int", lang="string", start_word="long", n_words="long", text="string"))
