"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel of two words sums over all common subsequences of three letters, each weighted by DECAY for
every letter it spans in either word, is normalised to 1 for equal words, and taken to a power; gaps and inserted
characters lower it only a little. Landmarks are words of labelled sentences: those that mark toxic
documents most, and frequent ones. A sentence is described by its words' largest kernel with each
landmark, mapped by the inverse square root of the landmarks' own kernel matrix, and judged by a linear
machine with hinge loss. Labels are given for documents, so in each toxic one the sentence that the
machine finds most toxic is taken as the example, and the machine is fitted again. A document scores as
its most toxic sentence, turned into a probability by Platt's sigmoid.

Letters are bytes here: ASCII letters in lower case and all bytes of other characters; everything else
inside a word is dropped, and three or more words of one letter in a row are also read as one word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.common import SPACES, held, joined, kept_columns, results, row_and_text, shape, slices, span_hashes, word_spans
from helixframe.llm.labelled import fold, labelled_texts
from helixframe.llm.quality import platt

#: Subsequence length, decay, landmarks that mark toxic documents, frequent ones, documents per label that the fit sees at most.
ORDER, DECAY, MARKING, FREQUENT, SAMPLE = 3, 0.9, 96, 16, 1500
#: A kernel counts from FLOOR on, and to the power POWER (a product of kernels is one).
FLOOR, POWER = 0.4, 4
#: Longer words are read in overlapping parts of so many letters; a worker remembers so many words.
LONGEST, MAX_WORDS = 32, 500_000

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[list(SPACES)] = 32
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@lru_cache(64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of all subsequences of three letters of a word, and their weights."""
    i, j, k = np.array(list(combinations(range(length), ORDER)), np.int64).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    table = np.zeros((len(words), int(lengths.max(initial=1))), np.uint8)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return table, lengths


def _own(table: np.ndarray) -> np.ndarray:
    """The kernel of each word (rows, all of one length) with itself."""
    i, j, k, weight = _triples(table.shape[1])
    wide = table.astype(np.int64)
    out = np.zeros(len(table), np.float32)
    for first in range(0, len(table), step := max(1, 1 << 20 >> len(weight).bit_length())):
        part = wide[first : first + step]
        codes = (part[:, i] << 16) | (part[:, j] << 8) | part[:, k]
        order = np.argsort(codes, axis=1, kind="stable")
        codes = np.take_along_axis(codes, order, axis=1)
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
        np.add.at(out, first + np.nonzero(new)[0], sums * sums)
    return out


class _Landmarks:
    """The landmarks' subsequences, as a table from three letters to their weights in every landmark."""

    def __init__(self, words: list[bytes]):
        self.words = words
        letters = sorted({c for w in words for c in w})
        self.size = len(letters) + 1
        self.letter = np.zeros(256, np.int64)
        self.letter[letters] = np.arange(1, self.size)
        place: dict[int, int] = {}
        rows: list[np.ndarray] = [np.zeros(len(words), np.float32)]
        own = np.zeros(len(words))
        for n, word in enumerate(words):
            table = np.frombuffer(word, np.uint8)[None, :]
            own[n] = _own(table)[0]
            for code, weight in zip(self.codes(table)[0].tolist(), _triples(len(word))[3].tolist(), strict=True):
                if place.setdefault(code, len(rows)) == len(rows):
                    rows.append(np.zeros(len(words), np.float32))
                rows[place[code]][n] += weight
        self.weights = np.ascontiguousarray((np.array(rows) / np.sqrt(np.maximum(own, 1e-12)).astype(np.float32)).T)
        self.bit = np.where(self.letter > 0, np.uint64(1) << (self.letter % 64).astype(np.uint64), np.uint64(0))
        self.masks = np.array([np.bitwise_or.reduce(self.bit[list(w)]) for w in words], np.uint64)
        self.need = np.array([self._need(w, weight) for w, weight in zip(words, self.weights, strict=True)], np.int64)
        self.place = np.zeros(self.size**ORDER, np.int32)
        self.place[list(place)] = list(place.values())

    def _need(self, word: bytes, weight: np.ndarray) -> int:
        """How many of a landmark's letters a word must hold at least for a kernel of FLOOR (by Cauchy and Schwarz)."""
        i, j, k, _ = _triples(len(word))
        letters = np.array(sorted({int(x) for x in self.bit[list(word)]}), np.uint64)
        if len(letters) > 10:
            return ORDER
        of = np.searchsorted(letters, self.bit[list(word)])
        mass: dict[tuple, float] = {}
        for a, b, c in zip(i.tolist(), j.tolist(), k.tolist(), strict=True):
            mass[word[a], word[b], word[c]] = 1 << int(of[a]) | 1 << int(of[b]) | 1 << int(of[c])
        total: dict[tuple, float] = {}
        for a, b, c, w in zip(i.tolist(), j.tolist(), k.tolist(), _triples(len(word))[3].tolist(), strict=True):
            total[word[a], word[b], word[c]] = total.get((word[a], word[b], word[c]), 0) + w
        held, square = np.array([mass[t] for t in total]), np.array([total[t] ** 2 for t in total])
        subsets = np.arange(1 << len(letters))
        share = ((held[None, :] & ~subsets[:, None]) == 0) @ square / square.sum()
        return int(np.bitwise_count(subsets[share >= FLOOR**2 * 0.999]).min())

    def codes(self, table: np.ndarray) -> np.ndarray:
        i, j, k, _ = _triples(table.shape[1])
        own = self.letter[table]
        return (own[:, i] * self.size + own[:, j]) * self.size + own[:, k]

    def similarities(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernels to the power POWER, words x landmarks; those of less than FLOOR count as none."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in range(ORDER, LONGEST + 1):
            group = np.flatnonzero(lengths == length)
            weight = _triples(length)[3]
            least = float((weight * weight).sum())  # the kernel of a word of this length with itself is no less
            for first in range(0, len(group), step := max(1, 1 << 20 >> len(weight).bit_length())):
                at = group[first : first + step]
                table = np.frombuffer(b"".join([words[x] for x in at.tolist()]), np.uint8).reshape(-1, length)
                shared = np.bitwise_count(np.bitwise_or.reduce(self.bit[table], axis=1)[:, None] & self.masks[None, :]) >= self.need
                hopeful = np.flatnonzero(shared.any(axis=1))
                if not len(hopeful):
                    continue
                at, table, shared = at[hopeful], table[hopeful], shared[hopeful]
                found = self.place[self.codes(table)]
                kernel = np.zeros(shared.shape, np.float32)
                for n, own in enumerate(self.weights):
                    if len(rows := np.flatnonzero(shared[:, n])):
                        kernel[rows, n] = own[found[rows]] @ weight
                near = np.flatnonzero((kernel >= FLOOR * least**0.5).any(axis=1))
                if len(near):
                    value = kernel[near] / np.sqrt(_own(table[near]))[:, None]
                    out[at[near]] = np.where(value >= FLOOR, np.minimum(value, 1) ** POWER, 0)
        for n in np.flatnonzero(lengths > LONGEST):
            parts = [words[n][a : a + LONGEST] for a in range(0, len(words[n]) - LONGEST // 2, LONGEST // 2)]
            out[n] = self.similarities(parts).max(axis=0)
        return out


def sentence_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of words in them, each word's sentence (ascending), and each sentence's text."""
    data, firsts = joined(texts)
    folded = _FOLD[data]
    inner = np.append(folded[1:] > 32, False)  # a letter follows, as in i.d.i.o.t
    stop = (data == 10) | (_STOP[data] & ~inner)
    text = np.zeros(len(data), np.int64)
    text[firsts[1:-1]] = 1
    text = np.cumsum(text)
    sentence = np.cumsum(stop)  # a newline stands between two texts
    letters = folded > 0
    folded, sentence, text = folded[letters], sentence[letters], text[letters]
    # a sentence's end also ends a word
    edge = np.flatnonzero(np.diff(sentence)) + 1
    if len(edge):
        folded, sentence, text = np.insert(folded, edge, 32), np.insert(sentence, edge, sentence[edge]), np.insert(text, edge, text[edge])
    starts, ends = word_spans(folded)
    of, text_of = sentence[starts], text[starts]
    new = np.concatenate([[True], (np.diff(of) > 0) | (np.diff(text_of) > 0)]) if len(of) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    single = ends - starts == 1
    if single.any():  # letters one by one: t h i s
        run = np.flatnonzero(np.diff(np.concatenate([[0], (single).astype(np.int8), [0]])))
        extra, extra_of, at = [], [], len(folded)
        for a, b in zip(run[0::2].tolist(), run[1::2].tolist(), strict=True):
            cuts = [a, *[k for k in range(a + 1, b) if number[k] != number[k - 1]], b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x >= 3:
                    extra.append(folded[starts[x:y]])
                    extra_of.append((int(number[x]), y - x))
        if extra:
            sizes = np.array([n for _, n in extra_of])
            folded = np.concatenate([folded, *extra])
            more = at + np.concatenate([[0], np.cumsum(sizes)])
            starts, ends = np.concatenate([starts, more[:-1]]), np.concatenate([ends, more[1:]])
            every = np.concatenate([number, [k for k, _ in extra_of]])
            order = np.argsort(every, kind="stable")
            return folded, starts[order], ends[order], every[order], text_of[new]
    return folded, starts, ends, number, text_of[new]


class _Memory:
    """The words that a worker has met, and the landmark similarities (in 255ths) of those that have any; row 0 is for the others."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks, self.kernel = landmarks, _Landmarks(landmarks)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros((1, len(self.landmarks)), np.uint8)

    def of(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word."""
        own = span_hashes(folded, starts, ends)
        distinct, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if not known.all():
            buffer, new = folded.tobytes(), np.flatnonzero(~known)
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            found = np.rint(self.kernel.similarities([buffer[x:y] for x, y in zip(a, b, strict=True)]) * 255).astype(np.uint8)
            some = found.any(axis=1)
            place = np.where(some, len(self.rows) - 1 + np.cumsum(some), 0).astype(np.int32)
            self.rows = np.concatenate([self.rows, found[some]])
            order = np.argsort(every := np.concatenate([self.hashes, distinct[new]]), kind="stable")
            self.hashes, self.place = every[order], np.concatenate([self.place, place])[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.place[at][inverse]


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # of the similarities, the Nystroem map folded in
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[bytes], memory: _Memory) -> np.ndarray:
        """Each text's largest sentence margin, and at least that of a sentence without any similar word."""
        out = np.full(len(texts), self.bias)
        pooled, text = pool(texts, memory)
        np.maximum.at(out, text, _margins(pooled, self.weights, self.bias))
        return out

    def scores(self, texts: list[bytes], memory: _Memory) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts, memory) + self.shift, -40, 40)))


def pool(texts: list[bytes], memory: _Memory) -> tuple[np.ndarray, np.ndarray]:
    """The largest similarities (in 255ths) of each sentence that has any, and its text."""
    folded, starts, ends, sentence, text = sentence_words(texts)
    rows = memory.of(folded, starts, ends) if len(starts) else np.zeros(0, np.int32)
    similar = np.flatnonzero(rows)
    if not len(similar):
        return np.zeros((0, len(memory.landmarks)), np.uint8), text[:0]
    first = np.flatnonzero(np.diff(sentence[similar], prepend=-1))
    return np.maximum.reduceat(memory.rows[rows[similar]], first, axis=0), text[sentence[similar[first]]]


def _pool_in_parts(texts: list[bytes], memory: _Memory, size: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """`pool` over many texts, about `size` bytes at a time."""
    found, first, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k + 1 == len(texts):
            pooled, text = pool(texts[first : k + 1], memory)
            found.append((pooled, text + first))
            first, held = k + 1, 0
    return np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found])


def _margins(pooled: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    scaled = (weights / 255).astype(np.float32)
    parts = [pooled[k : k + 16384].astype(np.float32) @ scaled for k in range(0, len(pooled), 16384)]
    return np.concatenate(parts) + bias if parts else np.zeros(0)


def _landmarks(texts: list[bytes], labels: np.ndarray) -> list[bytes]:
    """Words that mark toxic documents most (by document frequency), then frequent ones."""
    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels.tolist(), strict=True):
        folded, starts, ends, *_ = sentence_words([text])
        buffer = folded.tobytes()
        own = {buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if ORDER <= b - a <= LONGEST}
        (toxic if y else clean).update(own)
    n, m = max(1, int(labels.sum())), max(1, int((labels == 0).sum()))
    lift = {w: k / n * np.log((k + 0.5) / n / ((clean[w] + 0.5) / m)) for w, k in toxic.items()}
    marking = sorted((w for w in lift if lift[w] > 0 and toxic[w] > 1), key=lambda w: (-lift[w], w))[:MARKING]
    frequent = sorted((w for w in clean if w not in marking), key=lambda w: (-clean[w], w))[:FREQUENT]
    return marking + frequent


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine with balanced classes and squared hinge loss, by Newton steps on the violators."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = penalty * np.eye(z.shape[1])
    w, before = np.zeros(z.shape[1]), None
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        v = z[inside]
        w = np.linalg.solve((v.T * share[inside]) @ v + ridge, v.T @ (share[inside] * y[inside]))
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], passes: int = 3) -> Model:
    """Fit on documents with labels. Without both labels, or without landmarks, every text scores under 0.5."""
    texts, labels = [t.encode() for t, _ in rows], np.array([y for _, y in rows], np.int64)
    marks = _landmarks(texts, labels) if len(set(labels.tolist())) == 2 else []
    if not marks:
        return Model([], np.zeros(0), 0.0, 0.0, -10.0)
    memory = _Memory(marks)
    pooled, text = _pool_in_parts(texts, memory)
    values, vectors = np.linalg.eigh(memory.kernel.similarities(marks).astype(np.float64))
    nystroem = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    order = np.arange(len(text))
    margin = pooled[:, :MARKING].max(axis=1, initial=0).astype(np.float32)
    spoiled = memory.kernel.similarities([w[: len(w) // 2] + b"x" + w[len(w) // 2 :] for w in marks])
    weights, bias = np.zeros(len(marks)), 0.0
    for _ in range(passes):  # of each document its most toxic sentence
        ranked = np.lexsort((order, -margin, text))
        best = ranked[np.unique(text[ranked], return_index=True)[1]]
        chosen = np.unique(np.concatenate([best, order[labels[text] == 0][::7]]))
        y = np.where(labels[text[chosen]] == 1, 1.0, -1.0)
        x = pooled[chosen].astype(np.float64) / 255
        # the same toxic sentences with a letter put into the word that marks them most
        toxic = x[y > 0]
        mark = np.argmax(toxic, axis=1)
        gapped = np.where(toxic > 0.6, spoiled[mark], np.maximum(toxic, spoiled[mark]))[toxic.max(axis=1) > 0.6]
        clean = np.zeros((int((labels == 0).sum()), len(marks)))  # of each clean document a sentence without any similar word
        w, bias = _machine(np.concatenate([x, gapped, clean]) @ nystroem, np.concatenate([y, np.ones(len(gapped)), -np.ones(len(clean))]))
        weights = nystroem @ w
        margin = _margins(pooled, weights, bias)
    model = Model(marks, weights, bias)
    found = np.full(len(texts), bias)
    np.maximum.at(found, text, margin)
    model.slope, model.shift = platt(found, labels)
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The model of a bounded sample (at most about `bound` documents of each label) of the rows that are not held out."""
    return fit(labelled_texts(docs, labels.filter(fold(5) != 0), "toxic", bound))


def judged(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """row (a struct of the kept columns but the text), score, predicted, and text if it is kept: no name can clash."""
    given, texts_too = row_and_text(docs, keep), "text" in keep
    kind = given.schema["row"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = held(("toxicity", *model.landmarks), lambda: _Memory(model.landmarks))
        for batch, texts in slices(batches):
            p = model.scores(texts, memory)
            columns = [batch.column("row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))] + [batch.column("text")] * texts_too
            yield pa.RecordBatch.from_arrays(columns, names=["row", "score", "predicted"] + ["text"] * texts_too)

    return given.mapInArrow(score, shape(row=kind, score="double", predicted="int", **{"text": "string"} if texts_too else {}))


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from 0.5 on).

    Null texts count as empty and score as a text without a similar word. Repeated rows stay repeated and
    score alike; null ids and other columns pass through. A result whose name a kept column has takes `_2`
    behind it. An empty table gives an empty result. A text of any length is scored whole, in its worker.
    """
    return judged(docs, model, keep).select(*kept_columns(keep), *results(("score", "predicted"), keep))
