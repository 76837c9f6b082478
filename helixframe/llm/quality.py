"""Quality rules: exact counts, then a calibrated logistic regression on hashed word and character n-grams.

The model sees a text as bags, its words and its character 3- and 4-grams (code points), each hashed into a table of
weights and averaged over the bag. It is fitted on labelled documents (Adagrad on the logistic loss),
its scores are calibrated on labelled documents that the fit has not seen (Platt's sigmoid), and texts
are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.common import SPACES, joined, kept_columns, mix, release, results, row_and_text, shape, slices, span_hashes, word_spans
from helixframe.llm.labelled import labelled_texts

#: Hash buckets of each bag, labelled documents per label that the fit sees at most, and the threshold.
BUCKETS, SAMPLE, THRESHOLD = 1 << 16, 1500, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, firsts = joined(texts)
    starts, ends = word_spans(data)
    first_word = np.searchsorted(starts, firsts)
    n_words = np.diff(first_word)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[np.minimum(firsts[1:], len(flags))] - sums[firsts[:-1]]

    row = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        word = span_hashes(data, starts, ends)
        three = mix((word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + mix(word[2:] + row[2:]))
        three = three[inside := np.flatnonzero(row[:-2] == row[2:])]
        _, of, times = np.unique(three, return_inverse=True, return_counts=True)
        for k in range(3):
            repeated[inside[times[of] > 1] + k] = True
    sums = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(repeated, out=sums[1:])
    dup_lines = []
    for text in texts:
        seen, n = set(), 0
        for line in text.split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip(SPACES):
                seen.add(line)
        dup_lines.append(n)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_text(~_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": sums[first_word[1:]] - sums[first_word[:-1]],
    }


def _bags(data: np.ndarray, firsts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, character 3-grams and 4-grams: each item's bucket, and every text's first item and the one after its last."""
    starts, ends = word_spans(data)
    first_word = np.searchsorted(starts, firsts)
    out = [((span_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS, first_word[:-1], first_word[1:])]
    lead = (data & 0xC0) != 0x80
    if lead.all():
        points, first = data.astype(np.uint64), firsts
    else:  # texts between newlines are valid UTF-8, so each lead byte starts a code point
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        before = np.zeros(len(data) + 2, np.int64)
        np.cumsum(lead, out=before[1:-1])
        before[-1] = before[-2] + 1
        first = before[firsts]
    for n in (3, 4):
        if len(points) < n:
            out.append((np.zeros(0, np.int64), first[:-1] * 0, first[:-1] * 0))
            continue
        code = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):  # three characters have 63 bits; of four the first one's high bits mix into the others'
            code = (code << np.uint64(21)) ^ (code >> np.uint64(43)) ^ points[k : k + len(code)]
        code *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(first[:-1], len(code))
        out.append(((code >> np.uint64(40)).astype(np.int64) % BUCKETS, low, np.maximum(low, first[1:] - n)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # bag, bucket
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[bytes]) -> np.ndarray:
        data, firsts = joined(texts)
        total = np.full(len(texts), self.bias)
        for weights, (bucket, low, high) in zip(self.weights, _bags(data, firsts), strict=True):
            sums = np.zeros(len(bucket) + 1)
            np.cumsum(weights[bucket], out=sums[1:])
            total += (sums[high] - sums[low]) / np.maximum(high - low, 1)
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits labels to margins best (Newton steps, smoothed targets, slope kept from falling)."""
    positive, negative = int(labels.sum()), int(len(labels) - labels.sum())
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = float(np.std(margins)) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, np.log(positive / negative)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3) / scale, float(theta[1])


def fit(rows: list[tuple[str, int]], rounds: int = 60, rate: float = 4.0) -> Model:
    """Fit on four fifths of the rows, calibrate on the rest (by the texts' crc32). Without both labels every text passes."""
    texts, labels = [t.encode() for t, _ in rows], np.array([y for _, y in rows], np.int64)
    model = Model(np.zeros((3, BUCKETS), np.float32), 0.0)
    if len(set(labels.tolist())) < 2:
        model.shift = 10.0
        return model
    aside = np.array([zlib.crc32(t) % 5 == 0 for t in texts])
    if len(set(labels[~aside].tolist())) < 2 or len(set(labels[aside].tolist())) < 2:
        aside[:] = False
    train = np.flatnonzero(~aside)
    y = labels[train]
    held: list[list[tuple]] = [[], [], []]
    for first in range(0, len(train), 100):  # one entry per text and bucket, with its share of the bag
        data, firsts = joined([texts[k] for k in train[first : first + 100]])
        for k, (bucket, low, high) in enumerate(_bags(data, firsts)):
            size = high - low
            row = np.repeat(np.arange(len(low)), size)
            item = np.arange(len(row)) + np.repeat(low - np.cumsum(size) + size, size)
            code, count = np.unique(row * BUCKETS + bucket[item], return_counts=True)
            share = count / np.maximum(size, 1)[code // BUCKETS]
            held[k].append(((code // BUCKETS + first).astype(np.int32), (code % BUCKETS).astype(np.int32), share.astype(np.float32)))
    parts = [tuple(np.concatenate(x) for x in zip(*h, strict=True)) for h in held]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    squares, bias_square = np.full((3, BUCKETS), 1e-12), 1e-12
    for _ in range(rounds):
        z = np.full(len(train), model.bias)
        for k, (row, bucket, share) in enumerate(parts):
            z += np.bincount(row, weights=share * model.weights[k, bucket], minlength=len(train))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        for k, (row, bucket, share) in enumerate(parts):
            g = np.bincount(bucket, weights=share * slope[row], minlength=BUCKETS) + 1e-9 * model.weights[k]
            squares[k] += g * g
            model.weights[k] -= (rate * g / np.sqrt(squares[k])).astype(np.float32)
        g = float(slope.sum())
        bias_square += g * g
        model.bias -= 0.1 * g / bias_square**0.5
    calibrate = np.flatnonzero(aside) if aside.any() else train
    model.slope, model.shift = platt(model.margins([texts[k] for k in calibrate]), labels[calibrate])
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents (at most about `bound` of each quality label)."""
    return fit(labelled_texts(docs, labels, "quality", bound))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, model: Model, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """row (a struct of the kept columns but the text), the counts, base_failed, probability, kept, and text if it is kept: no name can clash."""
    given, texts_too = row_and_text(docs, keep), "text" in keep
    kind = given.schema["row"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in slices(batches):
            counts = base_counts(texts)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            p = model.probabilities(texts)
            columns = [batch.column("row"), *[pa.array(counts[k]) for k in _COUNTS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * texts_too, names=["row", *_COUNTS, "base_failed", "probability", "kept"] + ["text"] * texts_too)

    return given.mapInArrow(score, shape(row=kind, **dict.fromkeys(_COUNTS, "long"), base_failed="boolean", probability="double", kept="boolean", **{"text": "string"} if texts_too else {}))


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    A text fails the base rules with fewer than 50 words or if over half of its words repeat; else the
    model decides. Null texts have no words, so they fail. Repeated rows stay repeated and are judged alike;
    null ids and other columns pass through. A result whose name a kept column has takes `_2` behind it.
    An empty table gives an empty result. A text of any length is judged whole, in its worker.
    """
    return judged(docs, model, threshold, keep).select(*kept_columns(keep), *results((*_COUNTS, "base_failed", "probability", "kept"), keep))
