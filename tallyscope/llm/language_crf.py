"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams of one to four bytes, with its ends marked (so the outer ones are its
affixes), and the word itself (the lexicon). All features are hashed into one weight table of fixed size. Transitions
between the labels of neighbouring words are learned with them, on lines of labelled texts; several lines of any
languages make one training sequence, so the model sees switches. Forward-backward gives every word the probability
of each language; a text's language is the one with the largest mean, and that mean is the score.

Forward-backward runs over millions of words at once: blocks of words become one matrix each, the blocks are solved
like words, and their states run through the blocks side by side. It is exact for texts of any length.

Cases: a null text or one without letters is ``und`` with score 0; ties between languages go to the first in order;
rows, repeated or not, and other columns are kept (a column with a result's name is replaced); an empty table gives
an empty result; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.words import fingerprints, mixed, released, split_words, text_pieces

#: The sample for fitting: at most so many lines of each label, least hash first; longer lines are cut into pieces of so many bytes.
LINES_PER_LABEL, LINE_BYTES, PARTS = 800, 1500, 16
#: Weights per label are 2 ** WEIGHT_BITS.
WEIGHT_BITS, GRAMS = 18, 4
STEPS, RATE, DECAY = 40, 0.06, 1e-5
#: Bytes of a row in which a trained model comes to the driver.
MODEL_PIECE = 1 << 18
UNKNOWN = "und"

#: 1 for bytes that belong to a word once the text is in lower case: a-z and all characters beyond ASCII.
LETTERS = bytes(1 if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256))
#: The same bytes and A-Z, before texts are in lower case.
IN_WORDS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0x80)
_U = np.uint64


class Crf(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # [2 ** WEIGHT_BITS, labels]
    moves: np.ndarray  # [labels, labels], logarithms
    start: np.ndarray  # [labels], logarithms


# --------------------------------------------------------------------------- features
def lowered(raw: list[bytes]) -> list[bytes]:
    return [x if x.isascii() else x.decode("utf-8", "replace").lower().encode() for x in raw]


def word_types(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First occurrence of each distinct word, its fingerprint, and the type of every word."""
    h, first, kind = np.unique(fingerprints(words.data, words.start, words.end), return_index=True, return_inverse=True)
    return first, h, kind


def type_features(words, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the word types, one after the other, and where each type's begin."""
    size = words.end[first] - words.start[first] + 2
    begin = np.cumsum(size) - size
    total = int(size.sum())
    inside = np.arange(total) - np.repeat(begin, size)
    last = np.repeat(size - 1, size)
    source = np.clip(np.repeat(words.start[first], size) + inside - 1, 0, len(words.data) - 1)
    byte = np.where((inside == 0) | (inside == last), 32, words.data[source]).astype(np.uint32)
    padded = np.concatenate([byte, np.zeros(GRAMS, np.uint32)])
    columns, there, gram = [], [], np.zeros(total, np.uint32)
    for n in range(1, GRAMS + 1):
        gram = gram | padded[n - 1:n - 1 + total] << np.uint32(8 * (n - 1))
        columns.append((mixed(gram.astype(_U) << _U(3) | _U(n)) >> _U(64 - WEIGHT_BITS)).astype(np.int64))
        there.append(inside + n - 1 <= last)
    features, valid = np.stack(columns, 1), np.stack(there, 1)
    # The whole word takes the place of the unigram of its opening mark.
    features[begin, 0] = (mixed(h ^ _U(0xA0761D6478BD642F)) >> _U(64 - WEIGHT_BITS)).astype(np.int64)
    count = valid.sum(1)
    per_type = np.add.reduceat(count, begin) if total else np.zeros(0, np.int64)
    return features[valid], np.cumsum(per_type) - per_type


def type_scores(weights: np.ndarray, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[features], begin, axis=0)


# --------------------------------------------------------------------------- forward-backward
def _scaled(v: np.ndarray, axes) -> np.ndarray:
    return v / v.max(axis=axes, keepdims=True)


def chained(steps: np.ndarray, block: int = 32) -> np.ndarray:
    """v[t] = v[t-1] @ steps[t] up to scale, from a vector of ones: blocks first, then all blocks side by side."""
    total, size = len(steps), steps.shape[1]
    if total <= 2 * block:
        out, v = np.empty((total, size), steps.dtype), np.ones(size, steps.dtype)
        for t in range(total):
            v = v @ steps[t]
            out[t] = v = v / v.max()
        return out
    blocks = -(-total // block)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(size, dtype=steps.dtype), (blocks * block - total, size, size))]).reshape(blocks, block, size, size)
    whole = padded[:, 0]
    for k in range(1, block):
        whole = _scaled(whole @ padded[:, k], (1, 2))
    v = np.concatenate([np.ones((1, size), steps.dtype), chained(whole, block)[:-1]])
    out = np.empty((blocks, block, size), steps.dtype)
    for k in range(block):
        v = _scaled((v[:, None, :] @ padded[:, k])[:, 0], 1)
        out[:, k] = v
    return out.reshape(-1, size)[:total]


def forward_backward(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word marginals, and what training needs: the step matrices and both vectors. ``opens``: the first words of sequences."""
    emit = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    steps = np.broadcast_to(np.exp(moves - moves.max()).astype(np.float32), (len(scores), *moves.shape)).copy()
    steps[opens] = np.exp(start - start.max()).astype(np.float32)[None, :]  # whatever came before
    steps *= emit[:, None, :]
    before = chained(steps)
    after = np.ones_like(before)
    if len(scores) > 1:
        after[:-1] = chained(np.ascontiguousarray(steps[:0:-1].transpose(0, 2, 1)))[::-1]
    marginal = before * after
    marginal /= np.maximum(marginal.sum(1, keepdims=True), np.float32(1e-30))
    return marginal, steps, before, after


# --------------------------------------------------------------------------- fitting
def line_pieces(line: bytes) -> list[bytes]:
    """The line in pieces of at most LINE_BYTES, cut at word ends; a longer word is cut between characters."""
    pieces, at = [], 0
    while len(line) - at > LINE_BYTES:
        end = at + LINE_BYTES
        cut = min(end, at + len(line[at:end + 1].rstrip(IN_WORDS)))
        if cut == at:
            cut = end
            while line[cut] & 0xC0 == 0x80:
                cut -= 1
        pieces.append(line[at:cut])
        at = cut
    return [*pieces, line[at:]]


def sample_rows(docs: DataFrame, text: str, label: str, per_label: int = LINES_PER_LABEL) -> DataFrame:
    """(label, line): distinct lines, or pieces of long lines, among them the ``per_label`` of least hash of each label.

    Tasks keep as many at most, and so do a fixed number of parts of each label.
    """
    def keep(batches):
        heaps: dict[str, tuple[list, set]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                heap, held = heaps.setdefault(name, ([], set()))
                for line in (piece for whole in value.encode().split(b"\n") for piece in line_pieces(whole)):
                    if line:
                        item = (-zlib.crc32(line), line)
                        if (len(heap) < per_label or item > heap[0]) and line not in held:
                            held.add(line)
                            heapq.heappush(heap, item)
                            if len(heap) > per_label:
                                held.discard(heapq.heappop(heap)[1])
        for name, (heap, _) in heaps.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(heap), pa.string()), pa.array([line.decode() for _, line in heap], pa.string())], names=["label", "line"])

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("line"))
    return rows.mapInArrow(keep, "label string, line string").repartition("label", F.crc32("line") % PARTS).mapInArrow(keep, "label string, line string")


def least_lines(rows, per_label: int) -> list[tuple[str, bytes]]:
    """The ``per_label`` lines of least hash of each label, in order."""
    found: dict[str, list[bytes]] = {}
    for name, line in rows:
        found.setdefault(name, []).append(line.encode())
    return [(name, line) for name in sorted(found) for line in sorted(found[name], key=lambda x: (zlib.crc32(x), x))[:per_label]]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_label: int = LINES_PER_LABEL) -> Crf:
    """Fit on a bounded sample of the labelled rows of ``docs``; the model's size is fixed by labels and parameters.

    A task trains, as that takes many times the model's memory; the driver receives the model only.
    """
    def train(batches):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = pickle.dumps(tuple(trained(least_lines(rows, per_label))))
        released()
        for piece, begin in enumerate(range(0, len(model), MODEL_PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([model[begin:begin + MODEL_PIECE]], pa.binary())], names=["piece", "model"])

    pieces = sample_rows(docs, text, label, per_label).repartition(1).mapInArrow(train, "piece long, model binary").collect()
    return Crf(*pickle.loads(b"".join(r.model for r in sorted(pieces, key=lambda r: r.piece)))) if pieces else trained([])


def trained(sample: list[tuple[str, bytes]]) -> Crf:
    """The model of some labelled lines."""
    labels = sorted({name for name, _ in sample})
    size = max(1, len(labels))
    pick = np.random.default_rng(7)
    order = pick.permutation(len(sample))
    words = split_words(lowered([sample[i][1] for i in order]), LETTERS)
    weights = np.zeros((1 << WEIGHT_BITS, size), np.float32)
    moves, start = np.zeros((size, size)), np.zeros(size)
    if len(labels) < 2 or not len(words.start):
        return Crf(labels, weights, moves, start)
    truth = np.array([labels.index(sample[i][0]) for i in order])[words.doc]
    opens = np.zeros(len(truth), bool)
    opens[words.first[:-1][pick.random(len(sample)) < 0.5].clip(0, len(truth) - 1)] = True  # every second line begins a sequence
    opens[0] = True
    first, h, kind = word_types(words)
    features, begin = type_features(words, first, h)
    counts = np.diff(np.r_[begin, len(features)])
    inner = np.flatnonzero(~opens)

    state = [[np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)] for p in (weights, moves, start)]
    for step in range(1, STEPS + 1):
        marginal, steps, before, after = forward_backward(type_scores(weights, features, begin)[kind], moves, start, opens)
        error = -marginal.astype(np.float64)
        error[np.arange(len(truth)), truth] += 1
        by_type = np.stack([np.bincount(kind, error[:, k], len(first)) for k in range(size)], 1)
        spread = np.repeat(by_type, counts, axis=0)
        grad_w = np.stack([np.bincount(features, spread[:, k], len(weights)) for k in range(size)], 1)
        joint = before[inner - 1][:, :, None] * steps[inner] * after[inner][:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
        grad_m = np.zeros((size, size))
        np.add.at(grad_m, (truth[inner - 1], truth[inner]), 1)
        grad_m -= joint.sum(0)
        grad_s = error[opens].sum(0)
        for p, g, (m1, m2) in zip((weights, moves, start), (grad_w / 50, grad_m, grad_s), state):
            g = g - DECAY * p * len(truth)
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += (RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-3)).astype(p.dtype)
    return Crf(labels, weights, moves, start)


# --------------------------------------------------------------------------- labelling
def label_texts(model: Crf, raw: list[bytes]) -> tuple[list[str], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Language and score of each text, and the runs of words of one language: text, label, first word, words."""
    names, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
    words = split_words(lowered(raw), LETTERS)
    none = np.zeros(0, np.int64)
    if not len(words.start) or not model.labels:
        return names, score, (none, none, none, none)
    first, h, kind = word_types(words)
    opens = np.zeros(len(kind), bool)
    opens[words.first[:-1][np.diff(words.first) > 0]] = True
    marginal = forward_backward(type_scores(model.weights, *type_features(words, first, h))[kind], model.moves, model.start, opens)[0]
    n = np.diff(words.first)
    full = np.flatnonzero(n)
    mean = np.add.reduceat(marginal.astype(np.float64), words.first[:-1][full], axis=0) / n[full][:, None]
    best = mean.argmax(1)
    for d, k, row in zip(full.tolist(), best.tolist(), mean):
        if raw[d].isascii() or any(map(str.isalpha, raw[d].decode("utf-8", "replace"))):
            names[d], score[d] = model.labels[k], min(1.0, row[k])
    label = marginal.argmax(1)
    new = opens.copy()
    new[1:] |= label[1:] != label[:-1]
    at = np.flatnonzero(new)
    return names, score, (words.doc[at], label[at], at - words.first[words.doc[at]], np.diff(np.r_[at, len(label)]))


def predict(docs: DataFrame, model: Crf, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, on request, ``lang_spans``: runs of words (from 0) of one language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": "''", "score": "0D"} | ({"lang_spans": "CAST(NULL AS array<struct<lang: string, first_word: long, n_words: long>>)"} if spans else {})
    kept = docs.drop(*added)
    names = kept.columns

    def run(batches):
        crf = shipped.value
        for part, raw in text_pieces(batches, text, 1 << 20):
            lang, score, (doc, label, first, n) = label_texts(crf, raw)
            columns = [*part.columns, pa.array(lang, pa.string()), pa.array(score)]
            if spans:
                runs = pa.StructArray.from_arrays([pa.array([crf.labels[k] for k in label.tolist()], pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["lang", "first_word", "n_words"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(raw) + 1)), pa.int32()), runs))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return kept.mapInArrow(run, kept.selectExpr("*", *(f"{v} AS {k}" for k, v in added.items())).schema)


def fold(ids: str, folds: int) -> "F.Column":
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(ids).cast("string")) % folds
