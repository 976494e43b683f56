"""Language-model scores by class-based n-grams with classes from exchange clustering (Brown et al.).

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z in lower case, then one end for each text. Words are counted over all
training texts. The most frequent words are units of their own, every other word belongs to the unit of its ending,
and the end is a unit. Exchange moves one unit after the other to the class that raises the likelihood of the class
bigrams most, over the counts of all neighbouring units (a matrix whose size parameters fix, not the corpus). This is
where ``word_classes`` begins, which gives every other word a class of its own; ``scored`` takes either model.

By units, a word's probability is P(class | class before) * P(unit | class) * P(word | unit): transitions are smoothed towards
class frequencies, units by a small constant, and the words of an ending by one added to each count and to one unseen
word. The base beside it is the unigram with the same one added.

Counts of words never meet on the driver or in a broadcast: tasks know those of the most frequent words, a list of
bounded size, and ask for all others, packed by the same buckets as the count table. Counts of a bucket and its
questions meet in one task; the answers, counts and classes, go back to the text's piece.

Words are 64-bit fingerprints.

Cases: a null or empty text is one end; rows, repeated or not, are scored row by row; rows that ``held_out`` marks
take no part in learning (null counts as false); extra columns are not read; an empty table gives an empty result;
with no training row all counts are 0.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm.words import fingerprints, split_words, text_pieces
from tallyscope.session import stored

#: Words with a unit of their own, units of endings, classes, rounds of exchange.
WORD_UNITS, ENDING_UNITS, CLASSES, ROUNDS = 2048, 1023, 48, 6
#: Buckets of the count table, words of each whose counts every task knows, entries a task gathers before it hands them on.
BUCKETS, KNOWN_PER_BUCKET, GATHERED = 256, 256, 1_500_000
UNIT_SHARE, CLASS_WEIGHT = 0.5, 20.0
#: Instead of a class: the word is in the class of its ending.
IN_ENDING = 255

_U = np.uint64


class Counts(NamedTuple):
    tokens: int
    distinct: int
    texts: int
    known: np.ndarray  # sorted fingerprints of frequent words
    known_count: np.ndarray
    own: np.ndarray  # sorted fingerprints of the words with a unit of their own
    ending_tokens: np.ndarray  # of all other words, by unit of ending
    ending_words: np.ndarray


class Model(NamedTuple):
    counts: Counts
    unit_class: np.ndarray
    move: np.ndarray  # log10 P(class | class before)
    unit: np.ndarray  # log10 P(unit | its class)
    between: np.ndarray  # class bigrams of units that are no endings
    word_share: float  # added to the count of a word without a unit of its own
    ending_share: np.ndarray  # log10 of what that sum is divided by, negative: for words in the class of their ending, by ending
    class_share: np.ndarray  # and for words with a class of their own, by class
    known_class: np.ndarray  # of the frequent words, or IN_ENDING


def tokens_of(raw: list[bytes]):
    """Words of a piece, their fingerprints and the units of their endings (the last three bytes)."""
    words = split_words(raw)
    h = fingerprints(words.data, words.start, words.end)
    tail = np.maximum(words.end - 3, words.start)
    ending = (fingerprints(words.data, tail, words.end) % _U(ENDING_UNITS)).astype(np.int64)
    return words, h, ending


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> _U(56)).astype(np.int64) % BUCKETS


def found_in(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


# --------------------------------------------------------------------------- counting
def count_table(train: DataFrame, text: str) -> DataFrame:
    """(bucket, words, n, endings): per bucket the sorted fingerprints of all words, their counts and endings."""
    def summed(h, n, ending):
        by = np.argsort(h)
        h, n, ending = h[by], n[by], ending[by]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return h[cut], np.add.reduceat(n, cut) if len(h) else n, ending[cut]

    def rows(held):
        h, n, ending = summed(*map(np.concatenate, zip(*held)))
        bucket = bucket_of(h)
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        columns = [[bytes(x.tobytes()) for x in np.split(v[by], cut[1:])] if len(cut) else [] for v in (h, n.astype(np.int64), ending.astype(np.uint16))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[by][cut]), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "words", "n", "endings"])

    def count(batches):
        held, size = [], 0
        for _, raw in text_pieces(batches, text):
            _, h, ending = tokens_of(raw)
            held.append(summed(h, np.ones(len(h), np.int64), ending))
            size += len(held[-1][0])
            if size > GATHERED:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def add(batches):
        held, current = [], None
        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and held:
                    yield rows(held)
                    held = []
                current = bucket
                held.append(tuple(np.frombuffer(v, k) for v, k in zip(parts, (_U, np.int64, np.uint16))))
                if len(held) > 64:
                    held = [summed(*map(np.concatenate, zip(*held)))]
        if held:
            yield rows(held)

    schema = "bucket long, words binary, n binary, endings binary"
    return train.select(text).mapInArrow(count, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, schema)


def counts_of(table: DataFrame, texts: int, word_units: int) -> Counts:
    """Totals, and the frequent words of every bucket; all of bounded size."""
    def sums(batches):
        for batch in batches:
            for words, n, endings in zip(*(batch.column(c).to_pylist() for c in ("words", "n", "endings"))):
                h, n, ending = np.frombuffer(words, _U), np.frombuffer(n, np.int64), np.frombuffer(endings, np.uint16)
                top = np.sort(np.lexsort((h, -n))[:KNOWN_PER_BUCKET])
                per = np.stack([np.bincount(ending, n, ENDING_UNITS), np.bincount(ending, minlength=ENDING_UNITS)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (h[top], n[top], ending[top].astype(np.uint16), per)], names=["h", "n", "ending", "per"])

    h, n, ending, per = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], np.zeros((2, ENDING_UNITS), np.int64)
    for row in table.mapInArrow(sums, "h binary, n binary, ending binary, per binary").toLocalIterator():  # one row a bucket
        h.append(np.frombuffer(row.h, _U)), n.append(np.frombuffer(row.n, np.int64)), ending.append(np.frombuffer(row.ending, np.uint16))
        per = per + np.frombuffer(row.per, np.int64).reshape(2, -1)
    h, n, ending = np.concatenate(h), np.concatenate(n), np.concatenate(ending)
    by = np.argsort(h)
    h, n, ending = h[by], n[by], ending[by]
    own = np.sort(np.lexsort((h, -n))[:word_units])
    total, distinct = int(per[0].sum()), int(per[1].sum())
    rest = per - np.stack([np.bincount(ending[own], n[own], ENDING_UNITS), np.bincount(ending[own], minlength=ENDING_UNITS)]).astype(np.int64)
    return Counts(total + texts, distinct + (texts > 0), texts, h, n, h[own], rest[0], rest[1])


def units_of(counts: Counts, words, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of all tokens of a piece, ends included, and the place of each word among them."""
    at, own = found_in(counts.own, h)
    place = np.arange(len(h)) + words.doc
    texts = len(words.first) - 1
    out = np.full(len(h) + texts, WORD_UNITS + ENDING_UNITS, np.int64)
    out[place] = np.where(own, at, WORD_UNITS + ending)
    return out, place


def unit_bigrams(train: DataFrame, text: str, counts: Counts) -> np.ndarray:
    """How often each unit follows each; every text begins after an end. The matrix has a fixed size."""
    units = WORD_UNITS + ENDING_UNITS + 1
    shipped = train.sparkSession.sparkContext.broadcast(counts)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            code, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            by = np.argsort(code)
            code, n = code[by], n[by]
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            return code[cut], np.add.reduceat(n, cut)

        for _, raw in text_pieces(batches, text):
            unit, _ = units_of(shipped.value, *tokens_of(raw))
            held.append(np.unique(np.r_[units - 1, unit[:-1]] * units + unit, return_counts=True))
            if sum(len(c) for c, _ in held) > 2 * GATHERED:
                held[:] = [merged()]
        if held:
            code, n = merged()
            block = code // (units * 64)
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(block[cut]), *(pa.array([x.tobytes() for x in np.split(v, cut[1:])], pa.binary()) for v in ((code % (units * 64)).astype(np.uint32), n.astype(np.uint32)))],
                                             names=["block", "code", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, code, n in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(block, np.zeros(units * 64, np.int64))
                total[np.frombuffer(code, np.uint32)] += np.frombuffer(n, np.uint32)
        for block, total in sums.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([code.astype(np.uint32).tobytes()], pa.binary()), pa.array([total[code].tobytes()], pa.binary())], names=["block", "code", "n"])

    schema = "block long, code binary, n binary"
    out = np.zeros((units // 64 + 1, units * 64), np.float32)
    for row in train.select(text).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        out[row.block][np.frombuffer(row.code, np.uint32)] = np.frombuffer(row.n, np.int64)
    return out.reshape(-1, units)[:units]


# --------------------------------------------------------------------------- classes
def _xlogx(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1e-300))


def exchanged(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit after exchange: units by frequency, each to the class of greatest likelihood.

    The likelihood of class bigrams is, up to a constant, sum N(a, b) log N(a, b) - sum N(a, .) log N(a, .)
    - sum N(., b) log N(., b). A unit is taken out of its class, and the gain of each class is worked out from the
    unit's counts with all classes.
    """
    total = bigrams.sum(0, dtype=np.float64) + bigrams.sum(1, dtype=np.float64)
    order = np.argsort(-total, kind="stable")
    order = order[total[order] > 0]
    label = np.zeros(len(bigrams), np.int64)
    label[order] = np.arange(len(order)) % classes
    table = np.zeros((classes, classes))
    for c in range(classes):
        rows = bigrams[label == c].sum(0, dtype=np.float64)
        table[c] = np.bincount(label, rows, classes)
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            same = float(bigrams[u, u])
            after, before = bigrams[u].astype(np.float64), bigrams[:, u].astype(np.float64)
            after[u] = before[u] = 0
            to, frm = np.bincount(label, after, classes), np.bincount(label, before, classes)
            old = label[u]
            table[old] -= to
            table[:, old] -= frm
            table[old, old] -= same
            # Gains of joining class c: row c grows by `to`, column c by `frm`, their meeting cell by both and `same`.
            row = _xlogx(table + to) - _xlogx(table)
            column = _xlogx(table + frm[:, None]) - _xlogx(table)
            gain = row.sum(1) + column.sum(0)
            diagonal = np.arange(classes)
            gain += _xlogx(table[diagonal, diagonal] + to + frm + same) - _xlogx(table[diagonal, diagonal]) - row[diagonal, diagonal] - column[diagonal, diagonal]
            out, into = table.sum(1) + frm, table.sum(0) + to  # whatever its class, others lead to it and follow it
            gain -= _xlogx(out + to.sum() + same) - _xlogx(out) + _xlogx(into + frm.sum() + same) - _xlogx(into)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            label[u] = new
            table[new] += to
            table[:, new] += frm
            table[new, new] += same
        if not moved:
            break
    return label


def fitted(counts: Counts, bigrams: np.ndarray) -> Model:
    label = exchanged(bigrams)
    into = bigrams.sum(0, dtype=np.float64)
    size = np.bincount(label, minlength=CLASSES)
    unit = np.log10((into + UNIT_SHARE) / (np.bincount(label, into, CLASSES) + UNIT_SHARE * size)[label])
    ending = unit[WORD_UNITS:-1] - np.log10((counts.ending_tokens + counts.ending_words + 1).astype(np.float64))
    whole = np.ones(len(label), bool)
    whole[WORD_UNITS:-1] = False
    between = class_bigrams(bigrams[whole][:, whole], label[whole]).astype(np.int64)
    return Model(counts, label, transitions(class_bigrams(bigrams, label)), unit, between, 1.0, ending, np.zeros(CLASSES), np.full(len(counts.known), IN_ENDING, np.uint8))


def class_bigrams(bigrams: np.ndarray, label: np.ndarray) -> np.ndarray:
    table = np.zeros((CLASSES, CLASSES))
    for c in range(CLASSES):
        table[c] = np.bincount(label, bigrams[label == c].sum(0, dtype=np.float64), CLASSES)
    return table


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)"""
    share = (table.sum(0) + 1) / (table.sum() + CLASSES)
    return np.log10((table + CLASS_WEIGHT * share) / (table.sum(1, keepdims=True) + CLASS_WEIGHT))


def training(docs: DataFrame, held_out: Column, text: str) -> DataFrame:
    return docs.where(~F.coalesce(held_out, F.lit(False))).select(text)


def learn(docs: DataFrame, held_out: Column, text: str = "text") -> tuple[Model, DataFrame]:
    """The model by units of the rows that are not held out, and the stored table of all their words' counts."""
    train = training(docs, held_out, text)
    table = stored(count_table(train, text))
    counts = counts_of(table, train.count(), WORD_UNITS)
    return fitted(counts, unit_bigrams(train, text, counts)), table


# --------------------------------------------------------------------------- scoring
def scored(docs: DataFrame, held_out: Column, model: Model, table: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """(ids, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10 probabilities.

    ``table`` has the classes of its words, or all are in those of their endings.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def local(batches):
        """One row for each piece with what is known here (bucket -1), and the words it asks for, a row for each bucket.

        Of the classes of all tokens only those of asked words, a mark, and of their neighbours are kept.
        """
        m = shipped.value
        c = m.counts
        base_all = np.log10(float(c.tokens + c.distinct + 1))
        for part, raw in text_pieces(batches, text):
            piece = uuid.uuid4().int >> 65
            words, h, ending = tokens_of(raw)
            unit, place = units_of(c, words, h, ending)
            texts = len(raw)
            owner = np.zeros(len(unit), np.int64)
            owner[place] = words.doc
            ends = np.ones(len(unit), bool)
            ends[place] = False
            owner[ends] = np.arange(texts)
            at, known = found_in(c.known, h)
            n = np.where(known, c.known_count[at] if len(c.known) else 0, 0)
            klass = m.unit_class[unit]
            further = known & (unit[place] >= WORD_UNITS)
            labelled = further & (m.known_class[at] != IN_ENDING) if len(c.known) else further
            klass[place[labelled]] = m.known_class[at[labelled]]
            chain = m.unit[unit]
            chain[place[further]] = np.log10(n[further] + m.word_share) + np.where(labelled, m.class_share[klass[place]], m.ending_share[ending])[further]
            asked = np.zeros(len(unit), bool)
            asked[place[~known]] = True
            behind, before = np.r_[False, asked[:-1]], np.r_[asked[1:], False]
            here = ~(asked | behind)
            chain[asked] = 0
            chain[here] += m.move[np.r_[m.unit_class[-1], klass[:-1]][here], klass[here]]
            base = np.bincount(words.doc, np.where(known, np.log10(n + 1.0), 0), texts) + np.log10(c.texts + 1.0) - (np.diff(words.first) + 1) * base_all
            seen = np.bincount(words.doc, known & (n > 0), texts).astype(np.int64) + (c.texts > 0)
            numbers = np.stack([np.diff(words.first) + 1, seen]).astype(np.int64)
            word, slot = np.unique(h[~known], return_inverse=True)
            bucket = bucket_of(word)
            by = np.argsort(bucket, kind="stable")
            word, bucket, slot = word[by], bucket[by], np.argsort(by)[slot]
            word_ending = np.zeros(len(word), np.uint16)
            word_ending[slot] = ending[~known]
            klass[asked] = IN_ENDING
            kept = asked | behind | before
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            first = [pa.array(part.column(ids)).cast(pa.int64()).fill_null(0).to_numpy(), np.r_[part.column(ids).is_valid().to_numpy(zero_copy_only=False), part.column("held_out").to_numpy(zero_copy_only=False)],
                     numbers, np.stack([base, np.bincount(owner, chain, texts)]), np.bincount(owner[kept], minlength=texts).astype(np.uint32), klass[kept].astype(np.uint8), slot.astype(np.uint32), word_ending]
            asks = [x.tobytes() for x in np.split(word, cut[1:])] if len(cut) else []
            columns = [[first[0].tobytes(), *asks], *([v.tobytes()] + [None] * len(cut) for v in first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([piece] * (len(cut) + 1), pa.int64()), pa.array([-1, *bucket[cut].tolist()], pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names=["piece", "bucket", *"abcdefgh"])

    def answer(batches):
        """Counts and classes of the asked words."""
        current, held, ready = None, [], False
        h, n, klass = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for batch in batches:
            for piece, bucket, a, b, c in zip(*(col.to_pylist() for col in batch.columns[:5])):
                if bucket != current:
                    current, held, ready = bucket, [], False
                if piece is None:  # the bucket's counts come before what is asked
                    words = np.frombuffer(a, _U)
                    held.append((words, np.frombuffer(b, np.int64), np.full(len(words), IN_ENDING, np.uint8) if c is None else np.frombuffer(c, np.uint8)))
                    continue
                if not ready:
                    h, n, klass = map(np.concatenate, zip(*held)) if held else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint8))
                    by = np.argsort(h)
                    h, n, klass, held, ready = h[by], n[by], klass[by], [], True
                at, there = found_in(h, np.frombuffer(a, _U))
                count, own = np.zeros(len(at), np.int64), np.full(len(at), IN_ENDING, np.uint8)
                count[there], own[there] = n[at[there]], klass[at[there]]
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([bucket]), pa.array([count.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 6], names=["piece", "bucket", *"abcdefgh"])

    train_tokens = model.counts.tokens
    names = [ids, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def whole(batches):
        rows, answers = None, []
        for batch in batches:
            for _, bucket, *row in zip(*(col.to_pylist() for col in batch.columns)):
                if bucket == -1:
                    if rows is not None:
                        yield finished(rows, answers)
                    rows, answers = row, []
                else:
                    answers.append(row)
        if rows is not None:
            yield finished(rows, answers)

    def finished(rows, answers):
        m = shipped.value
        own, flags, numbers, sums, many, klass, slot, ending = (np.frombuffer(v, k) for v, k in zip(rows, (np.int64, bool, np.int64, np.float64, np.uint32, np.uint8, np.uint32, np.uint16)))
        texts = len(own)
        (valid, held), (tokens, known), (base, score) = flags.reshape(2, -1), numbers.reshape(2, -1), sums.reshape(2, -1)
        if answers:
            n = np.frombuffer(b"".join(a[0] for a in answers), np.int64)
            word_class = np.frombuffer(b"".join(a[1] for a in answers), np.uint8).astype(np.int64)
            in_ending = word_class == IN_ENDING
            word_class = np.where(in_ending, m.unit_class[WORD_UNITS + ending.astype(np.int64)], word_class)
            share = np.where(in_ending, m.ending_share[ending], m.class_share[word_class])
            asked = klass == IN_ENDING
            klass = klass.astype(np.int64)
            klass[asked] = word_class[slot]
            doc = np.repeat(np.arange(texts), many)
            chain = np.zeros(len(klass))
            chain[asked] = (np.log10(n + m.word_share) + share)[slot]
            there = asked | np.r_[False, asked[:-1]]
            chain[there] += m.move[np.r_[m.unit_class[-1], klass[:-1]][there], klass[there]]
            score = score + np.bincount(doc, chain, texts)
            base = base + np.bincount(doc[asked], np.log10(n + 1.0)[slot], texts)
            known = known + np.bincount(doc[asked], (n > 0)[slot], texts).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own, mask=~valid), pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(texts, train_tokens, np.int64)), pa.array(base), pa.array(score)], names=names)

    packed = "piece long, bucket long, " + ", ".join(f"{c} binary" for c in "abcdefgh")
    source = docs.select(F.col(ids).cast("long").alias(ids), text, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    pieces = stored(source.mapInArrow(local, packed))
    nothing = "CAST(NULL AS binary) AS"
    classes = "classes AS" if "classes" in table.columns else nothing
    counts = table.selectExpr("CAST(NULL AS long) AS piece", "bucket", "words AS a", "n AS b", f"{classes} c", *(f"{nothing} {c}" for c in "defgh"))
    asked = pieces.where("bucket >= 0").union(counts).repartition("bucket").sortWithinPartitions("bucket", F.col("piece").asc_nulls_first())
    together = pieces.where("bucket = -1").union(asked.mapInArrow(answer, packed)).repartition("piece").sortWithinPartitions("piece", "bucket")
    return together.mapInArrow(whole, f"{ids} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
