"""Classes of their own for all words, by exchange in parallel rounds (Uszkoreit & Brants).

The units of ``class_ngrams`` are exchanged one after the other; here every other word of the training texts begins in
the class of its ending and is then exchanged by itself, however rare it is. In a round all words move at once: each is
taken out of its class and goes to the class that raises the likelihood of the class bigrams most, by its counts with
the classes of all its neighbours as they were before the round and the table of class bigrams at that time. A round
that lowers the likelihood is dropped, and half as many words move from then on. Rounds end when no word moves, or after
``ROUNDS``.

Words are dealt to groups by the leading bits of their fingerprints, so many that a group stays small. A group holds for
each of its words the counts with classes of units, which stay, and with neighbours that move too. Neighbours of another
group are known by their place only: both groups have the pair, so each sends the other one byte, the class, for every
word of its own that the other one meets, in the order of fingerprints. No list of all words is collected or broadcast;
the driver sees class bigrams and the classes of the words that all tasks know.

A word's probability is P(class | class before) * P(word | class). A word that was not seen in training has the class of
its ending, and for each ending one unseen word shares in its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm import class_ngrams as units
from tallyscope.llm.class_ngrams import CLASSES, ROUNDS, UNIT_SHARE, Model, _xlogx, bucket_of, found_in, tokens_of, training, transitions, units_of
from tallyscope.llm.words import text_pieces
from tallyscope.session import stored, swept

#: Training tokens for each group, places a task gathers before it hands them on, words whose gains are worked out together.
GROUP_TOKENS, GATHERED, TOGETHER = 4_000_000, 2_000_000, 2048
#: Least bits of a fingerprint that name its group.
GROUP_BITS = 8
#: Counts up to here have their gains in a list.
LISTED = 16
#: Codes of a word's counts: class before, ``CLASSES`` + class behind, itself behind, a moving word before, one behind.
SAME, BEFORE, BEHIND = 2 * CLASSES, 2 * CLASSES + 1, 2 * CLASSES + 2
#: Values of places: classes of units, a word behind itself, then words.
_ITSELF, _WORDS = 127, 128
#: What a row of a group holds: its counts, its classes; classes sent by group ``source`` are 0 or more.
_COUNTS, _CLASSES = -2, -1

_U = np.uint64
_ROW = "grp long, source long, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["grp", "source", "a", "b", "c", "d", "e", "f"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (group, source, up to six arrays)."""
    whole = [(*r[:2], *(v.tobytes() for v in r[2:]), *[None] * (8 - len(r))) for r in rows]
    columns = list(zip(*whole)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names=_NAMES)


def split_at(v: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return np.split(v, at[1:]) if len(at) else []


# --------------------------------------------------------------------------- counts with neighbours
def vocabulary(table: DataFrame, model: Model, bits: int) -> DataFrame:
    """Per group the words without a unit of their own: fingerprints, counts, classes of their endings."""
    shipped = table.sparkSession.sparkContext.broadcast((model.counts.own, model.unit_class[units.WORD_UNITS:].astype(np.uint8)))

    def split(batches):
        own, of_ending = shipped.value
        for batch in batches:
            for words, n, endings in zip(*(batch.column(c).to_pylist() for c in ("words", "n", "endings"))):
                h, n, ending = np.frombuffer(words, _U), np.frombuffer(n, np.int64), np.frombuffer(endings, np.uint16)
                moving = ~found_in(own, h)[1]
                h, n, klass = h[moving], n[moving], of_ending[ending[moving]]
                group = (h >> _U(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.diff(group, prepend=-1))
                yield batch_of([(g, _CLASSES, *v) for g, *v in zip(group[cut].tolist(), *(split_at(x, cut) for x in (h, n, klass)))])

    return table.mapInArrow(split, _ROW)


def neighbours(train: DataFrame, text: str, model: Model, bits: int) -> DataFrame:
    """Per group and handful of texts: words, how many counts each has, their codes, the counts, and the words meant by BEFORE and BEHIND."""
    shipped = train.sparkSession.sparkContext.broadcast(model)

    def rows(held, end):
        starts = np.cumsum([0] + [len(k) for k, _, _ in held])
        at = np.concatenate([p + s for (_, p, _), s in zip(held, starts)])
        words, number = np.unique(np.concatenate([h for _, _, h in held]), return_inverse=True)
        value = np.concatenate([k for k, _, _ in held])
        value[at] = _WORDS + number
        left, right, me = np.r_[end, value[:-1]][at], value[at + 1], value[at]
        number = number.astype(np.int64) << 33
        key, n = np.unique(np.r_[(number | left)[left != me], number | (1 << 32) | np.where(right == me, _ITSELF, right)], return_counts=True)
        side, value = key >> 32 & 1, key & 0xFFFFFFFF
        other = value >= _WORDS
        code = np.where(other, BEFORE + side, np.where(value == _ITSELF, SAME, side * CLASSES + value)).astype(np.uint8)
        many = np.bincount(key >> 33, minlength=len(words))
        group = (words >> _U(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        of_word, of_other = np.r_[0, np.cumsum(many)][cut], np.r_[0, np.cumsum(other)]
        columns = [split_at(words, cut), split_at(many.astype(np.uint32), cut), split_at(code, of_word), split_at(n.astype(np.uint32), of_word), split_at(words[value[other] - _WORDS], of_other[of_word])]
        return batch_of([(g, _COUNTS, *v) for g, *v in zip(group[cut].tolist(), *columns)])

    def count(batches):
        m, held, size = shipped.value, [], 0
        end = int(m.unit_class[-1])
        for _, raw in text_pieces(batches, text):
            words, h, ending = tokens_of(raw)
            unit, place = units_of(m.counts, words, h, ending)
            moving = unit[place] >= units.WORD_UNITS
            held.append((m.unit_class[unit], place[moving], h[moving]))
            size += len(unit)
            if size > GATHERED:
                yield rows(held, end)
                held, size = [], 0
        if held:
            yield rows(held, end)

    return train.select(text).mapInArrow(count, _ROW)


def sent(group: int, klass: np.ndarray, to: np.ndarray, many: np.ndarray, which: np.ndarray) -> list[tuple]:
    """A group's classes, and those that other groups are sent."""
    klass = klass.astype(np.uint8)
    return [(group, _CLASSES, klass), *((t, group, v) for t, v in zip(to.tolist(), np.split(klass[which], np.cumsum(many)[:-1])))]


def grouped(words: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """Per group its counts, summed, and its first classes with what is sent of them."""
    def built(group, h, klass, parts):
        word, code, n, other = [], [], [], []
        for words, many, codes, ns, others in parts:
            word.append(np.repeat(np.searchsorted(h, words), many)), code.append(codes), n.append(ns), other.append(others)
        word, code, n, other = (np.concatenate(x) for x in (word, code, n, other))
        met, place = np.unique(other, return_inverse=True)
        slot = np.zeros(len(word), np.int64)
        slot[code >= BEFORE] = place
        key = word.astype(np.int64) << 40 | code.astype(np.int64) << 32 | slot
        by = np.argsort(key)
        key, n = key[by], n[by]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[cut], np.add.reduceat(n, cut, dtype=np.uint64)
        word, code, slot = key >> 40, (key >> 32 & 255).astype(np.uint8), key & 0xFFFFFFFF
        moving = code >= BEFORE
        give = np.unique((met >> _U(64 - bits)).astype(np.int64)[slot[moving]] << 32 | word[moving])
        to, many = np.unique(give >> 32, return_counts=True)
        which = (give & 0xFFFFFFFF).astype(np.uint32)
        counts = (np.bincount(word, minlength=len(h)).astype(np.uint32), code, n.astype(np.min_scalar_type(n.max())), slot[moving].astype(np.uint32), np.stack([to, many]).astype(np.uint32), which)
        return batch_of([(group, _COUNTS, *counts), *sent(group, klass, to, many, which)])

    def build(batches):
        current, h, klass, parts = None, None, None, []
        for batch in batches:
            for group, source, a, b, c, d, e, _ in zip(*(col.to_pylist() for col in batch.columns)):
                if group != current:
                    if current is not None:
                        yield built(current, h, klass, parts)
                    current, parts = group, []
                if source == _CLASSES:
                    h, klass = np.frombuffer(a, _U), np.frombuffer(c, np.uint8)
                else:
                    parts.append([np.frombuffer(v, k) for v, k in zip((a, b, c, d, e), (_U, np.uint32, np.uint8, np.uint32, _U))])
        if current is not None:
            yield built(current, h, klass, parts)

    return words.union(counts).repartition("grp").sortWithinPartitions("grp", F.col("source").desc()).mapInArrow(build, _ROW)


# --------------------------------------------------------------------------- rounds
def lists(table: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For words behind and words before: cells[b, c] that grow if a word with class b there joins class c, x log x of
    them, how much that grows with counts up to ``LISTED``, sums over b, and the same of them."""
    few, out = np.arange(LISTED + 1.0)[:, None], []
    for cells in (np.ascontiguousarray(table.T), table):
        logs, total = _xlogx(cells), cells.sum(0)
        out.append((cells, logs, _xlogx(cells + few[:, None]) - logs, total, _xlogx(total + few) - _xlogx(total)))
    return out


def gains(counts: np.ndarray, old: np.ndarray, table: np.ndarray, listed: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """How much the likelihood of class bigrams gains with each word (row) in each class, over having it in none.

    ``counts`` are those with classes before, classes behind and the word itself; ``old`` are the classes that the words
    still have in ``table``. As in ``class_ngrams.exchanged``, but only cells where a word has counts are worked out.
    """
    rows = np.arange(len(old))
    before, behind, same = counts[:, :CLASSES], counts[:, CLASSES:SAME], counts[:, SAME]
    out = np.zeros((len(old), CLASSES))
    for here, there, (cells, logs, grown, total, total_grown) in ((behind, before, listed[0]), (before, behind, listed[1])):
        word, b = np.nonzero(here)
        n, mine = here[word, b], old[word]
        own, few = b == mine, n <= LISTED
        more = grown[np.where(few, n, 0).astype(np.int64), b]
        many = np.flatnonzero(~few & ~own)
        more[many] = _xlogx(cells[b[many]] + n[many, None]) - logs[b[many]]
        inside = np.flatnonzero(own)  # its old class has lost it
        base = cells[b[inside]] - there[word[inside]]
        more[inside] = _xlogx(base + n[inside, None]) - _xlogx(base)
        left = cells[b, mine] - n - own * (there[word, b] + same[word])
        more[np.arange(len(word)), mine] = _xlogx(left + n) - _xlogx(left)
        cut = np.flatnonzero(np.diff(word, prepend=-1))
        if len(cut):
            out[word[cut]] += np.add.reduceat(more, cut)
        size = here.sum(1) + same
        few = size <= LISTED
        less = total_grown[np.where(few, size, 0).astype(np.int64)]
        less[~few] = _xlogx(total + size[~few, None]) - _xlogx(total)
        left = total[old] - size
        less[rows, old] = _xlogx(left + size) - _xlogx(left)
        out -= less
    # The cell where a class meets itself grows by both sides and the word behind itself.
    word, c = np.nonzero(((before > 0) & (behind > 0)) | (same > 0)[:, None])
    cell = table[c, c] - (c == old[word]) * (before[word, c] + behind[word, c] + same[word])
    out[word, c] += _xlogx(cell + before[word, c] + behind[word, c] + same[word]) + _xlogx(cell) - _xlogx(cell + behind[word, c]) - _xlogx(cell + before[word, c])
    return out


def groups_of(batches):
    """(group, entries of each word, codes, counts, places of neighbours, receivers, what they get, own classes, neighbours' classes)."""
    current, counts, klass, others = None, None, None, []

    def whole():
        width = len(counts[2]) // len(counts[1])  # of the largest count
        many, code, n, slot, to, which = (np.frombuffer(v, k) for v, k in zip(counts, (np.uint32, np.uint8, f"u{width}", np.uint32, np.uint32, np.uint32)))
        return current, many, code, n, slot, to.reshape(2, -1), which, np.frombuffer(klass, np.uint8).astype(np.int64), np.frombuffer(b"".join(others), np.uint8)

    for batch in batches:
        for group, source, *row in zip(*(col.to_pylist() for col in batch.columns)):
            if group != current:
                if current is not None:
                    yield whole()
                current, others = group, []
            if source == _COUNTS:
                counts = row
            elif source == _CLASSES:
                klass = row[0]
            else:
                others.append(row[0])
    if current is not None:
        yield whole()


def together(counts: DataFrame, state: DataFrame) -> DataFrame:
    """A group's counts, its classes and what it is sent, in the order of its neighbours."""
    return counts.union(state).repartition("grp").sortWithinPartitions("grp", "source")


def class_table(counts: DataFrame, state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams with at least one moving word, and the number of moving words in each class."""
    cells = CLASSES * CLASSES

    def count(batches):
        out = np.zeros(cells + CLASSES, np.int64)
        for _, many, code, n, slot, _, _, klass, others in groups_of(batches):
            mine = np.repeat(klass, many)
            n, code = n.astype(np.float64), code.astype(np.int64)
            cell = np.full(len(n), -1, np.int64)
            behind = np.flatnonzero((code >= CLASSES) & (code < SAME))
            cell[behind] = mine[behind] * CLASSES + code[behind] - CLASSES
            before = np.flatnonzero(code < CLASSES)
            cell[before] = code[before] * CLASSES + mine[before]
            same = np.flatnonzero(code == SAME)
            cell[same] = mine[same] * (CLASSES + 1)
            moving = code[code >= BEFORE] == BEHIND  # a pair of moving words counts where the first one is
            pair = np.flatnonzero(code == BEHIND)
            cell[pair] = mine[pair] * CLASSES + others[slot[moving]]
            used = cell >= 0
            out[:cells] += np.bincount(cell[used], n[used], cells).astype(np.int64)
            out[cells:] += np.bincount(klass, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    def add(batches):
        out = np.zeros(cells + CLASSES, np.int64)
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                out += np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    found = together(counts, state).mapInArrow(count, "sums binary").repartition(1).mapInArrow(add, "sums binary").collect()
    out = sum((np.frombuffer(r.sums, np.int64) for r in found), np.zeros(cells + CLASSES, np.int64))
    return out[:cells].reshape(CLASSES, CLASSES), out[cells:]


def moved(counts: DataFrame, state: DataFrame, table: np.ndarray, every: int = 1, turn: int = 0) -> DataFrame:
    """All words after one round, with what is sent of their classes; in ``turn``, one word of ``every`` moves."""
    table = table.astype(np.float64)

    def move(batches):
        listed = lists(table)
        for group, many, code, n, slot, to, which, klass, others in groups_of(batches):
            code = code.astype(np.int64)
            moving = np.flatnonzero(code >= BEFORE)
            code[moving] = (code[moving] - BEFORE) * CLASSES + others[slot]
            first = np.r_[0, np.cumsum(many.astype(np.int64))]
            new = klass.copy()
            for begin in range(0, len(klass), TOGETHER):
                end = min(begin + TOGETHER, len(klass))
                part = slice(first[begin], first[end])
                word = np.repeat(np.arange(end - begin), many[begin:end])
                cells = np.bincount(word * (SAME + 1) + code[part], n[part].astype(np.float64), (end - begin) * (SAME + 1)).reshape(-1, SAME + 1)
                old = klass[begin:end]
                gain = gains(cells, old, table, listed)
                rows = np.arange(end - begin)
                spread = (group + begin + rows) * 29 // 3
                turned = (np.arange(CLASSES) + spread[:, None]) % CLASSES  # among equals words choose differently, or they would stay together
                best = turned[rows, np.take_along_axis(gain, turned, 1).argmax(1)]
                goes = (gain[rows, best] > gain[rows, old] + 1e-9) & ((spread + turn) % every == 0)
                new[begin:end] = np.where(goes, best, old)
            yield batch_of(sent(group, new, *to, which))

    return together(counts, state).mapInArrow(move, _ROW)


def likelihood(table: np.ndarray) -> float:
    table = table.astype(np.float64)
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchanged(counts: DataFrame, state: DataFrame, fixed: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The state after the rounds, its class bigrams, ``fixed`` ones of units included, and moving words by class."""
    spark = counts.sparkSession
    table, size = class_table(counts, state)
    every = 1
    for turn in range(rounds):
        swept(spark)
        after = stored(moved(counts, state, fixed + table, every, turn))
        new, new_size = class_table(counts, after)
        if likelihood(fixed + new) < likelihood(fixed + table):
            every *= 2  # words that moved together were in each other's way
            continue
        done = every == 1 and np.array_equal(new, table) and np.array_equal(new_size, size)
        state, table, size = after, new, new_size
        if done:
            break
    return state, fixed + table, size


# --------------------------------------------------------------------------- model
def exchange_words(docs: DataFrame, held_out: Column, model: Model, table: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model in which every training word has a class of its own, and the stored table of words, counts and classes."""
    spark = docs.sparkSession
    bits = GROUP_BITS + int(np.ceil(np.log2(max(1.0, model.counts.tokens / (GROUP_TOKENS << GROUP_BITS)))))
    words = vocabulary(table, model, bits)
    swept(spark)
    all_rows = stored(grouped(words, neighbours(training(docs, held_out, text), text, model, bits), bits))
    counts, state = all_rows.where(F.col("source") == _COUNTS), all_rows.where(F.col("source") != _COUNTS)
    state, bigrams, size = exchanged(counts, state, model.between)

    def label(batches):
        """The words of a group come behind their classes."""
        klass = None
        for batch in batches:
            for known, a, b in zip(batch.column("source").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if known == _CLASSES:
                    klass = a
                else:
                    bucket = int(bucket_of(np.frombuffer(a[:8], _U))[0])
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), *(pa.array([v], pa.binary()) for v in (a, b, klass))], names=["bucket", "words", "n", "classes"])

    ordered = state.where(F.col("source") == _CLASSES).union(words.withColumn("source", F.lit(0).cast("long"))).repartition("grp").sortWithinPartitions("grp", "source")
    labelled = stored(ordered.mapInArrow(label, "bucket long, words binary, n binary, classes binary"))
    shipped = spark.sparkContext.broadcast(model.counts.known)

    def frequent(batches):
        for batch in batches:
            for words, classes in zip(batch.column("words").to_pylist(), batch.column("classes").to_pylist()):
                h = np.frombuffer(words, _U)
                known = found_in(shipped.value, h)[1]
                yield pa.RecordBatch.from_arrays([pa.array([v[known].tobytes()], pa.binary()) for v in (h, np.frombuffer(classes, np.uint8))], names=["words", "classes"])

    known_class = model.known_class.copy()
    for row in labelled.mapInArrow(frequent, "words binary, classes binary").collect():  # of words that all tasks know
        known_class[found_in(model.counts.known, np.frombuffer(row.words, _U))[0]] = np.frombuffer(row.classes, np.uint8)

    c = model.counts
    own_n = c.known_count[found_in(c.known, c.own)[0]] if len(c.own) else np.zeros(0, np.int64)
    n = np.zeros(len(model.unit_class))
    n[:len(own_n)], n[-1] = own_n, c.texts
    there = np.r_[np.arange(len(own_n)), np.arange(units.WORD_UNITS, len(n))]
    size = size + np.bincount(model.unit_class[there], minlength=CLASSES)
    share = -np.log10(np.maximum(bigrams.sum(0) + UNIT_SHARE * size, UNIT_SHARE))
    unit = np.log10(n + UNIT_SHARE) + share[model.unit_class]
    ending = share[model.unit_class[units.WORD_UNITS:-1]]
    return Model(c, model.unit_class, transitions(bigrams), unit, model.between, UNIT_SHARE, ending, share, known_class), labelled
