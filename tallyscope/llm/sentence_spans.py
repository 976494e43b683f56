"""Substring deduplication by sliding sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` before white space, at a line feed, or with the text; its words are
``[^\x20\x09-\x0D]+`` with A-Z in lower case, and pieces without words are no sentences. Every run of ``span``
consecutive sentences with ``least_words`` words or more is hashed. So is every shorter run of
``span * least_words`` words or more, and a whole text of fewer sentences with ``least_words`` words. All
runs of all texts meet by their hash. The first place of a run, in the order of (id, text fingerprint, sentence), nulls
last, stays; the sentences that any other place covers go.

Fingerprints of runs are shuffled first, packed; those that stand in one place end there. The places of the others are
gathered per piece of text, so a run that a third of all texts hold sends one row from each piece. Runs and texts are
64-bit fingerprints (runs together with their number of words).

Cases: a null text stays null; empty or blank texts have no sentences and stay; rows with equal id and text are one
document and get the same result; null ids come last; rows and other columns are kept (a column with a result's name
is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.rarity import bit_blocks, flagged
from tallyscope.llm.words import fingerprints, free_name, mixed, split_words, text_pieces
from tallyscope.session import stored

#: Sentences of a run and the words it needs at least, which keeps chance repeats of short sentences.
SPAN, LEAST_WORDS = 3, 12
FLAG_BITS = 1 << 24

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[0x21, 0x2E, 0x3F]] = True


def sentences(raw: list[bytes]):
    """Per sentence: its text, first byte, byte after it (in its own text), words and fingerprint."""
    words = split_words(raw)
    none = np.zeros(0, np.int64)
    if not len(words.start):
        return none, none, none, none, np.zeros(0, _U), words
    line_end = np.cumsum(words.data == 10)
    # A word opens a sentence if its text or line begins there or the word before closes one.
    opens = np.ones(len(words.start), bool)
    opens[1:] = _BREAK[words.data[words.end[:-1] - 1]] | (line_end[words.start[1:]] != line_end[words.start[:-1]])
    at = np.flatnonzero(opens)
    n = np.diff(np.r_[at, len(opens)])
    h = fingerprints(words.data, words.start, words.end)
    place = np.arange(len(opens)) - np.repeat(at, n)
    prints = mixed(np.add.reduceat(mixed(h + mixed(place.astype(_U) + _U(1))), at) + n.astype(_U))
    doc = words.doc[at]
    base = np.cumsum([0] + [len(r) + 1 for r in raw])[doc]
    return doc, words.start[at] - base, words.end[at + n - 1] - base, n, prints, words


def spans_of(doc: np.ndarray, n: np.ndarray, prints: np.ndarray, span: int, least_words: int):
    """(first sentence, sentences, fingerprint) of the runs: ``span`` sentences, or fewer that have the words alone.

    A run of fewer sentences is taken where it has ``least_words`` * ``span`` words, so that passages of long
    sentences, which no chance repeats, go whole even beside changed neighbours; and where a text has no more sentences.
    """
    first, length, out = [], [], []
    total = len(doc)
    per_text = np.bincount(doc, minlength=doc.max() + 1 if total else 0)[doc] if total else doc
    run, words = np.zeros(total, _U), np.zeros(total, np.int64)
    for k in range(1, span + 1):
        last = np.arange(total) + k - 1
        ok = last < total
        ok[ok] = doc[last[ok]] == doc[np.flatnonzero(ok)]
        at = np.flatnonzero(ok)
        run[at] = mixed(run[at] * _U(0xC2B2AE3D27D4EB4F) + prints[at + k - 1])
        words[at] += n[at + k - 1]
        if k < span:
            at = at[(words[at] >= least_words * span) | ((per_text[at] == k) & (words[at] >= least_words))]
        else:
            at = at[words[at] >= least_words]
        first.append(at), length.append(np.full(len(at), k)), out.append(mixed(run[at] + words[at].astype(_U)))
    return np.concatenate(first), np.concatenate(length), np.concatenate(out)


def repeated_runs(docs: DataFrame, text: str, span: int, least_words: int) -> DataFrame:
    """(run) of the runs that stand in two places or more: packed fingerprints, dealt by their upper bits."""
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def runs(batches):
        for _, raw in text_pieces(batches, text):
            doc, _, _, n, prints, _ = sentences(raw)
            run, times = np.unique(spans_of(doc, n, prints, span, least_words)[2], return_counts=True)
            run = np.sort(np.concatenate([run, run[times > 1]]))  # twice is enough to say that it repeats
            bucket = (run >> _U(32)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[by][cut]), pa.array([x.tobytes() for x in np.split(run[by], cut[1:])] if len(cut) else [], pa.binary())], names=["bucket", "runs"])

    def repeated(batches):
        current, held = None, []

        def found():
            run, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(run[times > 1].view(np.int64))], names=["run"])

        for batch in batches:
            for bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and held:
                    yield found()
                    held = []
                current = bucket
                held.append(np.frombuffer(packed, _U))
        if held:
            yield found()

    packed = docs.select(text).mapInArrow(runs, "bucket long, runs binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "run long")


def repeated_sentences(docs: DataFrame, ids: str, text: str, span: int, least_words: int) -> DataFrame:
    """(id, print, first, length) of all places of runs but the first of each."""
    repeats = stored(repeated_runs(docs, text, span, least_words))
    flags = docs.sparkSession.sparkContext.broadcast(bit_blocks(repeats, FLAG_BITS))

    def places(batches):
        for part, raw in text_pieces(batches):
            doc, _, _, n, prints, _ = sentences(raw)
            first, length, run = spans_of(doc, n, prints, span, least_words)
            keep = flagged(flags.value, run)
            first, length, run = first[keep], length[keep], run[keep]
            number = first - np.searchsorted(doc, doc[first])
            by = np.argsort(run, kind="stable")
            cut = np.flatnonzero(np.r_[True, run[by][1:] != run[by][:-1]]) if len(by) else np.zeros(0, np.int64)
            rows = pa.array(doc[first[by]])
            own = part.column("id").take(rows)
            found = pa.StructArray.from_arrays([own.is_null(), own, part.column("print").take(rows), pa.array(number[by].astype(np.int32)), pa.array(length[by].astype(np.int32))],
                                               names=["none", "id", "print", "first", "length"])
            yield pa.RecordBatch.from_arrays([pa.array(run[by[cut]].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[cut, len(by)], pa.int32()), found)], names=["run", "places"])

    place = "none: boolean, id: long, print: long, first: int, length: int"
    source = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    packed = stored(source.mapInArrow(places, f"run long, places array<struct<{place}>>"))
    # A row for each run and piece: even the most frequent run has few.
    firsts = packed.groupBy("run").agg(F.sum(F.size("places")).alias("m"), F.min(F.array_min("places")).alias("least")).where("m > 1").select("run", "least")
    joined = packed.join(stored(firsts), "run").select(F.explode("places").alias("at"), "least")
    # Rows of equal id and text are one document.
    return joined.where("at != least").select("at.id", "at.print", "at.first", "at.length")


def dedup_spans(docs: DataFrame, ids: str = "doc_id", text: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the sentences that repeat elsewhere before, and the long columns n_sentences and n_removed.

    Removed sentences leave with the white space before them; what else stands between sentences stays.
    """
    gone = repeated_sentences(docs, ids, text, span, least_words).groupBy("id", "print").agg(F.collect_set(F.struct("first", "length")).alias("gone"))
    own, print_, gone_ = (free_name(docs, stem) for stem in ("_id", "_print", "_gone"))
    gone = stored(gone).select(F.col("id").alias(own), F.col("print").alias(print_), F.col("gone").alias(gone_))
    kept = docs.drop("n_sentences", "n_removed")
    names = kept.columns
    joined = kept.join(gone, F.col(ids).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(print_)), "left").select(*[kept[c] for c in names], gone_)

    def rewrite(batches):
        for part, raw in text_pieces(batches, text):
            doc, begin, end, _, _, _ = sentences(raw)
            cut = np.searchsorted(doc, np.arange(len(raw) + 1))
            valid, new, removed = part.column(text).is_valid().to_pylist(), [], []
            for row, goes in enumerate(part.column(gone_).to_pylist()):
                value, out = raw[row], set()
                for g in goes or ():
                    out.update(range(g["first"], g["first"] + g["length"]))
                if out:
                    b, e = begin[cut[row]:cut[row + 1]].tolist(), end[cut[row]:cut[row + 1]].tolist()
                    parts, at = [], 0
                    for k in sorted(out):  # from the end of the sentence before to its own
                        before = e[k - 1] if k else 0
                        parts.append(value[at:max(at, before)])
                        at = e[k]
                    value = b"".join([*parts, value[at:]])
                new.append(value.decode() if valid[row] else None)
                removed.append(len(out))
            columns = [pa.array(new, pa.string()) if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cut), pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_sentences", "n_removed"])

    return joined.mapInArrow(rewrite, kept.selectExpr("*", "0L AS n_sentences", "0L AS n_removed").schema)
