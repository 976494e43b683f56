"""Benchmark decontamination: rare word n-grams seed candidates, Smith-Waterman alignment scores edited copies.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case. An item of m words is found in a text if the best local
alignment of their words (match 2, mismatch -1, gap -1) reaches ``least_score`` of the 2 m of a full copy.

A match may lose ``lost`` = 2 m (1 - least_score) points. A pair of neighbouring item words that does not stand side
by side in the text costs a point at least: an inserted word costs 1 and parts one pair, a substituted or left out
word costs 3 and parts two, a word beyond the alignment's end costs 2 and parts one. So ``m - 1 - lost`` pairs or more
stand unharmed, within ``m + lost`` words of the text. Where that is none, single words are the grams: an unmatched
one costs 2 at least, so ``m - lost / 2`` stand. To ask for c unharmed grams, the most frequent grams of an item may
be left out as long as c of those that must stand remain; c is half of the latter. Frequencies are counted over all
texts. Seeds meet the texts in the tasks, in blocks of items of bounded size (a benchmark of any size is done, block
by block), so no text is shuffled. Where c seed hits of an item are near each other, with room for all gaps the score
allows, the words are aligned, many windows side by side.

Items of fewer than ``least_words`` words are too short to be told from chance once edited; they may lose no point, so
only exact runs of their words are found.

Words and grams are 64-bit fingerprints.

Cases: null or empty texts and items match nothing; repeated rows and equal items are all reported; null ids are reported as
null; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.words import combined, fingerprints, mixed, split_words, text_pieces
from tallyscope.session import stored

LEAST_SCORE, LEAST_WORDS = 0.6, 8
#: Words of items in one block; a block's arrays stay within some megabytes.
BLOCK_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1
FILTER_BITS = 1 << 22
#: Places of seed hits looked at together; a text's are not parted.
PLACES = 1_000_000

_U = np.uint64


class Block(NamedTuple):
    items: list  # item ids
    words: np.ndarray  # fingerprints of all items' words
    first: np.ndarray  # where each item's words begin, one more at the end
    lost: np.ndarray  # points that a match of each item may lose
    gram: np.ndarray  # sorted distinct fingerprints of the grams
    head: np.ndarray  # for each gram the first of its places below, one more at the end
    item: np.ndarray  # places of grams: the item
    offset: np.ndarray  # and the word it begins with
    bits: np.ndarray  # flags of the grams, to drop most other grams at once


def points_lost(m: np.ndarray, least_score: float, least_words: int) -> np.ndarray:
    """Most points by which an alignment of the least score stays below a full copy; none for short items."""
    return np.where(m >= least_words, np.floor(m * (1 - least_score) * MATCH + 1e-9), 0).astype(np.int64)


def unharmed(m: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a gram, and how many grams of an item stand in every match of it: pairs of words, or else single words."""
    pairs = m - 1 - lost // -GAP
    return np.where(pairs > 0, 2, 1), np.where(pairs > 0, pairs, np.maximum(m - lost // MATCH, 1))


def needed(block: Block) -> np.ndarray:
    """Seed hits that every match of an item has."""
    return (unharmed(np.diff(block.first), block.lost)[1] + 1) // 2


def item_blocks(benchmark: DataFrame, item_id: str, text: str, least_score: float, least_words: int, block_words: int):
    """Blocks of items, read from a stored table of items a part at a time."""
    def cut(batches):
        for batch in batches:
            for part, raw in text_pieces([batch], text):
                words = split_words(raw)
                h = fingerprints(words.data, words.start, words.end)
                rows = [h[a:b].tobytes() if b > a else None for a, b in zip(words.first, words.first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(item_id), pa.array(rows, pa.binary())], names=["item", "words"])

    source = benchmark.select(item_id, text)
    kept = stored(source.mapInArrow(cut, source.selectExpr(f"{item_id} AS item", "CAST(NULL AS binary) AS words").schema).where("words is not null"))
    items, words, size = [], [], 0
    for row in kept.toLocalIterator():
        items.append(row["item"])
        words.append(np.frombuffer(row.words, _U))
        size += len(words[-1])
        if size >= block_words:
            yield _block(items, words, least_score, least_words)
            items, words, size = [], [], 0
    if items:
        yield _block(items, words, least_score, least_words)


def _block(items: list, words: list[np.ndarray], least_score: float, least_words: int) -> Block:
    m = np.array([len(w) for w in words])
    first = np.r_[0, np.cumsum(m)]
    flat = np.concatenate(words)
    lost = points_lost(m, least_score, least_words)
    widths, _ = unharmed(m, lost)
    gram, item, offset = [], [], []
    for width in (1, 2):
        runs = combined(flat, width)
        owner = np.repeat(np.arange(len(items)), m)[:len(runs)]
        at = np.arange(len(runs)) - first[owner]
        ok = (widths[owner] == width) & (at + width <= m[owner])
        gram.append(runs[ok]), item.append(owner[ok]), offset.append(at[ok])
    return _indexed(items, flat, first, lost, *map(np.concatenate, (gram, item, offset)))


def _indexed(items, flat, first, lost, gram, item, offset) -> Block:
    by = np.lexsort((offset, item, gram))
    gram, item, offset = gram[by], item[by], offset[by]
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    bits = np.zeros(FILTER_BITS, bool)
    bits[(gram & _U(FILTER_BITS - 1)).astype(np.int64)] = True
    return Block(items, flat, first, lost, gram[head], np.r_[head, len(gram)], item, offset, bits)


def gram_hits(block: Block, words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, gram number) of every gram of the block that stands in the texts."""
    at, number = [], []
    for width in (1, 2):
        runs = combined(h, width)
        near = np.flatnonzero(block.bits[(runs & _U(FILTER_BITS - 1)).astype(np.int64)] & (words.doc[:len(runs)] == words.doc[width - 1:width - 1 + len(runs)]))
        if len(near) and len(block.gram):
            place = np.minimum(np.searchsorted(block.gram, runs[near]), len(block.gram) - 1)
            hit = block.gram[place] == runs[near]
            at.append(near[hit]), number.append(place[hit])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(number)


def gram_counts(docs: DataFrame, text: str, shipped, grams: int) -> np.ndarray:
    """How often each gram of the block stands in all texts; as many numbers as the block has grams."""
    def count(batches):
        total = np.zeros(grams, np.int64)
        for _, raw in text_pieces(batches, text):
            words = split_words(raw)
            _, number = gram_hits(shipped.value, words, fingerprints(words.data, words.start, words.end))
            total += np.bincount(number, minlength=grams)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["gram", "n"])

    out = np.zeros(grams, np.int64)
    sums = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for row in sums.mapInArrow(pack, "gram binary, n binary").collect():  # in one job, however many partitions
        out[np.frombuffer(row.gram, np.int64)] = np.frombuffer(row.n, np.int64)
    return out


def rare_seeds(block: Block, counts: np.ndarray) -> Block:
    """The block with the rarest grams of each item, of which a match has as many as are needed."""
    per = np.diff(block.head)
    gram, n = np.repeat(np.arange(len(per)), per), np.repeat(counts, per)
    by = np.lexsort((block.offset, n, block.item))
    place = np.arange(len(by)) - np.searchsorted(block.item[by], block.item[by])
    m = np.diff(block.first)
    width, stand = unharmed(m, block.lost)
    keep = by[place < (m - width + 1 - stand + needed(block))[block.item[by]]]
    return _indexed(block.items, block.words, block.first, block.lost, block.gram[gram[keep]], block.item[keep], block.offset[keep])


def aligned(window: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``item`` in the same row of ``window``, and the window's word it ends with.

    Rows are padded with numbers that equal nothing. The window's words go one by one; a row of the alignment matrix
    takes gaps in the item's direction as a running maximum.
    """
    rows, size = item.shape
    tilt = np.arange(size, dtype=np.int32) * -GAP
    last = np.zeros((rows, size + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for k in range(window.shape[1]):
        now = last[:, :-1] + np.where(window[:, k:k + 1] == item, np.int32(MATCH), np.int32(MISS))
        np.maximum(now, last[:, 1:] + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + tilt, axis=1) - tilt
        top = now.max(1)
        better = top > best
        best[better], end[better] = top[better], k
        last[:, 1:] = now
    return best, end


def windows(block: Block, first: np.ndarray, doc: np.ndarray, at: np.ndarray, number: np.ndarray):
    """(text, item, begin, end) of the stretches of words around enough seed hits; near ones of an item are one stretch.

    Texts are done some at a time, so that the places of their hits stay within some megabytes.
    """
    by = np.argsort(at, kind="stable")
    at, number = at[by], number[by]
    load = np.cumsum(block.head[number + 1] - block.head[number]) // PLACES
    texts = doc[at]
    begins = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]][:len(at)])
    cuts = begins[np.r_[True, load[begins[1:]] != load[begins[:-1]]][:len(begins)]]
    found = [_stretches(block, first, doc, at[a:b], number[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(at)])]
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 4


def _stretches(block: Block, first: np.ndarray, doc: np.ndarray, at: np.ndarray, number: np.ndarray):
    per = block.head[number + 1] - block.head[number]
    place = np.repeat(block.head[number], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    where, item, offset = np.repeat(at, per), block.item[place], block.offset[place]
    text = doc[where]
    by = np.lexsort((where, item, text))
    where, item, offset, text = where[by], item[by], offset[by], text[by]
    # Hits at one word count once; a match has the needed ones within its longest stretch of text.
    new = np.ones(len(by), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1])
    hit = np.flatnonzero(new)
    last = np.arange(len(hit)) + needed(block)[item[hit]] - 1
    final = hit[np.minimum(last, len(hit) - 1)]
    size = np.diff(block.first)
    near = (last < len(hit)) & (text[final] == text[hit]) & (item[final] == item[hit])
    near &= where[final] - where[hit] <= (size + block.lost // -GAP)[item[hit]]
    marks = np.bincount(np.flatnonzero(near), minlength=len(hit) + 1) - np.bincount(last[near] + 1, minlength=len(hit) + 1)
    kept = (np.cumsum(marks) > 0)[np.cumsum(new) - 1]
    where, item, offset, text = where[kept], item[kept], offset[kept], text[kept]
    m, room = size[item], block.lost[item] // -GAP
    begin = np.maximum(where - offset - room, first[text])
    end = np.minimum(where - offset + m + room, first[text + 1])
    by = np.lexsort((begin, item, text))
    text, item, begin, end = text[by], item[by], begin[by], end[by]
    new = np.ones(len(by), bool)
    # Of one item all stretches are equally long but for the text's ends, so the one before ends last.
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    group = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, group) if len(group) else end
    return text[group], item[group], begin[group], stop


def contaminated(docs: DataFrame, benchmark: DataFrame, ids: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(ids, item_id, score, last_word) of every document and item whose alignment reaches the least score.

    ``score`` is the best alignment's share of a full copy's; ``last_word`` the number (from 0) of the word it ends with.
    """
    spark = docs.sparkSession
    source = docs.select(ids, text)
    schema = source.select(ids).join(benchmark.select(F.col(item_id).alias("_item"))).selectExpr(ids, f"_item AS {item_id}", "0D AS score", "0L AS last_word").schema
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id, item_text, least_score, least_words, block_words):
        all_grams = spark.sparkContext.broadcast(block)
        seeds = spark.sparkContext.broadcast(rare_seeds(block, gram_counts(docs, text, all_grams, len(block.gram))))
        out = out.union(source.mapInArrow(_matcher(seeds, ids, text, item_id, schema[item_id].dataType), schema))
    return out


def _matcher(seeds, ids: str, text: str, item_id: str, item_type):
    def run(batches):
        block = seeds.value
        size = np.diff(block.first)
        for part, raw in text_pieces(batches, text):
            words = split_words(raw)
            h = fingerprints(words.data, words.start, words.end)
            doc, item, begin, end = windows(block, words.first, words.doc, *gram_hits(block, words, h))
            best: dict[tuple[int, int], tuple[float, int]] = {}
            # Windows and items of similar sizes go side by side.
            by = np.lexsort((end - begin, size[item]))
            at = 0
            while at < len(by):
                some = by[at:at + max(1, 400_000 // int((end - begin)[by[at:at + 512]].max() + size[item[by[at:at + 512]]].max()))][:512]
                at += len(some)
                long, wide = int((end - begin)[some].max()), int(size[item[some]].max())
                k, j = begin[some][:, None] + np.arange(long), block.first[item[some]][:, None] + np.arange(wide)
                window = np.where(k < end[some][:, None], h[np.minimum(k, len(h) - 1)], _U(0))
                target = np.where(j < block.first[item[some] + 1][:, None], block.words[np.minimum(j, len(block.words) - 1)], _U(1))
                score, last = aligned(window, target)
                share = score / (MATCH * size[item[some]])
                for x in np.flatnonzero(score >= MATCH * size[item[some]] - block.lost[item[some]]).tolist():
                    key = (int(doc[some[x]]), int(item[some[x]]))
                    found = (float(share[x]), int(begin[some[x]] + last[x] - words.first[key[0]]))
                    if key not in best or (-found[0], found[1]) < (-best[key][0], best[key][1]):
                        best[key] = found
            if best:
                rows = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [part.column(ids).take(pa.array([d for d, _ in rows])), pa.array([block.items[i] for _, i in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(item_type.simpleString(), pa.string())),
                     pa.array([best[r][0] for r in rows], pa.float64()), pa.array([best[r][1] for r in rows], pa.int64())], names=[ids, item_id, "score", "last_word"])

    return run
