"""How far the sources of a language differ in their use of words, over run-length columns.

Terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, A-Z in lower case. Each language keeps its V terms that at least
``least`` of its documents have. A group (language and source), and each whole language, gives every kept term
p = 1 + floor(unit * (count + smooth) / (N + smooth * V)), N being its count of all kept terms. Two groups of a
language differ by the sum of |p - q| over kept terms; a group's typical terms have p above the language's.

1. Document counts of terms are added up; kept terms are those of ``least`` documents or more.
2. Tasks count kept terms by group, packed by blocks of the vocabulary; a block meets in one task, streamed and merged.
   There its terms are put into an order that brings equal counts together, and every group's column becomes runs.
3. Columns are stored in tiles of groups. For a pair of groups the boundaries of their runs are intersected; within a
   segment both counts are constant, so |p - q| counts as often as the segment is long. Only counts of runs are turned
   into p, in whole numbers of any size.

Blocks have about ``BLOCK_TERMS`` terms, and tiles a bounded number of groups, so a row is bounded too.

Cases: null texts, languages and sources are empty; a group without terms takes part with N = 0; a language without kept
terms has pairs of value 0; repeated rows count as often as they stand; a text of any length is read in parts of a few
megabytes, one document all the same; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyscope.llm.rarity import bit_blocks, flagged
from tallyscope.llm.words import coded_words, mixed, short_batches, text_parts, word_prints
from tallyscope.session import small_side, stored

#: 0 for bytes of terms (a-z after lower-casing, and all beyond ASCII).
TERM = bytes(0 if 0x61 <= c <= 0x7A or c >= 0x80 else 1 for c in range(256))
ENDS = re.compile(rb"[\x00-\x40]")
PART_BYTES = 2 << 20
#: Texts of an Arrow batch.
ROWS = 64
FLAG_BITS = 1 << 25
BLOCK_TERMS = 2048
TILE_GROUPS = 64
#: Counts that a task, or a block being merged, holds before they are added up.
HELD = 1 << 20
#: Columns that give the order of a block's terms.
ORDER_COLUMNS = 16

_U = np.uint64


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that have the term."""
    def run(batches):
        open_number, seen = -1, set()
        for parts, heads, numbers, parted in text_parts(batches, PART_BYTES, ENDS):
            w = coded_words(parts, TERM)
            size = max(len(w.vocabulary), 1)
            text, code = np.divmod(np.unique(w.text * size + w.code), size)
            # Later parts of a document count only terms that its earlier parts do not have.
            keep = np.ones(len(text), bool)
            for i in np.flatnonzero(parted).tolist():
                if numbers[i] != open_number:
                    open_number, seen = numbers[i], set()
                mine = np.flatnonzero(text == i)
                terms = w.vocabulary.take(pa.array(code[mine])).to_pylist()
                keep[mine] = [t not in seen for t in terms]
                seen.update(terms)
            names = sorted({h[0] for h in heads})
            row = {name: k for k, name in enumerate(names)}
            lang = np.array([row[h[0]] for h in heads], np.int64)[text[keep]]
            key, n = np.unique(lang * size + code[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(key // size)), w.vocabulary.take(pa.array(key % size)), pa.array(n)], names=["lang", "term", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _marks(langs: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = langs.dictionary_encode()
    prints = word_prints(terms)
    return prints, mixed(prints ^ word_prints(coded.dictionary)[coded.indices.to_numpy()])


def count_blocks(texts: DataFrame, kept: DataFrame, tiles: DataFrame, blocks: int) -> DataFrame:
    """(lang, block, tile, m, terms, sources, totals, runs, every): the run-length columns of all groups, by tile.

    ``every`` is the column of the whole language; a source that is not named has no term of the block.
    """
    spark = texts.sparkSession

    def marks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_marks(batch.column(0), batch.column(1))[1].view(np.int64))], names=["value"])

    flags = spark.sparkContext.broadcast(bit_blocks(kept.select("lang", "term").mapInArrow(marks, "value long"), FLAG_BITS))
    schema = "lang string, block long, tiles int, terms binary, sources binary, entries binary"
    names = ["lang", "block", "tiles", "terms", "sources", "entries"]

    def rows(out):
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 64]), types)], names=names)

    def count(batches):
        term_at, terms, prints, group_at, groups = {}, [], [], {}, []
        held, size = [], 0

        def settled():
            key, n = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(key, kind="stable")
            key, n = key[by], n[by]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            return key[at], np.add.reduceat(n, at) if len(key) else n

        def flush(key, n):
            group, term = key >> 32, key & 0xFFFFFFFF
            langs = sorted({g[0] for g in groups})
            lang = np.array([langs.index(g[0]) for g in groups], np.int64)[group]
            block = (np.array(prints, _U)[term] >> _U(20)).astype(np.int64) % blocks
            by = np.lexsort((term, block, lang))
            group, term, n, place = group[by], term[by], n[by], (lang * blocks + block)[by]
            cut = [*np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[:len(place)].tolist(), len(place)]
            out = []
            for a, b in zip(cut, cut[1:]):
                own_terms, slot = np.unique(term[a:b], return_inverse=True)
                own_groups, source = np.unique(group[a:b], return_inverse=True)
                out.append((langs[place[a] // blocks], int(place[a] % blocks), None, b"\n".join(terms[t] for t in own_terms.tolist()), packed_names([groups[g][1] for g in own_groups.tolist()]),
                            slot.astype("<u4").tobytes() + source.astype("<u4").tobytes() + n[a:b].astype("<i8").tobytes()))
            return out

        for parts, heads, *_ in text_parts(batches, PART_BYTES, ENDS):
            w = coded_words(parts, TERM)
            for h in heads:
                if h not in group_at:
                    group_at[h] = len(groups)
                    groups.append(h)
            group = np.array([group_at[h] for h in heads], np.int64)
            by_lang = sorted({h[0] for h in heads})
            lang_print = dict(zip(by_lang, word_prints(pa.array(by_lang, pa.string())).tolist()))
            text_mark = np.array([lang_print[h[0]] for h in heads], _U)
            ok = flagged(flags.value, mixed(w.prints[w.code] ^ text_mark[w.text]))
            code, own = w.code[ok], group[w.text[ok]]
            some, slot = np.unique(code, return_inverse=True)
            number = []
            for value, h in zip(w.vocabulary.take(pa.array(some)).to_pylist(), w.prints[some].tolist()):
                if value not in term_at:
                    term_at[value] = len(terms)
                    terms.append(value)
                    prints.append(h)
                number.append(term_at[value])
            key, n = np.unique(own << 32 | np.array(number, np.int64)[slot], return_counts=True)
            held.append((key, n))
            size += len(key)
            if size > HELD:
                held = [settled()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from rows(flush(*held[0]))
                    term_at, terms, prints, group_at, groups, held, size = {}, [], [], {}, [], [], 0
        if held:
            yield from rows(flush(*settled()))

    def known(batches):
        for batch in batches:
            prints, _ = _marks(batch.column("lang"), batch.column("term"))
            block = (prints >> _U(20)).astype(np.int64) % blocks
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(block), batch.column("tiles"), batch.column("term"), none, none], names=names)

    def meet(batches):
        current, state = None, None
        for batch in batches:
            for lang, block, n_tiles, terms, sources, entries in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, block) != current:
                    if state:
                        yield from state.columns(*current)
                    current, state = (lang, block), Block()
                if entries is None:
                    state.keep(terms, n_tiles)
                else:
                    state.add(terms, sources, entries)
        if state:
            yield from state.columns(*current)

    counts = texts.select("lang", "source", "text").mapInArrow(count, schema)
    kept_rows = kept.join(small_side(tiles), "lang").select("lang", "term", "tiles").mapInArrow(known, schema)
    out = counts.union(kept_rows).repartition("lang", "block").sortWithinPartitions("lang", "block")
    return out.mapInArrow(meet, "lang string, block long, tile int, m int, terms binary, sources array<string>, totals array<long>, runs array<binary>, every binary")


def packed_names(names: list[str]) -> bytes:
    raw = [x.encode() for x in names]
    return struct.pack("<I", len(raw)) + np.array([len(x) for x in raw], "<u4").tobytes() + b"".join(raw)


def unpacked_names(packed: bytes) -> list[str]:
    n = struct.unpack_from("<I", packed)[0]
    ends = np.cumsum(np.frombuffer(packed, "<u4", n, 4)).astype(int) + 4 + 4 * n
    return [packed[a:b].decode() for a, b in zip([4 + 4 * n, *ends.tolist()], ends.tolist())]


class Block:
    """Counts of a block of the vocabulary while they come together."""

    def __init__(self):
        self.term_at: dict[bytes, int] = {}
        self.source_at: dict[str, int] = {}
        self.kept: list[int] = []
        self.tiles = 1
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def keep(self, term: bytes, tiles: int) -> None:
        self.kept.append(self.term_at.setdefault(term, len(self.term_at)))
        self.tiles = tiles

    def add(self, terms: bytes, sources: bytes, entries: bytes) -> None:
        term = np.array([self.term_at.setdefault(t, len(self.term_at)) for t in terms.split(b"\n")], np.int64)
        source = np.array([self.source_at.setdefault(s, len(self.source_at)) for s in unpacked_names(sources)], np.int64)
        m = len(entries) // 16
        slot, of = (np.frombuffer(entries, "<u4", m, 4 * m * k) for k in (0, 1))
        self.held.append((source[of] << 32 | term[slot], np.frombuffer(entries, "<i8", m, 8 * m)))
        self.size += m
        if self.size > HELD:
            self.held = [self.settled()]
            self.size = len(self.held[0][0])

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*self.held))
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[at], np.add.reduceat(n, at)

    def columns(self, lang: str, block: int):
        """The tiles' rows."""
        m = len(self.kept)
        if not m:  # only terms that a false bit let through
            return
        place = np.full(len(self.term_at), -1, np.int64)
        place[self.kept] = np.arange(m)
        key, n = self.settled() if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        source, term = key >> 32, place[key & 0xFFFFFFFF]
        source, term, n = source[term >= 0], term[term >= 0], n[term >= 0]
        every = np.zeros(m, np.int64)
        np.add.at(every, term, n)
        # Rare sources first: they have few distinct counts, so the next columns keep long runs.
        names = list(self.source_at)
        weight = np.bincount(source, minlength=len(names)) if len(names) else np.zeros(0, np.int64)
        first = np.argsort(weight, kind="stable")
        first = first[weight[first] > 0][:ORDER_COLUMNS]
        keys = np.zeros((len(first), m), np.int64)
        for row, s in enumerate(first.tolist()):
            keys[row, term[source == s]] = n[source == s]
        order = np.lexsort((every, *keys[::-1]))
        spot = np.empty(m, np.int64)
        spot[order] = np.arange(m)
        terms = list(self.term_at)
        blob = b"\n".join(terms[self.kept[k]] for k in order.tolist())
        whole = runs_of(every[order])
        bounds = np.searchsorted(source, np.arange(len(names) + 1))
        tiles: list[list] = [[] for _ in range(self.tiles)]
        for s, name in enumerate(names):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                column = np.zeros(m, np.int64)
                column[spot[term[a:b]]] = n[a:b]
                tiles[zlib.crc32(name.encode()) % self.tiles].append((name, int(column.sum()), runs_of(column)))
        for tile, held in enumerate(tiles):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block]), pa.array([tile], pa.int32()), pa.array([m], pa.int32()), pa.array([blob], pa.binary()),
                                              pa.array([[h[0] for h in held]], pa.list_(pa.string())), pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                                              pa.array([[h[2] for h in held]], pa.list_(pa.binary())), pa.array([whole], pa.binary())],
                                             names=["lang", "block", "tile", "m", "terms", "sources", "totals", "runs", "every"])


def runs_of(column: np.ndarray) -> bytes:
    """A column as the ends of its runs and their counts."""
    ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, len(column))
    return ends.astype("<i4").tobytes() + column[ends - 1].astype("<i8").tobytes()


def read_runs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(packed) // 12
    return np.frombuffer(packed, "<i4", k), np.frombuffer(packed, "<i8", k, 4 * k)


def shares(count: np.ndarray, n: int, v: int, smooth: int, unit: int) -> np.ndarray:
    """p of every count; distinct counts only are divided, as whole numbers of any size."""
    some, at = np.unique(count, return_inverse=True)
    return np.array([1 + unit * (c + smooth) // (n + smooth * v) for c in some.tolist()], np.int64)[at]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of |p - q| over a block: the runs' boundaries are intersected, each segment counts by its length."""
    ends = np.union1d(a[0], b[0])
    f = np.abs(a[1][np.searchsorted(a[0], ends)] - b[1][np.searchsorted(b[0], ends)])
    return int((f * np.diff(ends, prepend=0)).sum())


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, smooth: int = 5,
                unit: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group, part ``pair`` has all other sources of its language, by
    distance, and part ``term`` its ``top`` typical terms."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    with short_batches(docs.sparkSession, ROWS):
        kept = stored(document_counts(texts).where(F.col("n") >= least).select("lang", "term"))
    groups = stored(texts.select("lang", "source").distinct())
    sizes = stored(kept.groupBy("lang").agg(F.count("*").alias("v")))
    tiles = stored(groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_GROUPS).cast("int").alias("tiles")))
    blocks = max(1, -(-(sizes.agg(F.max("v")).first()[0] or 0) // BLOCK_TERMS))
    with short_batches(docs.sparkSession, ROWS):
        columns = stored(count_blocks(texts, kept, tiles, blocks))

    totals = columns.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("at")).groupBy("lang", F.col("at.sources").alias("source")).agg(F.sum("at.totals").alias("n"))
    named = groups.join(totals, ["lang", "source"], "left").join(small_side(tiles), "lang") \
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.crc32(F.encode("source", "utf-8")), F.col("tiles")).cast("int").alias("tile"))
    named = stored(named)
    # A tile's groups are about TILE_GROUPS by their hash.
    members = named.groupBy("lang", "tile").agg(F.collect_list(F.struct("source", "n")).alias("members"))
    whole = sizes.join(named.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    rows = columns.join(small_side(stored(whole)), "lang").join(members, ["lang", "tile"])
    with short_batches(docs.sparkSession):
        rows = stored(rows)

    def group_columns(members, sources, runs, m, v):
        own = dict(zip(sources, runs))
        none = (np.array([m], np.int32), np.zeros(1, np.int64))
        out = []
        for g in members:
            ends, count = read_runs(own[g["source"]]) if g["source"] in own else none
            out.append((g["source"], (ends, shares(count, g["n"], v, smooth, unit)), count))
        return out

    def pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                left = group_columns(r["members"], r["sources"], r["runs"], r["m"], r["v"])
                right = left if r["tile"] == r["tile2"] else group_columns(r["members2"], r["sources2"], r["runs2"], r["m"], r["v"])
                found = [(x[0], y[0], distance(x[1], y[1])) for i, x in enumerate(left) for y in (left[i + 1:] if right is left else right)]
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()),
                                                  pa.array([f[2] for f in found], pa.int64())], names=["lang", "a", "b", "value"])

    def terms(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = r["terms"].split(b"\n")
                spelled = np.empty(len(words), np.int64)
                spelled[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
                ends, count = read_runs(r["every"])
                q = np.repeat(shares(count, r["all"], r["v"], smooth, unit), np.diff(ends, prepend=0))
                for name, (ends, p), count in group_columns(r["members"], r["sources"], r["runs"], r["m"], r["v"]):
                    length = np.diff(ends, prepend=0)
                    value = np.where(np.repeat(count, length) > 0, np.repeat(p, length) - q, 0)
                    at = np.flatnonzero(value > 0)
                    at = at[np.lexsort((spelled[at], -value[at]))][:top]
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(at), pa.string()), pa.array([name] * len(at), pa.string()),
                                                      pa.array([words[k].decode() for k in at.tolist()], pa.string()), pa.array(value[at])], names=["lang", "source", "item", "value"])

    other = rows.select("lang", "block", F.col("tile").alias("tile2"), *[F.col(c).alias(c + "2") for c in ("members", "sources", "runs")])
    met = rows.drop("terms", "every", "totals").join(other, ["lang", "block"]).where("tile <= tile2")
    sums = met.mapInArrow(pairs, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("at")
    both = sums.select("lang", one, "value").select("lang", "at.source", "at.item", "value")
    bare = groups.join(sizes, "lang", "left_anti")
    same = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = both.union(same).withColumn("rank", F.row_number().over(by))
    term_rows = rows.mapInArrow(terms, "lang string, source string, item string, value long").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    order = ("lang", "source", "part", "item", "value", "rank")
    return pair_rows.withColumn("part", F.lit("pair")).select(*order).union(term_rows.withColumn("part", F.lit("term")).select(*order))


def divergences_sql() -> str:
    """The same rows by plain SQL over ``documents``."""
    return """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
     p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.n + 5 * v.v) AS p
           FROM total AS t JOIN kept AS k ON k.lang = t.lang JOIN v ON v.lang = t.lang
           LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
     every AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
     q AS (SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 5)) // (any_value(e.n) + 5 * any_value(v.v)) AS q
           FROM c JOIN every AS e ON e.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term),
     sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     typical AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
     parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM typical)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
