"""Phrase collocations counted in counting quotient filters of packed word ids.

A-Z become lower case; texts are cut at ``[.,;:!?\x0A-\x0D]`` into pieces and those at ``[\x20\x09]`` into words. All
counts are per language. A phrase of 2 to ``longest`` words is a candidate when it occurs ``least`` times or more within
pieces, overlaps included. It is scored by its weakest cut, and goes when a longer candidate that holds it occurs
nearly as often (``share``, a pair numerator and denominator).

1. Words are counted exactly. Words that reach ``least`` in a language get ids: 32 bits of a fingerprint, or all 64 when
   the vocabulary is large. Words whose ids clash are found by a join of all words that may be counted; the frequent
   ones get ids of their own from a reserved range, the others none, so ids are unique and no vocabulary is sent round.
2. Each task packs the ids of neighbouring words into one key and counts keys in a quotient filter (``quotient_filter``:
   an invertible permutation, quotient and full remainder, lossless). Filters are cut by leading bits into buckets,
   shuffled, and merged bucket by bucket; keys below ``least`` end there, the others give their ids back.
3. Pairs are counted first. Longer phrases only where all their pairs are frequent, which every candidate's are.
4. Candidates meet the counts of their parts, and of longer candidates, in joins of the frequent phrases.

Words and pairs that cannot be frequent are told from a bit array of fixed size; a false bit only costs a comparison.

Cases: a null text is empty and has no words; a null language is ``und``; repeated rows count as often as they stand;
a text of any length is cut at its piece ends into parts of a few megabytes; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyscope.llm.quotient_filter import by_bucket, counted, from_bytes, merged, permuted, restored, to_bytes
from tallyscope.llm.rarity import bit_blocks, flagged
from tallyscope.llm.words import coded_words, list_array, mixed, short_batches, text_parts, word_prints
from tallyscope.session import small_side, stored

#: What bytes are: 0 of a word, 1 between words, 2 between pieces.
KIND = bytes(2 if c in b".,;:!?" or 0x0A <= c <= 0x0D else 1 if c in b"\x20\x09" else 0 for c in range(256))
ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
PART_BYTES = 2 << 20
FLAG_BITS = 1 << 25
#: Ids below this number are given to words whose ids clash.
RESERVED = 1 << 20
#: Above so many words, ids are 64 bits wide.
NARROW_WORDS = 1 << 24
#: Tokens of all filters of a bucket, about, and keys that a task holds before it sends its filters.
BUCKET_TOKENS = 1 << 20
HELD_KEYS = 1 << 20
#: Texts of an Arrow batch.
ROWS = 500

_U = np.uint64


class Tokens(NamedTuple):
    lang: np.ndarray  # per token, a row of langs
    code: np.ndarray  # per token, a row of vocabulary
    piece: np.ndarray  # per token, rising
    langs: list[str]
    vocabulary: pa.Array  # distinct words, exact
    prints: np.ndarray  # their fingerprints


def tokens(texts: list[bytes], heads: list[tuple]) -> Tokens:
    w = coded_words(texts, KIND)
    names = sorted({x[0] for x in heads})
    row = {name: i for i, name in enumerate(names)}
    return Tokens(np.array([row[x[0]] for x in heads], np.int64)[w.text], w.code, np.cumsum(w.kind == 2, dtype=np.int32)[w.start], names, w.vocabulary, w.prints)


def lang_marks(langs: list[str]) -> np.ndarray:
    return word_prints(pa.array(langs, pa.string()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word; word null: of all words of the language."""
    def run(batches):
        for texts, heads, *_ in text_parts(batches, PART_BYTES, ENDS):
            t = tokens(texts, heads)
            key, n = np.unique(t.lang * max(len(t.vocabulary), 1) + t.code, return_counts=True)
            lang, code = np.divmod(key, max(len(t.vocabulary), 1))
            yield pa.RecordBatch.from_arrays([pa.array(t.langs).take(pa.array(lang)), t.vocabulary.take(pa.array(code)), pa.array(n)], names=["lang", "word", "n"])
            every = np.bincount(t.lang, minlength=len(t.langs))
            yield pa.RecordBatch.from_arrays([pa.array(t.langs), pa.nulls(len(every), pa.binary()), pa.array(every)], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Ids(NamedTuple):
    """What tasks need to give words their ids: bits of a fixed size, and the few clashing ids and words."""
    bits: int
    flags: np.ndarray
    clashing: np.ndarray
    own: dict[bytes, int]

    def of(self, words: pa.Array, prints: np.ndarray) -> np.ndarray:
        """Ids of words; 0: none."""
        ids = plain_ids(prints, self.bits)
        at = np.flatnonzero(np.isin(ids, self.clashing))
        ids[at] = [self.own.get(w, 0) for w in words.take(pa.array(at)).to_pylist()]
        return ids

    def frequent(self, prints: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return flagged(self.flags, mixed(prints ^ marks))


def plain_ids(prints: np.ndarray, bits: int) -> np.ndarray:
    return np.maximum(prints >> _U(64 - bits), _U(RESERVED))


def packed(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Keys of neighbouring ids: two ids a limb if they are 32 bits wide."""
    if bits == 64:
        return ids
    ids = [*ids, np.zeros_like(ids[0])] if len(ids) % 2 else ids
    return [a << _U(32) | b for a, b in zip(ids[::2], ids[1::2])]


def unpacked(limbs: tuple[np.ndarray, ...], bits: int, n: int) -> np.ndarray:
    if bits == 64:
        return np.stack(limbs, 1)
    return np.stack([x for limb in limbs for x in (limb >> _U(32), limb & _U(0xFFFFFFFF))], 1)[:, :n]


def mark_of(limbs: tuple[np.ndarray, ...], marks: np.ndarray) -> np.ndarray:
    """A number for a permuted key and its language, to find it in a bit array."""
    out = marks
    for x in limbs:
        out = mixed(out ^ x)
    return out


def word_ids(counts: DataFrame, least: int) -> tuple[Ids, DataFrame]:
    """Ids without clashes for all words that may be counted, and (lang, word, id, n) of the frequent ones."""
    spark = counts.sparkSession

    def values(batches):
        for batch in batches:
            prints, marks = _prints(batch)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(prints ^ marks).view(np.int64))], names=["value"])

    frequent = counts.where((F.col("n") >= least) & F.col("word").isNotNull())
    flags = bit_blocks(frequent.mapInArrow(values, "value long"), FLAG_BITS)
    shipped = spark.sparkContext.broadcast(flags)

    def passing(batches):
        for batch in batches:
            prints, marks = _prints(batch)
            ok = pa.array(flagged(shipped.value, mixed(prints ^ marks)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(prints.view(np.int64)), batch.column("n")], names=["word", "print", "n"]).filter(ok)

    maybe = stored(counts.where("word is not null").mapInArrow(passing, "word binary, print long, n long")
                   .groupBy("word", "print").agg(F.max("n").alias("n")))
    bits = 32 if maybe.count() <= NARROW_WORDS else 64

    def plain(batches):
        for batch in batches:
            ids = plain_ids(batch.column("print").to_numpy().view(_U), bits)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids.view(np.int64)), batch.column("n")], names=["word", "id", "n"])

    named = maybe.mapInArrow(plain, "word binary, id long, n long")
    clashes = named.groupBy("id").agg(F.count("*").alias("m"), F.max("n").alias("most")).where((F.col("m") > 1) & (F.col("most") >= least)).select("id")
    # Their number is V^2 / 2^(bits + 1), at most some 2^15 by the choice of bits; it is checked all the same.
    rows = named.join(F.broadcast(clashes), "id").select("id", "word", "n").limit(RESERVED).collect()
    if len(rows) == RESERVED:
        raise ValueError("too many words share ids")
    own = {w: i + 1 for i, w in enumerate(sorted(bytes(r.word) for r in rows if r.n >= least))}
    ids = Ids(bits, flags, np.unique(np.array([r.id for r in rows], np.int64).view(_U)), own)
    given = spark.sparkContext.broadcast(ids)

    def name(batches):
        for batch in batches:
            got = given.value.of(batch.column("word"), _prints(batch)[0])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), pa.array(got.view(np.int64)), batch.column("n")], names=["lang", "word", "id", "n"])

    return ids, stored(frequent.mapInArrow(name, "lang string, word binary, id long, n long"))


def _prints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words and of the languages of a batch."""
    langs = batch.column("lang").dictionary_encode()
    return word_prints(batch.column("word")), lang_marks(langs.dictionary.to_pylist())[langs.indices.to_numpy()]


def frequent_phrases(docs: DataFrame, ids: Ids, sizes: range, least: int, n_tokens: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, ids, n): phrases of ``sizes`` words that occur ``least`` times or more, counted in quotient filters.

    ``pairs``: bits of the frequent pairs; longer phrases are counted where all their pairs are among them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    skip = min(max(2 * parts, n_tokens // BUCKET_TOKENS, 1).bit_length(), 24)
    shipped = spark.sparkContext.broadcast((ids, pairs))

    def fill(batches):
        ids, pairs = shipped.value
        held: dict[tuple[str, int], list] = {}
        size = 0

        def settle(most: int):
            nonlocal size
            for key, filters in held.items():
                held[key] = [merged(filters)]
            size = sum(len(f[0].count) for f in held.values())
            if size <= most:
                return
            rows = [(lang, n, bucket, to_bytes(part, skip)) for (lang, n), (whole,) in held.items() for bucket, part in by_bucket(whole, skip)]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at:at + 256]), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                                                 names=["lang", "size", "bucket", "filter"])
            held.clear()
            size = 0

        for texts, heads, *_ in text_parts(batches, PART_BYTES, ENDS):
            t = tokens(texts, heads)
            marks = lang_marks(t.langs)[t.lang]
            mine = ids.of(t.vocabulary, t.prints)[t.code]
            ok = ids.frequent(t.prints[t.code], marks) & (mine != 0)
            at = np.flatnonzero(ok[:-1] & ok[1:] & (t.piece[:-1] == t.piece[1:]))
            keys = permuted(packed([mine[at], mine[at + 1]], ids.bits))
            if pairs is not None:
                known = np.zeros(len(mine) + max(sizes), bool)
                known[at[flagged(pairs, mark_of(keys, marks[at]))]] = True
            for n in sizes:
                if n > 2:
                    at = np.flatnonzero(np.logical_and.reduce([known[k:k + len(mine)] for k in range(n - 1)]))
                    keys = permuted(packed([mine[at + k] for k in range(n)], ids.bits))
                lang = t.lang[at]
                for row, name in enumerate(t.langs):
                    own = lang == row if len(t.langs) > 1 else slice(None)
                    f = counted([x[own] for x in keys])
                    if len(f.count):
                        held.setdefault((name, n), []).append(f)
                        size += len(f.count)
            if size > HELD_KEYS:
                yield from settle(HELD_KEYS // 2)
        yield from settle(0)

    def merge(batches):
        bits, current, filters = shipped.value[0].bits, None, []

        def whole():
            f = merged(filters)
            keep = f.count >= least
            if not keep.any():
                return
            words = unpacked(restored([x[keep] for x in f.limbs]), bits, current[1])
            rows = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([current[0]] * rows, pa.string()), list_array(words.reshape(-1).view(np.int64), np.full(rows, current[1]), pa.int64()),
                                              pa.array(f.count[keep])], names=["lang", "ids", "n"])

        for batch in batches:
            for lang, n, bucket, filter in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, n, bucket) != current:
                    if filters:
                        yield from whole()
                    current, filters = (lang, n, bucket), []
                filters.append(from_bytes(filter, bucket))
                if len(filters) > 64:
                    filters = [merged(filters)]
        if filters:
            yield from whole()

    filled = docs.mapInArrow(fill, "lang string, size int, bucket long, filter binary")
    key = ["lang", "size", "bucket"]
    return filled.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge, "lang string, ids array<long>, n long")


def pair_bits(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bit array of frequent pairs."""
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            flat = batch.column("ids").flatten().to_numpy().view(_U).reshape(-1, 2)
            marks = lang_marks(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            value = mark_of(permuted(packed([flat[:, 0], flat[:, 1]], bits)), marks)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["value"])

    return bit_blocks(phrases.select("lang", "ids").mapInArrow(run, "value long"), FLAG_BITS)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4,
                 share: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase that is kept.

    a: its count; l, r: those of the parts of its weakest cut; n: all words of the language; score: floor(scale * a /
    (l + r)), exact.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with short_batches(spark, ROWS):
        counts = stored(word_counts(texts))
    ids, vocabulary = word_ids(counts, least)
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    n_tokens = totals.agg(F.sum("total")).first()[0] or 0
    with short_batches(spark, ROWS):
        phrases = stored(frequent_phrases(texts, ids, range(2, 3), least, n_tokens))
        if longest > 2:
            pairs = pair_bits(phrases, ids.bits)
            phrases = phrases.union(stored(frequent_phrases(texts, ids, range(3, longest + 1), least, n_tokens, pairs)))

    known = phrases.union(vocabulary.select("lang", F.array("id").alias("ids"), "n"))
    size = F.size("ids")
    cuts = phrases.select("lang", "ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")) \
        .select("lang", "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    parts = cuts.join(known.select("lang", F.col("ids").alias("left"), F.col("n").alias("l")), ["lang", "left"]) \
        .join(known.select("lang", F.col("ids").alias("right"), F.col("n").alias("r")), ["lang", "right"]) \
        .withColumn("score", F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = parts.groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = [(i, m) for m in range(2, longest) for i in range(1, longest - m + 2)]
    held = phrases.where(size > 2).select("lang", "n", size.alias("size"), "ids", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in spans])).alias("at")) \
        .where((F.col("at.m") < F.col("size")) & (F.col("at.i") + F.col("at.m") - 1 <= F.col("size"))) \
        .groupBy("lang", F.slice("ids", F.col("at.i"), F.col("at.m")).alias("ids")).agg(F.max("n").alias("longer")) if spans else None
    kept = weakest
    if held is not None:
        wide = "decimal(20,0)"
        covered = share[1] * F.col("longer").cast(wide) >= share[0] * F.col("a").cast(wide)
        kept = weakest.join(held, ["lang", "ids"], "left").where(F.col("longer").isNull() | ~covered)

    # Phrases in words: an id is one word, whatever the language.
    names = vocabulary.groupBy("id").agg(F.first("word").cast("string").alias("word"))
    spelled = kept.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(names, "id") \
        .groupBy("lang", "ids").agg(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"].alias("words"))
    return kept.join(spelled, ["lang", "ids"]).join(small_side(stored(totals)), "lang") \
        .select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                F.col("total").alias("n"), F.col("cut.score").alias("score"))


def best_phrases(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of every language, ranked; each language is first cut down in slices of its phrases."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slices = min(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    few = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.drop("_slice", "_at")


def phrases_sql(top: int = 2000) -> str:
    """The same rows by plain SQL over ``documents``."""
    return f"""
WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered),
     worded AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
     grams AS (SELECT lang, m, w[i:i + m - 1] AS g
               FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
     f AS (SELECT lang, m, g, CAST(count(*) AS HUGEINT) AS n FROM grams GROUP BY ALL),
     total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
     cand AS (SELECT * FROM f WHERE m >= 2 AND n >= 30),
     cuts AS (SELECT c.lang, c.g, c.m, c.n AS a, c.k, l.n AS l, r.n AS r, (2000000 * c.n) // (l.n + r.n) AS score
              FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) AS c
              JOIN f AS l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f AS r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.m]),
     weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
     inner_spans AS (SELECT lang, g[i:i + s - 1] AS g, max(n) AS longer
               FROM (SELECT lang, g, n, s, unnest(range(1, m - s + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL),
     kept AS (SELECT w.* FROM weakest AS w LEFT JOIN inner_spans AS h ON h.lang = w.lang AND h.g = w.g WHERE h.longer IS NULL OR 100 * h.longer < 80 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
       array_to_string(g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, CAST(score AS BIGINT) AS score
FROM kept AS k JOIN total AS t ON t.lang = k.lang QUALIFY rank <= {top}
"""
