"""Line deduplication by an exact set-similarity join: rarity order, prefix, positional and length filters, Jaccard.

A line goes when a line before it, in the order of (id, text fingerprint, line number), nulls last, has token sets of
Jaccard similarity ``num / den`` or more with it, whether or not that line goes itself. Tokens are words
``[^\x20\x09-\x0D]+`` with A-Z in lower case; lines end at line feeds; lines without tokens stay.

Lines with one token set form a class; all but its first line go, so only first lines need a search:

1. Counters of fixed size over all texts put tokens into one global order, rare ones first.
2. The first ``n - ceil(t n) + 1`` tokens of every class are shuffled in packed blocks, each line with its place, its
   size and a bitmap of its tokens. Classes that share a token meet if their sizes allow the similarity (length
   filter), if the tokens from the shared one on do (positional filter: at the first token that two lines share, none
   before it counts, so a match is met there at the latest), and if the bitmaps' overlap does.
3. A class needs one earlier match only. So it brings at most ``asks`` candidates from each shared token; candidates
   are verified on the whole sets. Classes that had more and matched none are asked again, then without that bound,
   among the sets of all classes that met any.

Tokens, sets and texts are 64-bit fingerprints (sets together with their size).

Cases: a null text stays null and has no lines; an empty text stays empty; rows with equal id and text are one document
and get the same result; null ids come last; rows and other columns are kept (a column with a result's name is
replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm.rarity import bit_blocks, cell_scale, flagged
from tallyscope.llm.shingle_join import size_blocks
from tallyscope.llm.words import fingerprints, free_name, mixed, short_batches, split_words, text_pieces
from tallyscope.session import stored, swept

ORDER_CELLS = 1 << 22
FLAG_BITS = 1 << 23
#: 64-bit words of a line's bitmap: with 192 bits, lines of sixty tokens still lose few to each other.
MAP_WORDS = 3
#: What the counters give a token that stands once; no other line can share it.
ONCE = 6
#: Texts of an Arrow batch.
ROWS = 200
#: Candidates that a class brings from one shared token in the first round.
ASKS = 16
LAST = np.iinfo(np.int64).max

_U = np.uint64


def text_print(text: str) -> Column:
    return F.xxhash64(text)


def source_rows(docs: DataFrame, ids: str, text: str) -> DataFrame:
    return docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"), text_print(text).alias("print"))


def least_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(n * num / den)."""
    return -((-n * num) // den)


def globally_ordered(line: np.ndarray, scale: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of lines in the global order, line by line, and which of them so ordered equal the one before."""
    same = np.zeros(len(token), bool)
    if len(token) and line.max() < 65536:
        key = line.astype(_U) << _U(48)
        key |= scale.astype(_U) << _U(40)
        key |= token >> _U(24)
        by = np.argsort(key)
        key, token_ = key[by], token[by]
        same[1:] = key[1:] == key[:-1]
        tie = np.flatnonzero(same)
        if (token_[tie] == token_[tie - 1]).all():
            return by, same
    by = np.lexsort((token, scale, line))
    same[1:] = (line[by][1:] == line[by][:-1]) & (token[by][1:] == token[by][:-1])
    return by, same


def sorted_lines(raw: list[bytes], rank: np.ndarray):
    """Distinct tokens of every line in the global order: (line, token, scale) sorted, and per line its text and number, size and class."""
    words = split_words(raw)
    token = fingerprints(words.data, words.start, words.end)
    ends = np.flatnonzero(words.data == 10)
    line = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(words.start, ends), prepend=0))
    scale = rank[(token & _U(len(rank) - 1)).view(np.int64)]
    by, same = globally_ordered(line, scale, token)
    by = by[~same]
    line, token, scale = line[by], token[by], scale[by]
    n = np.bincount(line, minlength=len(ends))
    at = np.cumsum(n) - n
    key = np.zeros(len(ends), _U)
    full = n > 0
    if full.any():
        key[full] = mixed(np.add.reduceat(mixed(token ^ _U(0x2545F4914F6CDD1D)), at[full]) + n[full].astype(_U) * _U(0x9FB21C651E98DF25))
    text_end = np.cumsum([len(r) + 1 for r in raw]) - 1
    doc = np.searchsorted(text_end, ends)
    number = np.arange(len(ends)) - np.searchsorted(doc, doc)
    return line, token, scale, at, n, key.view(np.int64), doc, number


def bitmap(line: np.ndarray, token: np.ndarray, lines: int) -> np.ndarray:
    """The bits of each line, as words."""
    held = np.zeros((lines, 64 * MAP_WORDS), bool)
    held[line, ((token >> _U(48)) * _U(64 * MAP_WORDS) >> _U(16)).view(np.int64)] = True
    return np.packbits(held, axis=1, bitorder="little").view(_U)


def ranked(key: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    by = np.argsort(key)
    out = np.empty(len(key), _U)
    out[by] = np.cumsum(np.diff(key[by], prepend=key[by[:1]]) != 0)
    return out


def ordered(main: np.ndarray, second: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows in the order of three keys, the last below 2^32; plain sorts of 64-bit numbers, much faster than stable ones."""
    rank = ranked(ranked(main) << _U(32) | ranked(second))
    return np.argsort(rank << _U(32) | last.astype(_U))


def packed_blocks(values: np.ndarray, cut: np.ndarray, kind: type) -> pa.Array:
    """A binary column with the values from each cut to the next, stored as ``kind``."""
    values = np.ascontiguousarray(values, kind)
    offsets = (np.r_[cut, len(values)] * (values.nbytes // len(values))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.Array, begin: int, end: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of neighbouring blocks in one array, and how many each block has."""
    column = column.slice(begin, end - begin).cast(pa.binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (bounds[-1] - bounds[0]) // width, bounds[0]), np.diff(bounds) // width


def candidates(docs: DataFrame, ids: str, text: str, order, num: int, den: int, asks: int) -> DataFrame:
    """(class, other, more): an earlier class that may match; ``more``: the class may have further ones at that token.

    Classes that were left out so come with themselves as the other.
    """
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def post(batches):
        rank, best = order.value, {}
        for part, raw in text_pieces(batches):
            line, token, scale, at, n, key, doc, number = sorted_lines(raw, rank)
            a = part.column("id").fill_null(LAST).to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
            h = part.column("print").to_numpy()[doc]
            fresh = np.zeros(len(n), bool)
            some = np.flatnonzero(n)
            for row, k, where in zip(some.tolist(), key[some].tolist(), zip(a[some].tolist(), h[some].tolist(), number[some].tolist())):
                if k not in best or where < best[k]:  # a class is posted again only from an earlier place
                    best[k] = where
                    fresh[row] = True
            if len(best) > 200_000:
                best.clear()
            # The prefixes of these lines, without tokens that stand once.
            rows = np.flatnonzero(fresh)
            sizes = (n - least_size(n, num, den) + 1)[rows]
            place, mine = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(rows, sizes)
            take = at[mine] + place
            shared = np.flatnonzero(scale[take] != ONCE)
            mine, place, prefix = mine[shared], np.minimum(place[shared], 65535), token[take[shared]]
            bits = bitmap(line, token, len(n))
            bucket = (prefix >> _U(32)).astype(np.int64) % buckets
            by = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            mine, token, place, bucket = mine[by], prefix[by], place[by], bucket[by]
            if not len(mine):
                continue
            # A block per bucket: its tokens, their lines and the lines' texts stand together and are numbered within it.
            opens = np.diff(bucket, prepend=-1) != 0
            cut, line_opens = np.flatnonzero(opens), opens | (np.diff(mine, prepend=-1) != 0)
            rows, row = mine[line_opens], np.cumsum(line_opens) - 1
            text_opens = opens[line_opens] | (np.diff(doc[rows], prepend=-1) != 0)
            texts, text = rows[text_opens], np.cumsum(text_opens) - 1
            line_cut = row[cut]
            text_cut = text[line_cut]
            slot = row - np.repeat(line_cut, np.diff(np.r_[cut, len(mine)]))
            text_slot = text - np.repeat(text_cut, np.diff(np.r_[line_cut, len(rows)]))
            columns = [(token, cut), (place, cut), (slot, cut), (key[rows], line_cut), (n[rows], line_cut), (number[rows], line_cut), (text_slot, line_cut),
                       (np.stack([a[texts], h[texts]], 1), text_cut), (bits[rows], line_cut)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(packed_blocks(v, at, kind) for (v, at), kind in zip(columns, KINDS))], names=FIELDS)

    def meet(batches):
        current, held = None, []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
                if bucket[x] != current and held:
                    yield from pairs(held)
                    held = []
                current = bucket[x]
                (token, place, slot, key, n, number, text_slot, texts, bits), (_, _, tokens, lines, *_, spans, _) = zip(*(unpacked(c, x, y, k) for c, k in zip(batch.columns[1:], KINDS)))
                slot = slot + np.repeat(np.cumsum(lines) - lines, tokens)
                text_slot = text_slot + np.repeat(np.cumsum(spans // 2) - spans // 2, lines)
                texts, bits = texts.reshape(-1, 2), bits.reshape(-1, MAP_WORDS)
                a, h = texts[text_slot].T
                held.append((token, place, *(v[slot] for v in (key, n, number, a, h)), bits[slot]))
        if held:
            yield from pairs(held)

    def pairs(held):
        token, place, key, n, number, a, h, bits = (np.concatenate(v) for v in zip(*held))
        # Order of the lines, then one row per token and class: its first line.
        by = ordered(a, h, number)
        first = np.empty(len(by), np.int64)
        first[by] = np.arange(len(by))
        by = ordered(token.astype(_U) << _U(32) | n, key, first)
        new = np.ones(len(by), bool)
        new[1:] = (token[by][1:] != token[by][:-1]) | (key[by][1:] != key[by][:-1])
        by = by[new]
        token, place, key, n, first, bits = token[by], place[by].astype(np.int64), key[by], n[by].astype(np.int64), first[by], bits[by].T.copy()
        lost = n - np.bitwise_count(bits).sum(0, dtype=np.int64)
        brought, more, met = np.zeros(len(key), np.int64), np.zeros(len(key), bool), np.zeros(len(key), bool)
        # The largest partner that a line's tokens from here on leave room for; the length filter follows, as none stand before the first.
        most = (num + den) * (n - place) // num - n
        low = np.flatnonzero((token[1:] == token[:-1]) & (n[1:] <= most[:-1]))
        # Sorted by token and size: partners stand together, up to the token's last line of that size.
        last = np.searchsorted(token.astype(_U) << _U(32) | n.astype(_U), token[low].astype(_U) << _U(32) | np.minimum(most[low], 0xFFFFFFFF).astype(_U), side="right") - 1
        step = 0
        while True:
            step += 1
            keep = np.flatnonzero(last - low >= step)
            if not len(keep):
                break
            if len(keep) < len(low):
                low, last = low[keep], last[keep]
            x = low[n[low] <= most[low + step]]
            y = x + step
            overlap = np.minimum(lost[x], lost[y])
            for word in bits:
                overlap += np.bitwise_count(word[x] & word[y])
            fits = np.flatnonzero((num + den) * overlap >= num * (n[x] + n[y]))
            if not len(fits):
                continue
            x, y = x[fits], y[fits]
            z = np.where(first[x] > first[y], x, y)
            sure = brought[z] < asks
            more[z[~sure]] = met[x[~sure]] = met[y[~sure]] = True
            x, y, z = x[sure], y[sure], z[sure]
            np.add.at(brought, z, 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(key[np.where(z == x, y, x)]), pa.array(np.zeros(len(z), bool))], names=["class", "other", "more"])
        left = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(key[left]), pa.array(key[left]), pa.array(more[left])], names=["class", "other", "more"])

    packed = source_rows(docs, ids, text).mapInArrow(post, ", ".join(f"{f} {'long' if f == 'bucket' else 'binary'}" for f in FIELDS))
    met = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "class long, other long, more boolean")
    return met.groupBy("class", "other").agg(F.max("more").alias("more"))


FIELDS = ["bucket", "token", "place", "slot", "class", "n", "number", "text_slot", "texts", "bits"]
KINDS = [np.uint32, np.uint16, np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.uint64]


def line_classes(docs: DataFrame, ids: str, text: str, flags) -> DataFrame:
    """(class, lines, set): per class and piece the lines in their order, and the sorted tokens if the class is flagged."""
    def run(batches):
        rank = np.zeros(1, np.uint8)
        for part, raw in text_pieces(batches):
            _, token, _, at, n, key, doc, number = sorted_lines(raw, rank)
            texts = np.lexsort((part.column("print").to_numpy(), part.column("id").fill_null(LAST).to_numpy(), part.column("id").is_null().to_numpy(False)))
            rank_of = np.empty(len(texts), np.int64)
            rank_of[texts] = np.arange(len(texts))
            by = np.argsort(rank_of[doc], kind="stable")
            by = by[n[by] > 0]
            by = by[np.argsort(key[by], kind="stable")]
            cut = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(by) else np.zeros(0, np.int64)
            heads = by[cut]
            wanted = flagged(flags.value, key[heads])
            rows = pa.array(doc[by])
            struct = pa.StructArray.from_arrays([part.column("id").take(rows), part.column("print").take(rows), pa.array(number[by].astype(np.int32))], names=["id", "print", "line"])
            lines = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(by)], pa.int32()), struct)
            sets = [np.sort(token[at[x]:at[x] + n[x]]).tobytes() if w else None for x, w in zip(heads, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(key[heads]), lines, pa.array(sets, pa.binary())], names=["class", "lines", "set"])

    return source_rows(docs, ids, text).mapInArrow(run, "class long, lines array<struct<id: long, print: long, line: int>>, set binary")


def verified(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The classes of ``found`` whose sets really match the other's."""
    def run(batches):
        for batch in batches:
            hits = []
            for begin in range(0, batch.num_rows, 256):
                end = min(begin + 256, batch.num_rows)
                (x, n), (y, m) = (unpacked(batch.column(c), begin, end, _U) for c in ("x", "y"))
                # All pairs side by side: a token that both sets of a pair have is there twice.
                pair = np.concatenate([np.repeat(np.arange(end - begin), k) for k in (n, m)])
                mark = np.concatenate([x, y]) ^ mixed(np.arange(end - begin, dtype=_U) + _U(0x1B873593))[pair]
                by = np.argsort(mark)
                mark = mark[by]
                overlap = np.bincount(pair[by[1:][mark[1:] == mark[:-1]]], minlength=end - begin)
                hits.append(begin + np.flatnonzero(den * overlap >= num * (n + m - overlap)))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("class").to_numpy()[np.concatenate(hits)])], names=["class"])

    pairs = found.where("class != other").select("class", "other").join(sets.select("class", F.col("set").alias("x")), "class") \
        .join(sets.select(F.col("class").alias("other"), F.col("set").alias("y")), "other")
    return pairs.select("class", "x", "y").mapInArrow(run, "class long").distinct()


def removed_lines(docs: DataFrame, ids: str = "doc_id", text: str = "text", num: int = 4, den: int = 5, cells: int = ORDER_CELLS, asks: int = ASKS) -> DataFrame:
    """(id, print, lines): the numbers of the lines that go, for the documents that lose any."""
    spark = docs.sparkSession

    def prints(raw: list[bytes]) -> np.ndarray:
        words = split_words(raw)
        return fingerprints(words.data, words.start, words.end)

    def sets_of(pairs: DataFrame, of: DataFrame) -> DataFrame:
        wanted = pairs.select("class").union(pairs.select("other")).distinct()
        return stored(of.where("set is not null").groupBy("class").agg(F.first("set").alias("set")).join(wanted, "class", "left_semi"))

    with short_batches(spark, ROWS):
        order = spark.sparkContext.broadcast(cell_scale(docs, text, cells, prints))
        found = stored(candidates(docs, ids, text, order, num, den, asks))
    flags = spark.sparkContext.broadcast(bit_blocks(found.select("class").union(found.select("other")), FLAG_BITS))
    with short_batches(spark, ROWS):
        classes = stored(line_classes(docs, ids, text, flags))
    beaten = stored(verified(found, sets_of(found, classes), num, den))
    again = stored(found.groupBy("class").agg(F.max("more").alias("more")).where("more").join(beaten, "class", "left_anti").select("class"))
    swept(spark)
    if again.head() is not None:
        # All classes that these may match met another one and so have their sets here.
        found = further_beaten(classes, again, order, num, den)
        with short_batches(spark):
            beaten = stored(beaten.union(found).distinct())
        swept(spark)

    # Most classes are one line and stay; they drop out before any places are compared.
    heads = stored(classes.groupBy("class").agg(F.sum(F.size("lines")).alias("m")).join(beaten.withColumn("beaten", F.lit(True)), "class", "left")
                   .where("m > 1 or beaten").select("class", "beaten"))
    losing = stored(classes.select("class", "lines").join(heads, "class"))
    place, firsts = _place(), losing.groupBy("class").agg(F.min(_least_place()).alias("first"))
    lines = losing.join(firsts, "class").select("first", "beaten", F.explode("lines").alias("at")).select("first", "beaten", "at.*")
    gone = lines.where(F.col("beaten").isNotNull() | (place != F.col("first"))).groupBy("id", "print").agg(F.collect_set("line").alias("lines"))
    return gone


def _place(of=F.col) -> Column:
    """Order of lines: by id, nulls last, text and number."""
    return F.struct(of("id").isNull().alias("none"), of("id").alias("id"), of("print").alias("print"), of("line").alias("line"))


def _least_place() -> Column:
    return _place(lambda c: F.col("lines")[0][c])


def further_beaten(classes: DataFrame, again: DataFrame, order, num: int, den: int, rows: int = 128) -> DataFrame:
    """The classes of ``again`` that an earlier class matches, searched without a bound on candidates.

    A class is at home at the prefix token that most classes share with it. Wherever a class of ``again`` meets others
    at a token, its home is compared with theirs, in blocks of rows of like size: pairs of homes and blocks are rows,
    pairs of classes are cells of a product of incidence matrices.
    """
    def prefixes(bits):
        def run(batches):
            rank = order.value
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    end = min(begin + 1024, batch.num_rows)
                    token, n = unpacked(batch.column("set"), begin, end, _U)
                    row, place = np.repeat(np.arange(end - begin), n), np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
                    token = token[globally_ordered(row, rank[(token & _U(len(rank) - 1)).view(np.int64)], token)[0]]
                    keep = place < np.repeat(n - least_size(n, num, den) + 1, n)
                    token, row = token[keep], row[keep]
                    if bits is not None:
                        keep = flagged(bits.value, token)
                        token, row = token[keep], row[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(batch.column("class").to_numpy()[begin:end][row])], names=["token", "class"])
        return run

    def matches(batches):
        for batch in batches:
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                sets = [[np.frombuffer(r["set"], _U) for r in side] for side in (left, right)]
                tokens = np.unique(np.concatenate(sets[0]))
                table = []
                for side in sets:
                    held = np.zeros((len(side), len(tokens)), np.float32)
                    for k, one in enumerate(side):
                        at = np.minimum(np.searchsorted(tokens, one), len(tokens) - 1)
                        held[k, at[tokens[at] == one]] = 1
                    table.append(held)
                overlap = (table[0] @ table[1].T).astype(np.int64)
                size = [np.array([len(x) for x in side]) for side in sets]
                match = den * overlap >= num * (size[0][:, None] + size[1][None, :] - overlap)
                key = [[tuple(r["comp"].values()) for r in side] for side in (left, right)]
                hit = [left[i]["class"] for i in range(len(left)) if any(key[1][j] < key[0][i] for j in np.flatnonzero(match[i]).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], names=["class"])

    spark = classes.sparkSession
    # Places compare as tuples, so their parts are made comparable: nulls come last through the first.
    whole = classes.where("set is not null").groupBy("class").agg(F.min(_least_place()).alias("f"), F.max("set").alias("set"))
    comp = F.struct("f.none", F.coalesce("f.id", F.lit(0)).alias("id"), F.col("f.print").alias("print"), F.col("f.line").alias("line"))
    whole = whole.select("class", comp.alias("comp"), "set", F.floor(F.octet_length("set") / 8).alias("n"))
    flagged_sets = classes.where("set is not null").select("class", "set")
    asked = stored(flagged_sets.join(again, "class", "left_semi").dropDuplicates(["class"]).mapInArrow(prefixes(None), "token long, class long").select("token").distinct())
    # Only tokens of asking classes are posted, and only classes that meet one keep their sets.
    bits = spark.sparkContext.broadcast(bit_blocks(asked, FLAG_BITS))
    posted = stored(flagged_sets.mapInArrow(prefixes(bits), "token long, class long").join(asked, "token", "left_semi").distinct())
    whole = stored(whole.join(posted.select("class").distinct(), "class", "left_semi"))
    counts = posted.groupBy("token").agg(F.count("*").alias("m"))
    homes = stored(posted.join(counts, "token").groupBy("class").agg(F.max(F.struct("m", "token"))["token"].alias("home")))
    at = posted.join(homes, "class")
    mine = at.join(again, "class", "left_semi").select("token", F.col("home").alias("home2")).distinct()
    pairs = stored(mine.join(at.select("token", "home").distinct(), "token").select("home2", "home").distinct())
    full = whole.join(homes, "class")
    right = size_blocks(full.join(pairs.select("home").distinct(), "home", "left_semi"), "home", rows).withColumnRenamed("rows", "right")
    left = size_blocks(full.join(again, "class", "left_semi"), "home", rows) \
        .select(F.col("home").alias("home2"), F.col("rows").alias("left"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    swept(spark)
    blocks = pairs.join(left, "home2").join(right, "home").where((den * F.col("most") >= num * F.col("least2")) & (den * F.col("most2") >= num * F.col("least")))
    return blocks.select("left", "right").mapInArrow(matches, "class long").distinct()


def dedup_lines(docs: DataFrame, ids: str = "doc_id", text: str = "text", num: int = 4, den: int = 5, cells: int = ORDER_CELLS, asks: int = ASKS) -> DataFrame:
    """``docs`` with the later of matching lines taken out of ``text``, and the long columns n_lines and n_removed."""
    kept = docs.drop("n_lines", "n_removed")
    names = list(kept.columns)
    own, print_, gone_ = (free_name(docs, stem) for stem in ("_id", "_print", "_gone"))
    gone = stored(removed_lines(docs, ids, text, num, den, cells, asks)).select(F.col("id").alias(own), F.col("print").alias(print_), F.col("lines").alias(gone_))
    joined = kept.join(gone, F.col(ids).cast("long").eqNullSafe(F.col(own)) & (text_print(text) == F.col(print_)), "left").select(*[kept[c] for c in names], gone_)

    def rewrite(batches):
        for batch in batches:
            old, goes = batch.column(text), batch.column(gone_)
            n = pc.fill_null(pc.add(pc.count_substring(old, "\n"), 1), 0).cast(pa.int64())
            out = pc.fill_null(pc.list_value_length(goes), 0).cast(pa.int64())
            loses = goes.is_valid()
            new = []
            for value, lines in zip(old.filter(loses).to_pylist(), goes.filter(loses).to_pylist()):
                drop = set(lines)
                new.append("\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop))
            changed = pc.replace_with_mask(old, loses, pa.array(new, old.type)) if new else old
            yield pa.RecordBatch.from_arrays([*(changed if c == text else batch.column(c) for c in names), n, out], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(rewrite, kept.selectExpr("*", "0L AS n_lines", "0L AS n_removed").schema)
