"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, exact sorted-array intersection.

Documents with the same set of word shingles form a class. Classes are joined exactly:

1. Counters of fixed size, over all shingles of all texts, give every shingle one place in a global order, rare ones
   first. Any order is right; this one keeps frequent passages out of the prefixes.
2. Two classes that link share a shingle among the first ``n - ceil(t n) + 1`` of each, and k of them if the prefixes
   are k - 1 longer. The longer prefixes are shuffled as packed blocks; shingles that only one class has end there,
   and so do classes that share fewer than k with any others (a common passage is not enough). The shingles left of
   the shorter prefixes tell which classes meet.
3. A class is at home at the shingle where it meets most others. Tiles are blocks of classes of one home and one band of
   sizes. First each class is compared with a few heads of its home, which connects most groups. Then, wherever
   several components meet at a shingle, the homes of all classes outside the largest are compared with all homes
   there, tile against tile where the bands allow it. Pairs of homes and tiles are rows, pairs of classes never are,
   and pairs already connected are left out. Bitmap signatures bound the overlap from above; only pairs that may still
   link have their sorted arrays intersected.

Shingles and classes are 64-bit fingerprints (classes together with their size).

Cases: null, empty or blank texts have no shingles and link with nothing; shorter texts than a shingle are one
shingle; null ids take part and get the least known id of their component; repeated rows are copies of each other;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.components import component_labels
from tallyscope.llm.rarity import bit_blocks, cell_scale, flagged
from tallyscope.llm.words import combined, fingerprints, mixed, shingle_sets, short_batches, split_words, text_pieces
from tallyscope.session import stored, swept

#: Counters for the order of shingles, and bits to tell classes that met another one; both of fixed size.
ORDER_CELLS = 1 << 21
MET_BITS = 1 << 23
#: Rows of a block of the last comparison.
TILE_ROWS = 128
#: Classes of a home that all others of it are compared with, before the complete comparison.
HEADS = 8

_U = np.uint64


def classes_of(batches, text: str, width: int):
    """Per piece: the batch, per row size and class, and the (row, shingle) pairs, sorted."""
    for part, raw in text_pieces(batches, text):
        words = split_words(raw)
        doc, shingle = shingle_sets(words, fingerprints(words.data, words.start, words.end), width)
        n = np.bincount(doc, minlength=len(raw))
        at = np.cumsum(n) - n
        key = np.zeros(len(raw), _U)
        full = n > 0
        if full.any():
            key[full] = mixed(np.add.reduceat(mixed(shingle ^ _U(0x5851F42D4C957F2D)), at[full]) + n[full].astype(_U) * _U(0x14057B7EF767814F))
        yield part, n, key.view(np.int64), at, shingle


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set of n of which a linked set must share one: n - ceil(n * num / den) + 1."""
    return n + (-n * num) // den + 1


def extra_length(n: np.ndarray) -> np.ndarray:
    """Shingles that two linked sets must share in their longer prefixes (of the smaller set, by its size)."""
    return np.maximum(-(-n // 8), 1)


def prefix_postings(docs: DataFrame, text: str, width: int, num: int, den: int, cells: int) -> DataFrame:
    """(shingle, class, n, inner) of shingles that two or more classes have in their longer prefixes."""
    spark = docs.sparkSession

    def prints(raw: list[bytes]) -> np.ndarray:
        words = split_words(raw)
        runs = combined(fingerprints(words.data, words.start, words.end), width)
        return runs[words.doc[:len(runs)] == words.doc[width - 1:width - 1 + len(runs)]]

    order = spark.sparkContext.broadcast(cell_scale(docs, text, cells, prints))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def post(batches):
        rank, seen = order.value, set()
        for part, n, key, at, shingle in classes_of(batches, text, width):
            fresh = np.zeros(len(n), bool)
            for row, k in enumerate(key.tolist()):  # a class is posted once by a task
                if n[row] and k not in seen:
                    seen.add(k)
                    fresh[row] = True
            if len(seen) > 500_000:
                seen.clear()
            doc = np.repeat(np.arange(len(n)), n)
            take = fresh[doc]
            doc, mine = doc[take], shingle[take]
            # By row, then rarity, then fingerprint: the pairs are already sorted by row and fingerprint.
            by = np.argsort(doc * 256 + rank[(mine & _U(cells - 1)).astype(np.int64)], kind="stable")
            doc, mine = doc[by], mine[by]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            inner = prefix_length(n, num, den)
            take = place < (inner + extra_length(n) - 1)[doc]
            # The lowest bit tells whether the shingle belongs to the shorter prefix.
            mine = mine & ~_U(1) | (place < inner[doc])
            doc, mine = doc[take], mine[take]
            bucket = (mine >> _U(32)).astype(np.int64) % buckets
            by = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            doc, mine, bucket = doc[by], mine[by], bucket[by]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            columns = [[], [], [], []]
            for a, b in zip(cut, [*cut[1:], len(doc)]):
                rows, slot = np.unique(doc[a:b], return_inverse=True)
                columns[0].append(int(bucket[a]))
                columns[1].append(mine[a:b].tobytes())
                columns[2].append(slot.astype(np.uint32).tobytes() if len(rows) > 65535 else slot.astype(np.uint16).tobytes())
                columns[3].append(np.stack([key[rows], n[rows]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "shingle", "slot", "class"])

    def met(batches):
        current, held = None, []

        def shared():
            shingle = np.concatenate([h[0] for h in held])
            key, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            by = np.lexsort((key, n, shingle >> _U(1)))
            shingle, key, n = shingle[by], key[by], n[by]
            inner, shingle = (shingle & _U(1)).astype(bool), shingle >> _U(1)
            new = np.ones(len(by), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
            shingle, key, n, inner = shingle[new], key[new], n[new], inner[new]
            # Neighbours in order of size: if they are too unlike, so are all others.
            twin = np.zeros(len(shingle) + 1, bool)
            twin[1:-1] = (shingle[1:] == shingle[:-1]) & (den * n[:-1] >= num * n[1:])
            keep = twin[1:] | twin[:-1]
            return pa.RecordBatch.from_arrays([pa.array(shingle[keep].view(np.int64)), pa.array(key[keep]), pa.array(n[keep]), pa.array(inner[keep])], names=["shingle", "class", "n", "inner"])

        for batch in batches:
            for bucket, shingle, slot, klass in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and held:
                    yield shared()
                    held = []
                current = bucket
                table = np.frombuffer(klass, np.int64).reshape(2, -1)
                mine = np.frombuffer(shingle, _U)
                at = np.frombuffer(slot, np.uint16 if len(slot) == 2 * len(mine) else np.uint32)
                held.append((mine, table[0][at], table[1][at]))
        if held:
            yield shared()

    packed = docs.select(text).mapInArrow(post, "bucket long, shingle binary, slot binary, class binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(met, "shingle long, class long, n long, inner boolean")


def class_rows(docs: DataFrame, ids: str, text: str, width: int, met: np.ndarray) -> DataFrame:
    """(class, n, ids, sets): a row for each class of each piece; the sorted set is there if the class may have met another."""
    shipped = docs.sparkSession.sparkContext.broadcast(met)

    def run(batches):
        for part, n, key, at, shingle in classes_of(batches, text, width):
            own = part.column(ids)
            by = np.argsort(key, kind="stable")
            by = by[n[by] > 0]
            cut = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(by) else np.zeros(0, np.int64)
            heads = by[cut]
            wanted = flagged(shipped.value, key[heads])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(by)], pa.int32()), own.take(pa.array(by)))
            sets = [shingle[at[h]:at[h] + n[h]].tobytes() if w else None for h, w in zip(heads, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(n[heads]), lists, pa.array(sets, pa.binary())], names=["class", "n", "ids", "set"])
            none = np.flatnonzero(n == 0)
            for begin in range(0, len(none), 4096):  # texts without words stand alone: class null
                some = own.take(pa.array(none[begin:begin + 4096]))
                size = len(some)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(np.zeros(size, np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(size + 1), pa.int32()), some), pa.nulls(size, pa.binary())], names=["class", "n", "ids", "set"])

    return docs.select(F.col(ids).cast("long").alias(ids), text).mapInArrow(run, "class long, n long, ids array<long>, set binary")


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in enumerate(sets):
        cells = np.zeros(bits, np.uint8)
        cells[(s & _U(bits - 1)).astype(np.int64)] = 1
        out[row] = np.packbits(cells)
    return out.view(_U)


class _Joined(dict):
    """Which rows of the blocks at hand are connected already."""

    def root(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = x = self.get(self[x], self[x])
        return x


def linked_rows(left: list, right: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links between two blocks of (class, component, set) that connect what was not connected."""
    if not left or not right:
        return []
    a_n, b_n = np.array([len(r[2]) for r in left]), np.array([len(r[2]) for r in right])
    bits = 1 << max(9, math.ceil(math.log2(2 * max(a_n.max(), b_n.max()))))
    a_bits, b_bits = _bitmaps([r[2] for r in left], bits), _bitmaps([r[2] for r in right], bits)
    a_lost = a_n - np.bitwise_count(a_bits).sum(1, dtype=np.int64)
    b_lost = b_n - np.bitwise_count(b_bits).sum(1, dtype=np.int64)
    joined, out = _Joined(), []
    for i, row in enumerate(left):
        most = np.bitwise_count(a_bits[i] & b_bits).sum(1, dtype=np.int64) + np.minimum(a_lost[i], b_lost)
        most = np.minimum(most, np.minimum(a_n[i], b_n))
        # overlap / (a + b - overlap) >= num / den, with the bound for the overlap
        for j in np.flatnonzero((den + num) * most >= num * (a_n[i] + b_n)).tolist():
            x, y = joined.root(row[1]), joined.root(right[j][1])
            if x == y:
                continue
            overlap = len(np.intersect1d(row[2], right[j][2], assume_unique=True))
            if den * overlap >= num * (a_n[i] + b_n[j] - overlap):
                joined[max(x, y)] = min(x, y)
                out.append((row[0], right[j][0]))
    return out


def _links(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of rows that hold two blocks: arrays of (class, component, set)."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                pair = [[(r["class"], r["comp"], np.frombuffer(r["set"], _U)) for r in batch.column(c)[at].as_py()] for c in ("left", "right")]
                found = linked_rows(*pair, num, den)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return blocks.select("left", "right").mapInArrow(run, "a long, b long")


def meeting_classes(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, class, n) of the shorter prefixes, for the classes that share enough of their longer ones."""
    size = F.ceil(F.col("n") * num / den)
    enough = shared.groupBy("class").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= F.greatest(F.ceil(size / 8), F.lit(1))).select("class")
    return shared.where("inner").select("shingle", "class", "n").join(enough, "class", "left_semi")


def homes_of(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(class, n, home): the shingle at which a class meets most others (one of four will do), or itself."""
    some = postings.where(F.pmod("shingle", F.lit(4)) == 0)
    counts = some.groupBy("shingle").agg(F.count("*").alias("m"))
    home = some.join(counts, "shingle").groupBy("class").agg(F.max(F.struct("m", "shingle"))["shingle"].alias("home"))
    return sets.select("class", "n").join(home, "class", "left").select("class", "n", F.coalesce("home", "class").alias("home"))


def star_links(homes: DataFrame, sets: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """Links of each class with a few heads of its home."""
    one = [F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("h"), "class"))["class"].alias(f"h{i}") for i in range(HEADS)]
    heads = homes.groupBy("home").agg(F.count("*").alias("m"), *one).where("m > 1") \
        .select("home", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("class"))
    item = sets.select("class", "set", F.col("class").alias("comp"))
    right = heads.join(item, "class").groupBy("home").agg(F.collect_list(F.struct("class", "comp", "set")).alias("right"))
    left = size_blocks(homes.join(item, "class"), "home", rows).select("home", F.col("rows").alias("left"))
    return _links(left.join(right, "home"), num, den)


def jaccard_links(postings: DataFrame, sets: DataFrame, num: int, den: int, rows: int = TILE_ROWS) -> DataFrame:
    """Links that connect every two classes with Jaccard >= num / den; classes of one component need not be linked directly."""
    homes = stored(homes_of(postings, sets))
    with short_batches(postings.sparkSession):
        links = stored(star_links(homes, sets, num, den, rows))
    swept(postings.sparkSession)
    labels = component_labels(links, 2).withColumnRenamed("id", "class")
    known = stored(homes.join(labels, "class", "left").withColumn("comp", F.coalesce("label", "class")).drop("label"))

    # Shingles at which several components meet; all classes outside the largest of them ask.
    meeting = postings.select("shingle", "class").join(known.select("class", "home", "comp"), "class")
    open_shingles = meeting.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("shingle")
    meeting = stored(meeting.join(open_shingles, "shingle", "left_semi"))
    parts = meeting.groupBy("shingle", "comp").agg(F.count("*").alias("m"))
    main = parts.groupBy("shingle").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))
    minor = stored(meeting.join(main, "shingle").where("comp != main").select("shingle", "class", "home"))
    # Their homes against all homes there: a pair of homes once, however many shingles and classes they share.
    pairs = minor.select("shingle", F.col("home").alias("home2")).distinct().join(meeting.select("shingle", "home").distinct(), "shingle").select("home2", "home").distinct()
    pairs = stored(pairs)
    swept(postings.sparkSession)
    full = known.join(sets.select("class", "set"), "class")
    right = size_blocks(full.join(pairs.select("home").distinct(), "home", "left_semi"), "home", rows).withColumnRenamed("rows", "right")
    left = size_blocks(full.join(minor.select("class").distinct(), "class", "left_semi"), "home", rows) \
        .select(F.col("home").alias("home2"), F.col("rows").alias("left"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    tiles = pairs.join(left, "home2").join(right, "home").where((den * F.col("most") >= num * F.col("least2")) & (den * F.col("most2") >= num * F.col("least")))
    with short_batches(postings.sparkSession):
        return stored(links.union(_links(tiles, num, den)))


def size_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Arrays of about ``size`` rows (class, comp, set), or a megabyte of them, of a key, near each other in size.

    A key's rows are dealt by size bands and, within a band, by a number that grows with the key's own count, so no
    sort brings a key's rows to one task.
    """
    band = F.floor(F.log2(F.col("n").cast("double")) * 4).alias("band")
    counts = rows.groupBy(key, band).agg(F.count("*").alias("m"), F.max("n").alias("largest"))
    room = F.greatest(F.least(F.lit(size), F.floor((1 << 17) / F.col("largest"))), F.lit(1))
    dealt = rows.withColumn("band", band).join(counts, [key, "band"]).withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("m") / room)))
    return dealt.groupBy(key, "band", "part").agg(F.collect_list(F.struct("class", "comp", "set")).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"))


def jaccard_components(docs: DataFrame, ids: str = "doc_id", text: str = "text", width: int = 5, num: int = 3, den: int = 4,
                       cells: int = ORDER_CELLS, rows: int = TILE_ROWS) -> DataFrame:
    """(ids, n_shingles, component_id) of every row: its set's size and the least id that links reach from it.

    Two rows link when their sets of ``width``-word shingles have Jaccard similarity ``num / den`` or more.
    """
    spark = docs.sparkSession
    postings = stored(meeting_classes(stored(prefix_postings(docs, text, width, num, den, cells)), num, den))

    met = bit_blocks(postings.select("class"), MET_BITS)
    rows_of_classes = stored(class_rows(docs, ids, text, width, met))
    sets = rows_of_classes.where("set is not null").groupBy("class", "n").agg(F.first("set").alias("set"))
    sets = stored(sets.join(postings.select("class").distinct(), "class", "left_semi"))
    swept(spark)
    labels = component_labels(jaccard_links(postings, sets, num, den, rows))

    members = rows_of_classes.select("class", "n", "ids").join(labels.withColumnRenamed("id", "class"), "class", "left") \
        .withColumn("comp", F.coalesce("label", "class")).withColumn("low", F.array_min("ids"))
    least = members.where("comp is not null").groupBy("comp").agg(F.min("low").alias("component_id"))
    named = members.join(least, "comp", "left").select(F.explode("ids").alias(ids), F.col("n").alias("n_shingles"), F.col("component_id"), F.col("class"))
    return named.select(ids, "n_shingles", F.when(F.col("class").isNull(), F.col(ids)).otherwise(F.col("component_id")).alias("component_id"))
