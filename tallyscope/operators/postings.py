"""A kept index of character positions: phrases are found without reading the texts again.

Texts, in lower case, are written side by side into blocks of about ``BLOCK_CHARS`` characters. For each three
characters ("gram") of a block the index keeps all positions, ascending, as differences in a variable number of bytes.
The table is partitioned by a hash of the gram and sorted by it, so a question reads the partitions and row groups of
its grams only. Partition -1 holds, per block, the texts' keys, where they begin, and their lengths.

A phrase stands at a position if its grams at 0, 3, 6 … and at its end do: the sorted positions of a block's rarest gram
are intersected with those of the next one. Texts are one character apart, so no phrase runs over an end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import counted_side, cut_lineage, shared_folder

GRAM = 3
BUCKETS = 64
BLOCK_CHARS = 1 << 20
#: More asked grams than this are joined instead of being named in the scan's filter.
MAX_NAMED = 2000
#: Phrases that are searched in a block together, and hits that are handed on together.
PACK_PHRASES = 4096
BATCH_ROWS = 20_000


def pack_ascending(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ascending numbers as differences, seven bits a byte; lists begin at ``first``. Also where each list's bytes begin."""
    delta = values.astype(np.int64)
    delta[1:] -= values[:-1]
    delta[first] = values[first]
    size = 1 + sum((delta >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28, 35))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        more = size[some] > k + 1
        out[(ends - size)[some] + k] = (delta[some] >> (7 * k) & 127) | (more << 7)
    return out, np.append((ends - size)[first], len(out))


def unpack_ascending(packed: bytes) -> np.ndarray:
    """The numbers of one packed list."""
    b = np.frombuffer(packed, np.uint8).astype(np.int64)
    last = b < 128
    begin = np.flatnonzero(np.r_[True, last[:-1]]) if len(b) else np.zeros(0, np.int64)
    shift = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
    return np.cumsum(np.add.reduceat((b & 127) << (7 * shift), begin)) if len(b) else b


def block_postings(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Grams, their packed positions and byte offsets, and where texts begin, of texts side by side."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    chars = np.frombuffer("\0".join(texts).encode("utf-32-le") + b"\0\0\0\0", np.uint32).astype(np.int64)
    at = np.ones(len(chars), bool)
    for k in range(GRAM):  # windows that hold no gap between texts
        gap = begins[1:] - 1 - k
        at[gap[gap >= 0]] = False
    at = np.flatnonzero(at)
    key = np.zeros(len(at), np.int64)
    for k in range(GRAM):
        key = key << 21 | chars[at + k]
    by = np.argsort(key, kind="stable")
    key, at = key[by], at[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    packed, offsets = pack_ascending(at, first)
    letters = np.stack([key[first] >> 42, key[first] >> 21 & 0x1FFFFF, key[first] & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [letters[i:i + GRAM] for i in range(0, len(letters), GRAM)], packed, offsets, begins


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write the index of ``docs`` (null texts are empty) to a folder."""
    def run(batches):
        keys, texts, sizes, room, number = [], [], [], 0, 0
        home = TaskContext.get().partitionId() << 32

        def block():
            nonlocal number
            grams, packed, offsets, begins = block_postings(texts)
            mine = home | number
            number += 1
            lists = pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
            n = len(grams)
            buckets = pa.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], pa.int32())
            empty = pa.array([None] * n, kind)
            yield pa.RecordBatch.from_arrays([buckets, pa.array(grams, pa.string()), pa.array([mine] * n, pa.int64()), lists, empty], names=names)
            held = pa.array([[{"key": k, "begin": int(b), "size": s} for k, b, s in zip(keys, begins, sizes)]], kind)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([""], pa.string()), pa.array([mine], pa.int64()), pa.nulls(1, pa.binary()), held], names=names)

        for batch in batches:
            for k, low, size in zip(*(c.to_pylist() for c in batch.columns)):
                if texts and room + len(low) > BLOCK_CHARS:
                    yield from block()
                    keys, texts, sizes, room = [], [], [], 0
                keys.append(k)
                texts.append(low)
                sizes.append(size)
                room += len(low)
        if texts:
            yield from block()

    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).alias("key"), F.lower(whole).alias("low"), F.length(whole).cast("long").alias("size"))
    key_type = source.schema["key"].dataType
    names = ["bucket", "gram", "block", "positions", "texts"]
    kind = pa.list_(pa.struct([("key", _arrow(key_type.simpleString())), ("begin", pa.int64()), ("size", pa.int64())]))
    rows = source.mapInArrow(run, f"bucket int, gram string, block long, positions binary, texts array<struct<key: {key_type.simpleString()}, begin: long, size: long>>")
    # A bucket's rows go to several tasks by block where tasks are many, so no gram is one task's.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    rows.repartition("bucket", F.pmod("block", F.lit(parts))).sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def kept_index(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The index kept under ``name`` in the shared folder, written first if it is not there yet."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/postings-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        write_index(docs, key, text, path)
    return spark.read.parquet(path)


def content_name(spark: SparkSession, path: str) -> str:
    """A name for the files under a path, by where they are, how long and how old they are: a changed table gets a new index."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    marks = []
    while files.hasNext():
        one = files.next()
        marks.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return f"{zlib.crc32(chr(10).join(sorted(marks)).encode()):08x}-{len(marks)}"


def phrase_places(low: str, grams: dict[str, bytes], opened: dict[str, np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Numbers of the texts of a block that hold a phrase, how often (not overlapping) and where first; None if none does.

    ``grams`` are the block's packed positions, ``opened`` those unpacked so far.
    """
    last = len(low) - GRAM
    parts = {o: low[o:o + GRAM] for o in (*range(0, last, GRAM), last)}
    if any(g not in grams for g in parts.values()):
        return None
    at = None
    for o, g in sorted(parts.items(), key=lambda x: len(grams[x[1]])):  # the rarest first
        if g not in opened:
            opened[g] = unpack_ascending(grams[g])
        if at is None:
            at = opened[g] - o
        else:
            spot = np.searchsorted(opened[g], at + o)
            spot[spot == len(opened[g])] = 0
            at = at[opened[g][spot] == at + o]
        if not len(at):
            return None
    text = np.searchsorted(begins, at, side="right") - 1
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    tf = np.diff(np.append(start, len(at)))
    near = (np.diff(at) < len(low)) & (text[1:] == text[:-1])
    for k in np.unique(np.searchsorted(start, np.flatnonzero(near), side="right") - 1).tolist():  # overlapping places: count from the left
        n, end = 0, -1
        for x in at[start[k]:start[k] + tf[k]].tolist():
            if x >= end:
                n, end = n + 1, x + len(low)
        tf[k] = n
    return text[start], tf, at[start] - begins[text[start]]


def find_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, key, tf, first, size): how often, not overlapping, and where first a phrase stands in a text, letter case aside.

    Phrases under three characters find nothing. ``size`` is the text's length in characters.
    """
    p = cut_lineage(phrases.where(F.length(F.trim("phrase")) >= GRAM).select("phrase", F.lower("phrase").alias("low")).distinct())
    p = p.withColumn("pack", F.pmod(F.xxhash64("phrase"), F.lit(p.count() // PACK_PHRASES + 1)).cast("int"))
    last = F.length("low") - GRAM
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
    asked = p.select("pack", "low", F.explode(offsets).alias("offset")).select("pack", F.substring("low", F.col("offset") + 1, F.lit(GRAM)).alias("gram")).distinct() \
        .withColumn("bucket", F.pmod(F.crc32(F.encode("gram", "utf-8")), F.lit(BUCKETS)).cast("int"))
    named = asked.select("gram", "bucket").distinct().limit(MAX_NAMED + 1).collect()
    rows = index.where("bucket >= 0")
    if len(named) <= MAX_NAMED:
        rows = rows.where(F.col("bucket").isin(*{r.bucket for r in named}) & F.col("gram").isin(*[r.gram for r in named])) if named else rows.where(F.lit(False))
    lists = rows.join(counted_side(asked), ["bucket", "gram"]).select("block", "pack", "gram", "positions")
    heads = index.where("bucket = -1").select("block", "texts").crossJoin(p.groupBy("pack").agg(F.collect_list(F.struct("phrase", "low")).alias("phrases")))
    # Per block and pack: the texts and phrases, then each asked gram's positions once, whatever number of phrases has it.
    dealt = heads.unionByName(lists, allowMissingColumns=True).repartition("block", "pack").sortWithinPartitions("block", "pack", F.col("texts").isNull())
    key_type = index.schema["texts"].dataType.elementType["key"].dataType.simpleString()
    schema = pa.schema([("phrase", pa.string()), ("key", _arrow(key_type)), ("tf", pa.int64()), ("first", pa.int64()), ("size", pa.int64())])

    def run(batches):
        texts, asked, grams = None, [], {}

        def found():
            if not grams:
                return
            begins, sizes = (texts.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "size"))
            open_lists, out, ready = {}, [], 0
            for one in asked:
                hit = phrase_places(one["low"], grams, open_lists, begins)
                if hit is not None:
                    t, tf, first = hit
                    out.append(pa.RecordBatch.from_arrays([pa.array([one["phrase"]] * len(t), pa.string()), texts.field("key").take(pa.array(t)), pa.array(tf), pa.array(first), pa.array(sizes[t])], schema=schema))
                    ready += len(t)
                    if ready >= BATCH_ROWS:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, ready = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for batch in batches:
            heads, names, positions = batch.column("texts"), batch.column("gram"), batch.column("positions")
            for i, head in enumerate(heads.is_valid().to_pylist()):
                if head:
                    yield from found()
                    texts, asked, grams = heads[i].values, batch.column("phrases")[i].as_py(), {}
                else:
                    grams[names[i].as_py()] = positions[i].as_py()
        yield from found()

    return dealt.select("texts", "phrases", "gram", "positions").mapInArrow(run, f"phrase string, key {key_type}, tf long, first long, size long")


def ranked_phrases(index: DataFrame, phrases: DataFrame, k1: float, b: float) -> DataFrame:
    """``find_phrases`` with the BM25 score of the phrase as one term; lengths are in grams and come from the index."""
    grams = F.greatest(F.col("size") - (GRAM - 1), F.lit(0).cast("long"))
    sizes = index.where("bucket = -1").select(F.explode("texts").alias("t")).select(F.col("t.size").alias("size"))
    total = sizes.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(grams).alias("avg")).alias("total"))
    found = find_phrases(index, phrases)
    return bm25(found.withColumn("length", grams), total, k1, b).drop("length")


def bm25(hits: DataFrame, total: DataFrame, k1: float, b: float) -> DataFrame:
    """``score`` for (phrase, tf, length) rows; ``total``: one row with a struct of the number and mean length of texts."""
    hits = cut_lineage(hits)
    df = counted_side(hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("_df")))
    d = hits.join(df, "phrase").withColumn("total", total.scalar())
    idf = F.greatest(F.log((F.col("total.n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    norm = 1 - b + b * F.col("length") / F.col("total.avg")
    return d.withColumn("score", idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)).drop("total", "_df")

