"""Words, lines and fingerprints of whole texts, computed on flat byte arrays, a few megabytes at a time.

Everything here runs inside ``mapInArrow`` tasks. Texts are UTF-8, and every rule is stated on bytes, so
cutting at bytes never cuts a character: separators are ASCII and bytes of longer characters are above 0x7F.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyscope.session import shared_folder

#: A-Z become a-z, every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: 1 for bytes that belong to a word ``[^\x20\x09-\x0D]+``.
SPACED = bytes(0 if c == 0x20 or 0x09 <= c <= 0x0D else 1 for c in range(256))
#: 1 for bytes that belong to a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, anything beyond ASCII).
LETTERED = bytes(1 if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256))

_U = np.uint64
PIECE_BYTES = 2 << 20


class Words(NamedTuple):
    data: np.ndarray  # all texts, lower-cased, one line end after each
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    doc: np.ndarray  # the text (row of the piece) it stands in
    first: np.ndarray  # first[d]:first[d + 1] are the words of text d


def released() -> None:
    """Give back to the system what earlier tasks of this worker left free; workers outlive tasks and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts; null is an empty text.

    A text is never cut: one that is longer than the limit makes a slice of its own.
    """
    released()
    for batch in batches:
        raw = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        begin = size = 0
        for i, text in enumerate(raw):
            if size and size + len(text) > limit:
                yield batch.slice(begin, i - begin), raw[begin:i]
                begin, size = i, 0
            size += len(text)
        if begin < len(raw):
            yield batch.slice(begin), raw[begin:]


def split_words(raw: list[bytes], table: bytes = SPACED, lower: bool = True) -> Words:
    """The maximal runs of bytes that ``table`` marks, text by text."""
    data = b"\n".join(raw) + b"\n"
    if lower:
        data = data.translate(LOWER)
    inside = np.frombuffer(b"\0" + data.translate(table), np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends in turn
    start, end = edge[::2].copy(), edge[1::2].copy()
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(start, begins)
    return Words(np.frombuffer(data, np.uint8), start, end, np.repeat(np.arange(len(raw)), np.diff(first)), first)


class CodedWords(NamedTuple):
    code: np.ndarray  # per word, its row in the vocabulary
    vocabulary: pa.Array  # the distinct words, exactly told apart
    prints: np.ndarray  # and their fingerprints
    text: np.ndarray  # per word, the text it stands in
    start: np.ndarray  # per word, its first byte in all texts joined by line ends
    kind: np.ndarray  # per byte of those, what the table says


def text_parts(batches: Iterable[pa.RecordBatch], limit: int, ends: re.Pattern[bytes]) -> Iterator[tuple[list[bytes], list[tuple], list[int], list[bool]]]:
    """Texts of about ``limit`` bytes together, the other columns' values, running row numbers, and whether a text is a part.

    The last column is the text; null is an empty text. Longer texts are cut behind the next match of ``ends``.
    """
    released()
    texts, heads, numbers, parted, size, number = [], [], [], [], 0, 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.columns[-1].cast(pa.binary()).to_pylist()):
            text, begin, number = text or b"", 0, number + 1
            while begin < len(text):
                end = len(text)
                if end - begin > limit:
                    found = ends.search(text, begin + limit)
                    end = found.end() if found else end
                if size and size + end - begin > limit:
                    yield texts, heads, numbers, parted
                    texts, heads, numbers, parted, size = [], [], [], [], 0
                texts.append(text[begin:end])
                heads.append(tuple(c[i] for c in columns))
                numbers.append(number)
                parted.append(begin > 0 or end < len(text))
                size += end - begin
                begin = end
    if texts:
        yield texts, heads, numbers, parted


def coded_words(texts: list[bytes], table: bytes) -> CodedWords:
    """The words of some texts, A-Z in lower case: maximal runs of bytes that ``table`` gives 0."""
    joined = (b"\n".join(texts) + b"\n").translate(LOWER)
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(table), np.uint8)
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return CodedWords(coded.indices.to_numpy().astype(np.int64), coded.dictionary, word_prints(coded.dictionary), text, start, kind)


def word_prints(words: pa.Array) -> np.ndarray:
    """Fingerprints of an Arrow column of words without nulls."""
    words = pa.concat_arrays([words.cast(pa.binary())])
    if not len(words):
        return np.zeros(0, _U)
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + words.offset + 1)[words.offset:].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    return fingerprints(letters, bounds[:-1], bounds[1:])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: Bytes of a word that count among eight, by its length.
_BYTES = np.array([0xFFFFFFFFFFFFFFFF >> 8 * (8 - n) if n else 0 for n in range(9)], _U)
#: What fingerprints of short ranges begin with, by their length.
_SEEDS = mixed(np.arange(256, dtype=_U) + _U(0x9E3779B97F4A7C15))
#: Ranges that are fingerprinted together, few enough for a processor's cache.
_RANGES = 1 << 13


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte ranges, eight bytes a step; ranges of up to eight bytes never collide with each other's bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    result = np.empty(len(start), _U)
    for begin in range(0, len(start), _RANGES):
        pos = start[begin:begin + _RANGES]
        left = end[begin:begin + _RANGES] - pos
        out = _SEEDS[np.minimum(left, len(_SEEDS) - 1)]
        long = np.flatnonzero(left >= len(_SEEDS))
        out[long] = mixed(left[long].astype(_U) + _U(0x9E3779B97F4A7C15))
        out ^= eight[pos] & _BYTES[np.minimum(left, 8)]
        out = mixed(out)
        out += _U(0x632BE59BD9B4E019)
        at = np.flatnonzero(left > 8)
        pos, left = pos[at] + 8, left[at] - 8
        while len(at):
            out[at] = mixed(out[at] ^ eight[pos] & _BYTES[np.minimum(left, 8)]) + _U(0x632BE59BD9B4E019)
            more = left > 8
            at, pos, left = at[more], pos[more] + 8, left[more] - 8
        result[begin:begin + _RANGES] = mixed(out)
    return result


def combined(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` neighbouring values of ``h`` (the caller drops runs that cross texts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, width, _U)
    for k in range(width):
        out = mixed(out * _U(0xD6E8FEB86659FD93) + h[k:k + n])
    return out


def shingle_sets(words: Words, h: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of the distinct runs of ``width`` words of every text, sorted; a shorter text is one run."""
    runs = combined(h, width)
    doc = words.doc[:len(runs)]
    inside = doc == words.doc[width - 1:width - 1 + len(runs)]
    runs, doc = runs[inside], doc[inside]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([combined(h[words.first[d]:words.first[d + 1]], int(n[d]))[0] for d in short], _U)
        runs, doc = np.concatenate([runs, whole]), np.concatenate([doc, short])
    return distinct_pairs(doc, runs)


def distinct_pairs(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value), sorted by both; groups are small row numbers."""
    order = np.argsort(value)
    narrow = group[order].astype(np.uint16 if len(group) and group.max() < 65536 else np.int64)
    order = order[np.argsort(narrow, kind="stable")]
    group, value = group[order], value[order]
    keep = np.ones(len(group), bool)
    keep[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return group[keep], value[keep]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 4):
    """Arrow batches of a few rows for jobs run inside, whose rows are blocks of a megabyte or so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that ``frame`` does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ship_file(spark: SparkSession, payload: bytes, stem: str) -> str:
    """Write bytes of bounded size to the shared folder and let Spark hand the file to every executor; its name."""
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(payload))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name
