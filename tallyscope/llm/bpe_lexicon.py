"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

``compile_lexicon`` counts the words of the whole corpus, keeps the most frequent (their number is a bound on the
file, not on the text: every other word is merged exactly), encodes them and compiles them into a minimal acyclic
automaton. Words share prefixes and suffixes; the outputs on its arcs add up to a word's number, which leads to its
ids. The file goes to the shared folder, Spark hands it to the executors, and tasks map it into memory.

``encode`` looks the distinct words of a batch up in the automaton, all words one byte a step, merges unseen words
by rank, and returns the ids. ``decode`` joins the tokens of the ids. Both equal the tokenizers library with the
same file (``add_special_tokens=False``, ``skip_special_tokens=False``).

Cases: a null or empty text gives an empty id list, which decodes to an empty text; null ids decode to an empty
text; special token strings in a text give their ids; rows, repeated or not, and extra columns are kept (a column
with a result's name is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from tallyscope.llm.words import list_array, released, ship_file
from tallyscope.session import stored

#: Most words in a lexicon, and the number of times a word has to occur to be worth a place.
LEXICON_WORDS = 40_000
LEXICON_COUNT = 8
#: Words remembered by a task, and words counted by it before it hands partial counts on.
MEMO = 250_000
PARTIAL = 100_000


#: Ids are below 2 ** SHIFT; NEVER is above every rank.
SHIFT, NEVER = 24, 1 << 40
#: The pattern of the word-level file; texts of the Latin blocks take a faster equal of it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# --------------------------------------------------------------------------- the tokenizer file
class Rules:
    """The fixed parts of a word-level BPE file: words of a text, merges, ids, special strings."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        self.vocabulary = spec["model"]["vocab"]
        merges = spec["model"]["merges"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        self.library = Tokenizer.from_str(source)
        # The alphabet of byte-level BPE: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else None for b in range(256)]
        self.letters = [x or chr(next(moved)) for x in self.letters]
        self.strange = re.compile("[^\0-ɏ]")
        latin = [chr(c) for c in range(0x250)]
        letter = "".join(c for c in latin if regex.match(r"\p{L}", c))
        number = "".join(c for c in latin if regex.match(r"\p{N}", c))
        space = "".join(c for c in latin if regex.match(r"\s", c))
        # The file's pattern for texts of the Latin blocks, letters first: no other branch begins with one.
        self.latin = pattern == WORD_PATTERN and re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{re.escape(space)}{letter}{number}]+")
        self.back = {c: b for b, c in enumerate(self.letters)}
        pairs = [(self.vocabulary[x], self.vocabulary[y], self.vocabulary[x + y]) for x, y in self.rank]
        joined = np.array([p << SHIFT | q for p, q, _ in pairs], np.int64)
        by = np.argsort(joined)
        self.pair, self.pair_rank, self.made = joined[by], by, np.array([r for _, _, r in pairs], np.int64)
        self.inner = np.array([self.vocabulary[c] for c in self.letters], np.int64)
        self.closing = np.array([self.vocabulary[c + self.suffix] for c in self.letters], np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings.

        Letters of the Latin blocks need no composition and have one lower case in every Unicode version; any other
        text goes through the library's own normaliser and word cutter, whose byte alphabet is turned back.
        """
        if self.latin and not self.strange.search(text):
            return self.latin.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.back.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER where they do not merge or one is missing (-1)."""
        want = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where((self.pair[at] == want) & (left >= 0) & (right >= 0), self.pair_rank[at], NEVER)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: again and again every word joins its leftmost pair of lowest rank, all words side by side."""
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        # Words of similar length share a matrix: one row each, -1 after its last symbol.
        group = np.ceil(np.log2(np.maximum(size, 4))).astype(np.int64)
        for g in np.unique(group[size > 0]).tolist():
            row = np.flatnonzero((group == g) & (size > 0))
            for cut in range(0, len(row), max(1, (1 << 18) >> g)):
                self._merge_rows(row[cut:cut + max(1, (1 << 18) >> g)], 1 << g, size, data, begin, out)
        return out

    def _merge_rows(self, row, width, size, data, begin, out) -> None:
        column = np.arange(width)
        there = column < size[row][:, None]
        symbol = np.where(there, self.inner[data[np.minimum(begin[row][:, None] + column, len(data) - 1)]], -1)
        last = size[row] - 1
        symbol[np.arange(len(row)), last] = self.closing[data[begin[row] + last]]
        symbol = np.concatenate([symbol, np.full((len(row), 1), -1)], 1)
        rank = self.ranks(symbol[:, :-1], symbol[:, 1:])
        while len(row):
            at = rank.argmin(1)
            low = rank[np.arange(len(row)), at]
            done = low == NEVER
            if done.any():
                for r, s in zip(row[done].tolist(), symbol[done]):
                    out[r] = s[s >= 0]
                row, symbol, rank, at, low = row[~done], symbol[~done], rank[~done], at[~done], low[~done]
                if not len(row):
                    return
                span = int((symbol >= 0).sum(1).max()) + 1
                symbol, rank = symbol[:, :span], rank[:, :span - 1]
            i = np.arange(len(row))
            symbol[i, at] = self.made[low]
            after = np.arange(symbol.shape[1]) + (np.arange(symbol.shape[1]) > at[:, None])
            after[:, -1] = np.minimum(after[:, -1], symbol.shape[1] - 1)
            symbol = np.take_along_axis(symbol, after, 1)
            symbol[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(after[:, :-1], rank.shape[1] - 1), 1)
            rank[:, -1] = NEVER
            rank[i, at] = self.ranks(symbol[i, at], symbol[i, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(symbol[left, at[left] - 1], symbol[left, at[left]])


# --------------------------------------------------------------------------- the transducer
def compile_transducer(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file of a minimal acyclic transducer of distinct words, built from sorted words, state by state."""
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    words_below: list[int] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        at = known.get(key)
        if at is None:
            at = known[key] = len(frozen)
            frozen.append(key)
            words_below.append(final + sum(words_below[target] for _, target in arcs))
        return at

    path: list[list] = [[False, []]]  # the states along the last word that may still grow
    last = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], freeze(final, arcs)))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[depth - 1], freeze(final, arcs)))
    root = freeze(*path[0])

    key, target, output = [], [], []
    for state, (final, arcs) in enumerate(frozen):
        before = int(final)
        for byte, to in arcs:
            key.append(state << 8 | byte)
            target.append(to)
            output.append(before)
            before += words_below[to]
    ends = np.cumsum([0] + [len(ids) for _, ids in entries])
    parts = [np.array(x, np.uint32) for x in (key, target, output, [f for f, _ in frozen], ends, [i for _, ids in entries for i in ids])]
    return struct.pack("<7I", root, *map(len, parts)) + b"".join(p.tobytes() for p in parts)


class Transducer:
    """A memory-mapped transducer file."""

    def __init__(self, path: str) -> None:
        head = struct.unpack("<7I", open(path, "rb").read(28))
        flat = np.memmap(path, np.uint32, "r", 28)
        at = np.cumsum([0, *head[1:]])
        self.root = head[0]
        self.key, self.target, self.output, self.final, self.ends, self.ids = (flat[a:b] for a, b in zip(at, at[1:]))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon has none; all words go one byte a step."""
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.uint32), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.key) else np.zeros(0, np.int64)
        number[len(words) if len(self.key) else 0:] = -1
        depth = 0
        while len(alive):
            done = size[alive] == depth
            over = alive[done]
            number[over[self.final[state[over]] == 0]] = -1
            alive = alive[~done]
            want = state[alive] << np.uint32(8) | data[begin[alive] + depth]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[arc] == want
            number[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            state[alive] = self.target[arc]
            number[alive] += self.output[arc]
            depth += 1
        return number


# --------------------------------------------------------------------------- operators
def compile_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", most: int = LEXICON_WORDS, least_count: int = LEXICON_COUNT) -> str:
    """Compile the most frequent words of all texts and ship the file; returns its name for ``encode``."""
    source = open(tokenizer_path, encoding="utf-8").read()
    shipped = docs.sparkSession.sparkContext.broadcast(source)

    def partial(batches):
        released()
        rules, seen = Rules(shipped.value), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    seen.update(rules.words(value))
                    if len(seen) > PARTIAL:
                        yield rows()
                        seen.clear()
        yield rows()

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Whole classes of like counts, the most frequent first, as far as they fit: the driver gets a short histogram and no
    # more than ``most`` words, whatever the number of tasks.
    frequent = stored(counts.where(F.col("n") >= least_count).withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 16)))
    room, lowest = most, None
    for level, n in sorted(((r.level, r.m) for r in frequent.groupBy("level").agg(F.count("*").alias("m")).collect()), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = level
    words = [] if lowest is None else sorted(r.word.encode() for r in frequent.where(F.col("level") >= lowest).select("word").collect())
    return ship_file(docs.sparkSession, compile_transducer([(w, ids.tolist()) for w, ids in zip(words, Rules(source).merged(words))]), "lexicon")


class Encoder(dict):
    """Words to the bytes of their ids. Unknown words are resolved together, by the transducer first."""

    def __init__(self, rules: Rules, transducer: Transducer) -> None:
        super().__init__()
        self.rules, self.transducer = rules, transducer

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(words)
        if not new:
            return
        spelled = [w.encode() for w in new]
        number = self.transducer.lookup(spelled)
        known = np.flatnonzero(number >= 0)
        ends, ids = self.transducer.ends.astype(np.int64) * 4, self.transducer.ids.tobytes()
        for i, a, b in zip(known.tolist(), ends[number[known]].tolist(), ends[number[known] + 1].tolist()):
            self[new[i]] = ids[a:b]
        unseen = np.flatnonzero(number < 0).tolist()
        for i, merged in zip(unseen, self.rules.merged([spelled[i] for i in unseen])):
            self[new[i]] = merged.astype(np.uint32).tobytes()

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """All ids, one after the other, and the number of each text."""
        split, special = [], self.rules.special
        for text in texts:
            text = text or ""
            if self.rules.cut is not None and "<" in text:
                words = []
                for part in self.rules.cut.split(text):
                    words += [part] if part in special else self.rules.words(part)
            else:
                words = self.rules.words(text)
            split.append(words)
        self.learn(set().union(*split) - special.keys())
        for word, n in special.items():
            self[word] = np.array([n], np.uint32).tobytes()
        joined = [b"".join(map(self.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(joined), np.int32), [len(j) // 4 for j in joined]


def _encoding(docs: DataFrame, lexicon: str, tokenizer_path: str, text: str, ids: str, rows: int):
    """What encodes batches of the returned columns of ``docs``, and the schema it gives."""
    shipped = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    kept = docs.drop(ids)
    names = kept.columns

    def run(batches):
        released()
        encoder = Encoder(Rules(shipped.value), Transducer(SparkFiles.get(lexicon)))
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                flat, counts = encoder.texts(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(flat, np.array(counts), pa.int32())], names=[*names, ids])

    return kept, run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])


def _decoding(spark: SparkSession, schema: T.StructType, tokenizer_path: str, ids: str, out: str, rows: int):
    """What decodes batches of the schema's columns but ``out``, and the schema it gives."""
    spec = json.loads(open(tokenizer_path, encoding="utf-8").read())
    table = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(table.values()) + 1)
    for token, n in table.items():
        tokens[n] = token
    shipped = spark.sparkContext.broadcast(tokens)
    fields = [f for f in schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in fields]

    def run(batches):
        released()
        lookup = pa.array(shipped.value, pa.string())
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                lists = part.column(ids)
                flat, counts = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
                spelled = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]), pa.int32()), lookup.take(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pc.binary_join(spelled, " ")], names=[*names, out])

    return run, T.StructType([*fields, T.StructField(out, T.StringType())])


def encode(docs: DataFrame, lexicon: str, tokenizer_path: str, text: str = "text", ids: str = "ids", rows: int = 512) -> DataFrame:
    """``docs`` with the token ids of every whole text as the array column ``ids``."""
    kept, run, schema = _encoding(docs, lexicon, tokenizer_path, text, ids, rows)
    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded", rows: int = 128) -> DataFrame:
    """``encoded`` with the text that the ids decode to as the string column ``out``: the tokens, joined by spaces."""
    run, schema = _decoding(encoded.sparkSession, encoded.schema, tokenizer_path, ids, out, rows)
    return encoded.drop(out).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, lexicon: str, tokenizer_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``, in one pass of one worker a task instead of two."""
    kept, first, middle = _encoding(docs, lexicon, tokenizer_path, text, ids, 512)
    second, schema = _decoding(docs.sparkSession, middle, tokenizer_path, ids, out, 128)
    return kept.mapInArrow(lambda batches: second(first(batches)), schema)
