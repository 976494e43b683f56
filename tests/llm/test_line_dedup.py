"""Line deduplication against all pairs of lines."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import line_dedup, rarity
from tallyscope.llm.line_dedup import dedup_lines
from tallyscope.llm.queries import LLM_QUERIES
from tallyscope.llm.words import fingerprints, split_words


def tokens(line):
    return frozenset(re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), line.encode())))


def brute(rows, num=4, den=5):
    """rows: (id, print, text); texts without the lines that an earlier line matches."""
    lines = sorted({(i is None, i or 0, h, k, tokens(x)) for i, h, t in rows for k, x in enumerate((t or "").split("\n"))}, key=lambda r: r[:4])
    first = {}
    for at, r in enumerate(lines):
        if r[4]:
            first.setdefault(r[4], at)
    beaten = set()
    sets = list(first)
    for x in sets:
        for y in sets:
            if first[y] < first[x]:
                k = len(x & y)
                if k and den * k >= num * (len(x) + len(y) - k):
                    beaten.add(x)
                    break
    gone = {r[:4] for at, r in enumerate(lines) if r[4] and (at != first[r[4]] or r[4] in beaten)}
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        split = t.split("\n")
        left = [x for k, x in enumerate(split) if (i is None, i or 0, h, k) not in gone]
        out.append((i, "\n".join(left), len(split), len(split) - len(left)))
    return sorted(out, key=repr)


def against(docs, **more):
    rows = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", line_dedup.text_print("text").alias("h"), "text").collect()]
    got = dedup_lines(docs, **more)
    assert got.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("asks", [1, 16])
def test_edited_and_repeated_lines(spark, asks):
    pick = random.Random(11)
    bases = [[f"w{pick.randint(0, 60)}" for _ in range(pick.choice([1, 2, 3, 4, 5, 9, 20, 60]))] for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (None, "One\nONE two\n one"), (2, ""), (4, "The end.\nThe end.\n")]
    for i in range(120):
        lines = []
        for _ in range(pick.randint(1, 8)):
            base = pick.choice(bases)
            lines.append(" ".join(f"v{pick.randint(0, 9)}" if pick.random() < pick.choice([0, 0.05, 0.2]) else w for w in base))
        rows.append((None if i % 40 == 7 else i + 10, "\n".join(lines)))
    rows += rows[20:24] + [(999, " ".join(f"x{k}" for k in range(40000)) + "\n" + "y" * 100000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_lines int").repartition(4)
    against(docs, cells=1 << 12, asks=asks)


def test_one_token_in_every_line_and_clashing_columns(spark, monkeypatch):
    """A frequent and a rare token stand in every line; helper names are on the input."""
    pick = random.Random(4)
    rows = []
    for i in range(160):
        base = ["hot", "rare"] + [f"w{k}" for k in range(pick.choice([2, 6, 12]))]
        rows.append((i, "\n".join(" ".join(w if pick.random() < 0.85 else f"z{pick.randint(0, 30)}" for w in base) for _ in range(3)), 1, "p", 2, 3.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _print string, _gone int, _PRINT_ double").repartition(3)
    against(docs, cells=1 << 12, asks=2)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", line_dedup.text_print("text").alias("h"), "text").collect()]
    got = LLM_QUERIES["op5_line_dedup"](spark, small)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.withColumn("text", F.col("text")).collect()), key=repr) == brute(rows)


def test_rows_are_ordered_and_packed_without_a_step_per_block():
    pick = np.random.default_rng(5)
    main, second, last = pick.integers(-3, 3, 500), pick.integers(-1 << 62, 1 << 62, 20)[pick.integers(0, 20, 500)], pick.permutation(500)
    assert (line_dedup.ordered(main, second, last) == np.lexsort((last, second, main))).all()
    assert not len(line_dedup.ordered(main[:0], second[:0], last[:0]))
    cut = np.array([0, 1, 40, 499])
    for kind, values in ((np.uint16, last), (np.int64, np.stack([main, second], 1))):
        blocks = line_dedup.packed_blocks(values, cut, kind)
        assert blocks.to_pylist() == [v.astype(kind).tobytes() for v in np.split(values, cut[1:])]
        got, n = line_dedup.unpacked(pa.concat_arrays([blocks, blocks]).slice(1), 1, 5, kind)
        assert (got == np.concatenate([values[40:], values[:40]]).astype(kind).ravel()).all()
        assert (n == np.array([459, 1, 1, 39]) * (len(got) // 500)).all()


class Steps:
    """Stands for frame, session and settings; keeps the functions that ``mapInArrow`` is given."""

    def __init__(self):
        self.kept = []

    def mapInArrow(self, step, schema):
        self.kept.append(step)
        return self

    def collect(self):
        return []

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_counters_leave_a_task_in_few_batches():
    """Before, every block of 4096 cells was a batch."""
    texts, steps, cells = [f"w{k} " * 300 for k in range(400)], Steps(), 1 << 20
    rarity.cell_scale(steps, "text", cells, lambda raw: np.repeat(np.arange(len(raw), dtype=np.uint64) * np.uint64(2500), 300))
    batches = list(steps.kept[0](iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert len(batches) <= 4
    total = np.zeros(cells, np.int64)
    for block, n, rest in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
        cell, more = np.frombuffer(rest, np.int64).reshape(2, -1)
        total[block * rarity.BLOCK:(block + 1) * rarity.BLOCK] = np.frombuffer(n, np.uint8)
        total[block * rarity.BLOCK + cell] += more
    assert (total == np.bincount(np.arange(400) * 2500, minlength=cells) * 300).all()


def test_lines_of_a_class_come_in_the_order_of_places(spark):
    """Before, a class's least line was searched among all its lines for every use."""
    rows = [(None, "a b\nx"), (7, "q\nA  b\na b"), (3, "a b"), (3, "z\na b"), (-2, "b a")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    flags = spark.sparkContext.broadcast(np.full(8, 255, np.uint8))
    classes = line_dedup.line_classes(docs, "id", "text", flags).collect()
    assert sorted(len(r["lines"]) for r in classes) == [1, 1, 1, 6]
    for r in classes:
        places = [(x.id is None, x.id or 0, x.print, x.line) for x in r["lines"]]
        assert places == sorted(places)


def test_tokens_of_lines_in_the_global_order():
    pick = np.random.default_rng(3)
    for lines in (40, 70000):
        token = pick.integers(0, 5, 3000).astype(np.uint64) << np.uint64(20)  # differ only below the bits of the short key
        line, scale = np.sort(pick.integers(0, lines, 3000)), (token >> np.uint64(21)).astype(np.uint8)
        line[-1] = lines - 1
        by, same = line_dedup.globally_ordered(line, scale, token)
        rows = list(zip(line[by].tolist(), scale[by].tolist(), token[by].tolist()))
        assert rows == sorted(zip(line.tolist(), scale.tolist(), token.tolist()))
        assert same.tolist() == [False, *(a == b for a, b in zip(rows[1:], rows[:-1]))]
    assert not len(line_dedup.globally_ordered(line[:0], scale[:0], token[:0])[0])


def test_fingerprints_and_words_byte_by_byte():
    top = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
        h = (h ^ h >> 27) * 0x94D049BB133111EB & top
        return h ^ h >> 31

    def plain(word):
        h = mixed(len(word) + 0x9E3779B97F4A7C15 & top)
        for k in range(0, max(len(word), 1), 8):
            h = mixed(h ^ int.from_bytes(word[k:k + 8], "little")) + 0x632BE59BD9B4E019 & top
        return mixed(h)

    pick = random.Random(6)
    raw = [b"x", b"", b" a", b"b ", b"\n\nQ", b"y" * 255 + b" " + b"z" * 256 + b" " + b"u" * 3001]
    raw += [b" ".join(bytes(pick.choice(b"abc\xc3\xbc") for _ in range(pick.randint(1, 20))) for _ in range(9000))]
    words = split_words(raw)
    found = [bytes(words.data[a:b]) for a, b in zip(words.start.tolist(), words.end.tolist())]
    assert found == [w for t in raw for w in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
    assert [int(h) for h in fingerprints(words.data, words.start, words.end)] == [plain(w) for w in found]
    assert not len(split_words([]).start) and not len(fingerprints(words.data, words.start[:0], words.end[:0]))
    assert int(fingerprints(words.data, words.start[:1], words.start[:1])[0]) == plain(b"")
