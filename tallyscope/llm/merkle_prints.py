"""Document fingerprints: hash trees over leaves, paragraphs and sections, in DataFrame functions only.

A paragraph is what stands between line feeds. Its leaves are pieces of at most ``LEAF`` characters that end behind
``.!?`` where one comes first, so they cover every character. A section is a run of paragraphs that starts at the first
one and at each whose hash ends in 0 or 8, which an edit elsewhere does not move. A node's hash is taken over the hashes
of its children, with a letter for the level; the root is that of the sections. So equal texts have equal fingerprints,
the root tells texts apart, and differing branches say where.

A fingerprint is the root (64 digits), then for each section ``/`` and its hash (16 digits), for each of its paragraphs
``,`` and its hash (16), followed by its leaves (8 each). The likeness of two fingerprints is the Dice coefficient of
their sets of leaves.

``following`` gives every row the text of the next one by id. Ids are cut into ranges at approximate quantiles; a range
is ordered in one task, and its last row gets the first text of the next range. An id that holds several ranges' rows is
dealt over as many. No text is sorted globally, and each is shuffled once.

Cases: a null text is empty, with one empty paragraph and no leaf; two texts without leaves are alike by 1; null ids come
last; rows of one id follow each other by a hash of their texts (an id of several ranges: in some order); the only row
is followed by itself; helper columns take free names; an empty table gives an empty result. A text is handled whole in
one row, so it has to fit into a task's memory.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.llm.words import free_name

#: Characters of a leaf.
LEAF = 32
#: Rows of a range of ids, about.
RANGE_ROWS = 4096


def _hashes(parts: Column, level: str) -> Column:
    return F.transform(parts, lambda x: F.left(F.sha2(F.concat(F.lit(level), x), 256), F.lit(32)))


def _joined(children: Column) -> Column:
    return F.transform(children, lambda c: F.array_join(c, ""))


def with_fingerprints(frame: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``frame`` with a fingerprint for each text column; ``texts``: name of the new column -> text column."""
    names = list(frame.columns)
    step = {out: free_name(frame, f"_{k}") for k, out in enumerate(texts)}

    def staged(source: dict[str, Column], kept: dict[str, list[str]]) -> DataFrame:
        return frame.select("*", *[c.alias(n) for n, c in source.items()]).drop(*sum(kept.values(), []))

    # One level a projection: what the next level uses twice is computed once.
    p, s = {o: f"{n}p" for o, n in step.items()}, {o: f"{n}s" for o, n in step.items()}
    leaf, para, start = ({o: f"{n}{x}" for o, n in step.items()} for x in ("l", "h", "b"))
    pattern = F.lit(f"[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+")
    frame = staged({p[o]: F.split(F.coalesce(F.col(t), F.lit("")), "\n", -1) for o, t in texts.items()}, {})
    frame = staged({leaf[o]: F.transform(p[o], lambda x: _hashes(F.regexp_extract_all(x, pattern, F.lit(0)), "L")) for o in texts}, {o: [p[o]] for o in texts})
    frame = staged({para[o]: _hashes(_joined(F.col(leaf[o])), "P") for o in texts}, {})
    frame = staged({start[o]: F.filter(F.transform(para[o], lambda h, i: F.when((i == 0) | F.right(h, F.lit(1)).isin("0", "8"), i + 1)), lambda i: i.isNotNull()) for o in texts}, {})

    def spans(o: str) -> Column:
        """(first paragraph, one past the last) of every section."""
        ends = F.concat(F.slice(start[o], F.lit(2), F.size(start[o])), F.array(F.size(para[o]) + 1))
        return F.arrays_zip(F.col(start[o]).alias("a"), ends.alias("b"))

    frame = staged({s[o]: F.transform(spans(o), lambda x: F.struct(
        F.left(F.sha2(F.concat(F.lit("S"), F.array_join(F.slice(F.col(para[o]), x["a"], x["b"] - x["a"]), "")), 256), F.lit(32)).alias("h"), x["a"].alias("a"), x["b"].alias("b"))) for o in texts}, {})

    def printed(o: str) -> Column:
        root = F.sha2(F.concat(F.lit("R"), F.array_join(F.transform(s[o], lambda x: x["h"]), "")), 256)
        lines = F.transform(F.arrays_zip(F.col(para[o]).alias("h"), F.col(leaf[o]).alias("l")),
                            lambda x: F.concat(F.lit(","), F.left(x["h"], F.lit(16)), F.array_join(F.transform(x["l"], lambda y: F.left(y, F.lit(8))), "")))
        return F.concat(root, F.array_join(F.transform(s[o], lambda x: F.concat(F.lit("/"), F.left(x["h"], F.lit(16)), F.array_join(F.slice(lines, x["a"], x["b"] - x["a"]), ""))), ""))

    return frame.select(*[c for c in names if c not in texts], *[printed(o).alias(o) for o in texts])


def leaves(fingerprint: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    bare = F.regexp_replace(fingerprint, "^[0-9a-f]{64}|[/,][0-9a-f]{16}", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves, 0 to 1; two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def same(a: Column, b: Column) -> Column:
    """Whether two fingerprints have one root."""
    return F.left(a, F.lit(64)) == F.left(b, F.lit(64))


def changed_paragraphs(old: Column, new: Column) -> Column:
    """Where ``new`` differs from ``old``: (section, paragraph), from 1, of paragraphs that the old one's differing sections lack."""
    def sections(x: Column) -> Column:
        return F.transform(F.slice(F.split(x, "/"), F.lit(2), F.length(x)), lambda t: F.split(t, ","))

    def heads(x: Column) -> Column:
        return F.transform(sections(x), lambda t: t[0])

    def hashes(t: Column) -> Column:
        return F.transform(F.slice(t, F.lit(2), F.size(t)), lambda y: F.left(y, F.lit(16)))

    gone = F.flatten(F.transform(F.filter(sections(old), lambda t: ~F.array_contains(heads(new), t[0])), hashes))
    marked = F.transform(sections(new), lambda t, i: F.when(F.array_contains(heads(old), t[0]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(hashes(t), lambda h, k: F.when(~F.array_contains(gone, h), F.struct((i + 1).cast("int").alias("section"), (k + 1).cast("int").alias("paragraph")))),
                 lambda m: m.isNotNull())))
    return F.when(same(old, new), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(marked))


def following(docs: DataFrame, ids: str = "doc_id", text: str = "text", out: str = "next_text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with the text of the next row by ``ids``, after the last that of the first; null texts are empty."""
    names = [c for c in docs.columns if c != out]
    b, h, z = (free_name(docs, stem) for stem in ("_range", "_hash", "_after"))
    key = F.col(ids).cast("long")
    n = docs.count()
    ranges = max(1, min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows)), n))
    edges = docs.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else []
    edges = edges or []

    # The number of edges up to an id, in two short steps; an id on several edges is dealt over their ranges.
    wide = max(1, int(len(edges) ** 0.5))
    groups = [edges[k:k + wide] for k in range(0, len(edges), wide)]
    at = F.lit(0)
    if edges:
        heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        row = F.size(F.filter(heads, lambda x: x <= key))
        at = F.when(row == 0, F.lit(0)).otherwise((row - 1) * wide + F.size(F.filter(F.get(table, row - 1), lambda x: x <= key)))
        for value, times in Counter(edges).items():
            if times > 1:
                at = F.when(key == value, at - F.pmod(F.monotonically_increasing_id(), F.lit(times)).cast("int")).otherwise(at)
    base = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == text else F.col(c) for c in names],
                       F.when(key.isNull(), len(edges) + 1).otherwise(at).cast("int").alias(b), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(h))
    order = [F.col(ids).cast("long").asc_nulls_last(), F.col(h)]
    led = base.withColumn(out, F.lead(text).over(Window.partitionBy(b).orderBy(*order)))

    # The first text of every range, and the range before it; as many rows as ranges.
    low = F.struct(F.coalesce(key, F.lit((1 << 63) - 1)).alias("id"), F.col(h).alias("h"))
    first = base.select(b, low.alias("low")).groupBy(b).agg(F.min("low").alias("low"))
    turn = Window.orderBy(b)
    before = first.withColumn(z, F.coalesce(F.lag(b).over(turn), F.max(b).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    start = base.select(F.col(b), low.alias("low"), F.col(text).alias(out + "_")).join(F.broadcast(before), [b, "low"]) \
        .groupBy(F.col(z).alias(b)).agg(F.first(out + "_").alias(out + "_"))
    return led.join(start.hint("merge"), b, "left").withColumn(out, F.coalesce(out, out + "_")).select(*names, out)


def edited_fingerprints(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """(ids, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last quarter of the characters replaced by as many of the next row's first ones.
    """
    rows = following(docs.select(F.col(ids).alias("id"), F.col(text).alias("text")), "id").withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substring("next_text", F.lit(1), part)))
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    rows = with_fingerprints(rows, {"fingerprint": "text", "edited_fingerprint": "edited", "next_fingerprint": "next_text"}).drop("text", "edited", "next_text")
    rows = rows.select("*", *[leaves(F.col(c)).alias(n) for n, c in (("own", "fingerprint"), ("changed", "edited_fingerprint"), ("other", "next_fingerprint"))])
    return rows.select(F.col("id").alias(ids), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))


def edited_fingerprints_sql() -> str:
    """The same rows by plain SQL over ``documents``."""
    def printed(name: str) -> str:
        return f"""
     {name}_l AS (SELECT k, [[left(sha256('L' || x), 32) FOR x IN regexp_extract_all(p, '[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+')] FOR p IN string_split({name}, chr(10))] AS l FROM d),
     {name}_h AS (SELECT k, l, [left(sha256('P' || array_to_string(x, '')), 32) FOR x IN l] AS h FROM {name}_l),
     {name}_b AS (SELECT k, l, h, list_concat([i FOR i IN range(1, len(h) + 1) IF i = 1 OR right(h[i], 1) IN ('0', '8')], [len(h) + 1]) AS b FROM {name}_h),
     {name}_s AS (SELECT k, l, h, [{{'h': left(sha256('S' || array_to_string(h[b[i]:b[i + 1] - 1], '')), 32), 'a': b[i], 'b': b[i + 1] - 1}} FOR i IN range(1, len(b))] AS s,
                         [',' || left(h[i], 16) || array_to_string([left(y, 8) FOR y IN l[i]], '') FOR i IN range(1, len(h) + 1)] AS p FROM {name}_b),
     {name}_f AS (SELECT k, sha256('R' || array_to_string([x.h FOR x IN s], '')) || array_to_string(['/' || left(x.h, 16) || array_to_string(p[x.a:x.b], '') FOR x IN s], '') AS f,
                         list_distinct([left(y, 8) FOR y IN flatten(l)]) AS leaves FROM {name}_s)"""

    def near(b: str) -> str:
        return f"CASE WHEN len(o.leaves) + len({b}.leaves) = 0 THEN 1.0 ELSE 2 * len(list_intersect(o.leaves, {b}.leaves)) / (len(o.leaves) + len({b}.leaves)) END"

    return f"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS own, row_number() OVER (ORDER BY doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM documents),
     d AS (SELECT a.k, a.doc_id, a.own, length(a.own) AS n_chars, b.own AS nxt,
                  left(a.own, CAST(length(a.own) - length(a.own) // 4 AS BIGINT)) || left(b.own, CAST(length(a.own) // 4 AS BIGINT)) AS edited
           FROM r AS a JOIN r AS b ON b.k = a.k % a.n + 1),{printed('own')},{printed('edited')},{printed('nxt')}
SELECT d.doc_id, d.n_chars, sha256(d.edited) AS edited_sha256, o.f AS fingerprint, e.f AS edited_fingerprint,
       CAST({near('e')} AS DOUBLE) AS near_edited, CAST({near('x')} AS DOUBLE) AS near_next
FROM d JOIN own_f AS o ON o.k = d.k JOIN edited_f AS e ON e.k = d.k JOIN nxt_f AS x ON x.k = d.k
"""
