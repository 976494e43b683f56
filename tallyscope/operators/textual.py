"""Text checks, labels and phrase search over document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators.postings import ranked_phrases
from tallyscope.session import counted_side, cut_lineage, small_side


# --- outgoing text -----------------------------------------------------------

def unsourced_numbers(texts: DataFrame, allowed: DataFrame, key: str, min_digits: int = 4,
                      exempt: Sequence[int] = range(100, 131)) -> DataFrame:
    """Numbers of at least ``min_digits`` digits that no allowed fact of the same key carries."""
    runs = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(fixed.DIGIT_RUN), F.lit(0))).alias("raw"))
    d = runs.select(key, F.replace("raw", F.lit(","), F.lit("")).alias("digits")).where(F.length("digits") >= min_digits)
    # Leading zeros do not change a number; very long runs stay text.
    d = d.withColumn("digits", F.regexp_replace("digits", "^0+(?=.)", "")).distinct()
    d = d.where(~F.col("digits").isin(*[str(n) for n in exempt]))
    return d.join(allowed.select(key, F.col("value").cast("string").alias("digits")), [key, "digits"], "left_anti")


def verdict_words(text: Column) -> Column:
    """Forbidden words left after the approved negations are taken out."""
    scan = text
    for phrase in fixed.VERDICT_NEGATIONS:
        scan = F.replace(scan, F.lit(phrase), F.lit(""))
    return F.array_compact(F.array(*[F.when(scan.contains(w), F.lit(w)) for w in fixed.VERDICT_WORDS]))


def verbatim_echo(texts: DataFrame, key: str, sources: DataFrame, width: int = fixed.ECHO_WIDTH) -> DataFrame:
    """First ``width``-character window of a text that also stands in a source.

    Any shared run of ``width`` characters covers one whole block of half that width, so a text brings one row per
    block, with what surrounds it; sources bring their windows of half and of full width. Only around blocks that some
    source has are whole windows compared. A text keeps its first hit, so the result is one row per text.
    """
    half = width // 2
    known = sources.select(C.squeeze(F.col("text")).alias("_s"))
    halves = known.select(F.explode(C.char_windows(F.col("_s"), half)).alias("_block")).distinct()
    wholes = known.select(F.explode(C.char_windows(F.col("_s"), width)).alias("chunk")).distinct()
    # A block and up to ``width - half`` characters on either side; the text is padded in front by as many.
    side = width - half
    around = F.regexp_extract_all(F.concat(F.lit(" " * side), C.squeeze(F.col("text"))), F.lit(r"(?s)(?=(.{%d,%d})).{%d}" % (side + half, 2 * side + half, half)), F.lit(1))
    cut = texts.select(key, F.posexplode(around).alias("_n", "_around")).withColumn("_block", F.substring("_around", side + 1, half))
    near = cut.join(counted_side(halves), "_block", "left_semi")
    starts = F.explode(F.sequence(F.lit(0), F.lit(side)))
    tried = near.select(key, "_around", (F.col("_n") * half - side).alias("_at"), starts.alias("_j")) \
        .select(key, (F.col("_at") + F.col("_j")).cast("int").alias("pos"), F.substring("_around", F.col("_j") + 1, F.lit(width)).alias("chunk")) \
        .where((F.col("pos") >= 0) & (F.length("chunk") == width))
    return tried.join(counted_side(wholes), "chunk", "left_semi").groupBy(key).agg(F.min_by("chunk", "pos").alias("chunk"), F.min("pos").alias("pos"))


# --- labels ------------------------------------------------------------------

def label_bucket(classified: Column, value: Column, allowed: Sequence[str], fallback: str = "unclear") -> Column:
    """Unclassified rows stay unclassified whatever their value says."""
    return F.when(~F.coalesce(classified, F.lit(False)), "unclassified").otherwise(C.clamp_word(value, list(allowed), fallback))


def composition(df: DataFrame, group: Sequence[str], bucket: Column, keys: Sequence[str]) -> DataFrame:
    """Counts per fixed key, zero-filled."""
    return df.groupBy(*group).agg(*[F.count_if(bucket == k).alias(f"n_{k}") for k in keys])


def latest_labels(*logs: DataFrame) -> DataFrame:
    """One label per key over several logs; a later log wins, then the later line."""
    tagged = [d.select("key", F.struct(*[c for c in d.columns if c not in ("key", "line")]).alias("_l"),
                       F.struct(F.lit(i).alias("p"), F.col("line").alias("n")).alias("_o")) for i, d in enumerate(logs)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out.groupBy("key").agg(F.max_by("_l", "_o").alias("_l")).select("key", "_l.*")


def pending(work: DataFrame, done: DataFrame, key: str, text: str) -> DataFrame:
    """Non-empty work not done yet, each key once (its smallest text)."""
    fresh = work.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").join(done.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(text).alias(text))


def text_quality(docs: DataFrame, group: str) -> DataFrame:
    """Pages with text, text ratio, need for recognition and private-use share per file."""
    private = F.regexp_count("text", F.lit(r"\p{Co}"))
    page = F.when(F.length("text") > 50, 1).otherwise(0)
    return docs.groupBy(group).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(page).alias("text_pages"), F.round(F.avg(page), 6).alias("text_ratio"),
        (F.avg(page) < 0.5).alias("needs_ocr"), F.sum(F.length("text").cast("long")).alias("chars"),
        F.round(C.ratio(F.sum(private), F.sum(F.length("text").cast("long"))), 8).alias("private_share"))


# --- phrase search -----------------------------------------------------------

def snippet(text: Column, phrase: Column, around: int = 24) -> Column:
    """The first occurrence with its surroundings, marked."""
    start = F.position(F.lower(phrase), F.lower(text))
    left = F.substring(text, F.greatest(start - around, F.lit(1)), F.least(start - 1, F.lit(around)))
    hit = F.substring(text, start, F.length(phrase))
    right = F.substring(text, start + F.length(phrase), F.lit(around))
    return F.when(start > 0, F.concat(left, F.lit("⟦"), hit, F.lit("⟧"), right))


def present_terms(terms: DataFrame, corpus: DataFrame, shortest: int, longest: int) -> DataFrame:
    """The ``term`` rows of ``shortest`` to ``longest`` characters (at most 2 * ``shortest`` + 3) that stand in a corpus text.

    The corpus brings one row per character: a window of ``shortest`` characters with what follows it. Only where that
    window is asked for, longer prefixes of it are compared, and those of twice the length only where the second half is
    asked for, too.
    """
    asked = cut_lineage(terms.select("term").distinct())
    base = counted_side(asked.where(F.length("term") == shortest).withColumnRenamed("term", "_w"))
    ahead = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{%d,%d}))" % (shortest, longest)), F.lit(1))).alias("_a")
    seen = corpus.select(ahead).withColumn("_w", F.substring("_a", 1, shortest)).join(base, "_w", "left_semi").select("_a", "_w").distinct()
    twice = seen.withColumn("_h", F.substring("_a", shortest + 1, shortest)).join(base.select(F.col("_w").alias("_h"), F.lit(True).alias("_both")), "_h", "left")
    most = F.when(F.col("_both"), F.least(F.length("_a"), F.lit(longest))).otherwise(F.least(F.length("_a"), F.lit(2 * shortest - 1)))
    tried = twice.select("_a", F.explode(F.sequence(F.lit(shortest), most)).alias("_n")).select(F.left("_a", F.col("_n")).alias("term")).distinct()
    return tried.join(small_side(asked), "term", "left_semi")


def probe_terms(questions: DataFrame, corpus: DataFrame, sizes: Sequence[int] = range(10, 3, -1), limit: int = 4, budget: int | None = 240) -> DataFrame:
    """Up to ``limit`` longest substrings of each question that occur in the corpus, none nested, of at most ``budget`` probes (None: all of them).

    Substrings are tried from long to short, from left to right; one that nests with a found one is not a probe. All
    substrings of all questions meet the corpus at once; the choice is a fold over a question's own substrings.
    """
    spans = F.concat(*[F.transform(C.char_windows(F.trim(F.col("question")), s),
                                   lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("start"), w.alias("term"))) for s in sizes])
    asked = questions.select("question_id", F.explode(spans).alias("_s")).select("question_id", "_s.*")
    present = present_terms(asked, corpus, min(sizes), max(sizes)).withColumn("known", F.lit(True))
    # Without a budget the unknown windows, which only count as probes, are left out of the fold.
    found = asked.join(small_side(cut_lineage(present)), "term", "inner" if budget is None else "left").groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("size", "start", "term", F.coalesce("known", F.lit(False)).alias("known")))).alias("_c"))
    start = F.struct(F.lit(0).alias("probes"), F.array().cast("array<string>").alias("terms"))

    def step(acc, c):
        spent = F.lit(False) if budget is None else acc["probes"] >= budget
        over = spent | (F.size(acc["terms"]) >= limit) | F.exists(acc["terms"], lambda a: a.contains(c["term"]) | c["term"].contains(a))
        return F.when(over, acc).otherwise(F.struct((acc["probes"] + 1).alias("probes"), F.when(c["known"], F.concat(acc["terms"], F.array(c["term"]))).otherwise(acc["terms"]).alias("terms")))

    picked = found.select("question_id", F.aggregate("_c", start, step)["terms"].alias("terms"))
    return picked.where(F.size("terms") > 0)


def matching_fields(questions: DataFrame, labels: DataFrame, limit: int = 4) -> DataFrame:
    """Field names inside the question, longest first, the first ``limit`` per question."""
    from tallyscope.operators.containment import contains_pairs
    from tallyscope.operators.ordering import row_number
    core = F.trim(F.regexp_replace("label", "[（(].*$", ""))
    names = cut_lineage(labels.select(core.alias("core")).where(F.length("core") >= 2).distinct().withColumn("_cid", F.monotonically_increasing_id()))
    hits = contains_pairs(questions, "question_id", "question", names, "_cid", "core").join(names, "_cid")
    ranked = row_number(hits, F.length("core"), F.col("core"), ["question_id"], "position", descending=True)
    return ranked.where(F.col("position") <= limit).select("question_id", "core")


def clauses(docs: DataFrame, key: str, mark: str = fixed.CLAUSE_MARK) -> DataFrame:
    """Clauses of a text at numbered markers; text before the first is the preamble."""
    parts = F.filter(F.transform(F.split("text", mark), lambda s: C.strip(s)), lambda s: s != "")
    d = docs.select(key, F.posexplode(parts).alias("clause", "body"))
    number = F.regexp_extract("body", r"^[(（]([一二三四五六七八九十]+)[)）]", 1)
    return d.withColumn("marker", F.when(number != "", number).otherwise("preamble"))


def facts_with_citation(facts: DataFrame, docs: DataFrame, institution: str | None = None, year: int | None = None, field: str | None = None) -> DataFrame:
    """Facts with their source file; optional predicates; a NULL value is reported as blank."""
    d = facts
    if institution is not None:
        d = d.where(F.col("institution").contains(institution))
    if year is not None:
        d = d.where(F.col("year") == year)
    if field is not None:
        d = d.where(F.col("field").contains(field))
    d = d.join(docs.select("doc_id", "path"), "doc_id", "left")
    page = F.concat(F.lit("p."), F.col("page").cast("string"))
    return d.withColumn("is_blank", F.col("value").isNull()).withColumn("citation", F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), page))


def retrieve(questions: DataFrame, passages: DataFrame, index: DataFrame, facts: DataFrame, coverage: DataFrame, limit: int = 12,
             institution: str | None = None, year: int | None = None) -> DataFrame:
    """Evidence rows per question: passages by its terms, facts by its field names, both within the filters.

    A question's terms are those of its substrings that the passages have, else the question itself. Passages come in
    the order of their first term, then by score; each of them once, ``limit`` in all, and so facts. A question
    without any hit gets a row that says what was searched, so that an empty answer is not taken for a clean record.
    questions: question_id, question; passages: passage_id, text (institution, year); index: kept postings of
    passages; facts: fact_id, label (institution, year); coverage: scope, covered, total
    """
    def within(d: DataFrame) -> DataFrame:
        d = d if institution is None else d.where(F.col("institution").contains(institution))
        return d if year is None else d.where(F.col("year") == year)

    probed = probe_terms(questions, passages)
    terms = cut_lineage(questions.join(probed, "question_id", "left").select("question_id", F.posexplode(F.coalesce("terms", F.array("question"))).alias("pos", "phrase")))
    hits = ranked_phrases(index, terms.select("phrase").distinct(), fixed.BM25_K1, fixed.BM25_B).withColumnRenamed("key", "passage_id")
    hits = hits.join(within(passages).select("passage_id"), "passage_id", "left_semi")
    best = terms.join(hits, "phrase").groupBy("question_id", "passage_id").agg(F.min(F.struct("pos", (-F.col("score")).alias("less"))).alias("_b"))
    by = Window.partitionBy("question_id").orderBy("_b.pos", F.round("_b.less", 9), "passage_id")
    best = best.withColumn("position", F.row_number().over(by)).where(F.col("position") <= limit)
    found = best.select("question_id", F.lit("passage").alias("kind"), F.col("passage_id").cast("string").alias("subject"), "position")
    core = F.trim(F.regexp_replace("label", "[（(].*$", ""))
    own = within(facts).withColumn("core", core)
    named = matching_fields(questions, own.select("label")).join(own, "core")
    by = Window.partitionBy("question_id").orderBy(F.length("core").desc(), "core", "fact_id")
    named = named.withColumn("position", F.row_number().over(by)).where(F.col("position") <= limit)
    found = found.unionByName(named.select("question_id", F.lit("fact").alias("kind"), F.col("fact_id").cast("string").alias("subject"), "position"))
    found = cut_lineage(found)
    empty = questions.select("question_id").join(found.select("question_id").distinct(), "question_id", "left_anti")
    note = coverage.agg(F.concat_ws(", ", F.lit("searched"), F.sum("covered").cast("string"), F.sum("total").cast("string")).alias("c")).scalar()
    return found.unionByName(empty.select("question_id", F.lit("coverage").alias("kind"), note.alias("subject"), F.lit(1).alias("position")))
