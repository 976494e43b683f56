"""Text, label and search queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import postings as P
from tallyscope.operators import textual as X
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_

LEADS = " || ".join(["c"] + [f"lead(c, {i}) OVER w" for i in range(1, 12)])


def echo_windows(table: str, key: str) -> str:
    """All 12-character windows of a table's squeezed texts, with their positions."""
    return f"""SELECT {key}, pos, chunk FROM (SELECT {key}, pos - 1 AS pos, {LEADS} AS chunk FROM (SELECT {key}, unnest(l) AS c, generate_subscripts(l, 1) AS pos
        FROM (SELECT {key}, string_split(regexp_replace(text, '[\\s　 ]+', '', 'g'), '') AS l FROM {table})) WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE chunk IS NOT NULL"""


@plan("R16", f"""WITH b AS (SELECT DISTINCT chunk FROM ({echo_windows("benchmark", "item_id")})), d AS ({echo_windows("documents", "doc_id")})
    SELECT doc_id, arg_min(chunk, pos) AS chunk, min(pos) AS pos FROM d WHERE chunk IN (SELECT chunk FROM b) GROUP BY 1""", wide="pos")
def verbatim_echo(t: Tables) -> DataFrame:
    return X.verbatim_echo(t.spread("documents", "doc_id"), "doc_id", t.benchmark)


@plan("R15", """WITH n AS (SELECT DISTINCT doc_id, regexp_replace(replace(unnest(regexp_extract_all(text, '\\d[\\d,]*')), ',', ''), '^0+(.)', '\\1') AS digits, 1 AS one FROM documents),
    m AS (SELECT DISTINCT doc_id, replace(unnest(regexp_extract_all(text, '\\d[\\d,]*')), ',', '') AS raw FROM documents),
    x AS (SELECT DISTINCT doc_id, CASE WHEN ltrim(raw, '0') = '' THEN '0' ELSE ltrim(raw, '0') END AS digits FROM m WHERE length(raw) >= 4)
    SELECT doc_id, digits FROM x WHERE digits NOT IN (SELECT CAST(v AS VARCHAR) FROM range(100, 131) r(v)) AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = x.doc_id AND CAST(d.n_chars AS VARCHAR) = x.digits)""")
def number_provenance(t: Tables) -> DataFrame:
    return X.unsourced_numbers(t.spread("documents", "doc_id"), t.spread("documents", "doc_id").select("doc_id", F.col("n_chars").alias("value")), "doc_id")


@plan("R15", """SELECT o_orderkey AS rec, CASE o_orderstatus WHEN 'F' THEN '違規' WHEN 'O' THEN '' ELSE '舞弊,圖利' END AS words, o_orderstatus <> 'P' AS has_disclaimer FROM orders""")
def verdict_word_check(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", "本件非違法認定，惟疑違規").when(F.col("o_orderstatus") == "O", "非違法認定；不構成違法認定").otherwise("圖利與舞弊")
    return t.orders.select(F.col("o_orderkey").alias("rec"), F.array_join(X.verdict_words(text), ",").alias("words"), text.contains("非違法認定").alias("has_disclaimer"))


@plan("P30", """SELECT source, count(*) AS pages, CAST(sum(CASE WHEN length(text) > 50 THEN 1 ELSE 0 END) AS BIGINT) AS text_pages, round(avg(CASE WHEN length(text) > 50 THEN 1 ELSE 0 END), 6) AS text_ratio,
    avg(CASE WHEN length(text) > 50 THEN 1 ELSE 0 END) < 0.5 AS needs_ocr, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(len(regexp_extract_all(text, '\\p{Co}'))) / sum(length(text)), 8) AS private_share FROM documents GROUP BY 1""")
def text_quality_by_source(t: Tables) -> DataFrame:
    return X.text_quality(t.spread("documents", "doc_id"), "source")


KINDS = """lk AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'unclassified' WHEN d.lang IN ('en', 'fr', 'de') THEN d.lang ELSE 'unclear' END AS bucket FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def labelled_docs(t: Tables) -> DataFrame:
    d = t.spread("documents", "doc_id").select("doc_id", "source", "lang", "text").join(t.labels.withColumn("seen", F.lit(True)), "doc_id", "left")
    return d.withColumn("bucket", X.label_bucket(F.col("seen"), F.col("lang"), ["en", "fr", "de"]))


@plan("P23 P24 A19", with_(more=KINDS) + """SELECT source, count(*) FILTER (bucket = 'en') AS n_en, count(*) FILTER (bucket = 'fr') AS n_fr, count(*) FILTER (bucket = 'de') AS n_de, count(*) FILTER (bucket = 'unclear') AS n_unclear,
    count(*) FILTER (bucket = 'unclassified') AS n_unclassified FROM lk GROUP BY source""")
def label_composition(t: Tables) -> DataFrame:
    return X.composition(labelled_docs(t), ["source"], F.col("bucket"), ["en", "fr", "de", "unclear", "unclassified"])


@plan("P25 A33", with_(more=KINDS.replace("l.toxic, CASE", "l.toxic, d.text, CASE")) + """SELECT hint, quality, toxic, count(*) AS n FROM (SELECT *, CASE WHEN (contains(text, 'token') OR contains(text, '@')) AND NOT (contains(text, 'the') OR contains(text, 'der')) THEN 'incident'
    WHEN (contains(text, 'the') OR contains(text, 'der')) AND NOT (contains(text, 'token') OR contains(text, '@')) THEN 'routine' ELSE 'unclear' END AS hint FROM lk WHERE quality IS NOT NULL) GROUP BY ALL""")
def label_crosstab(t: Tables) -> DataFrame:
    d = labelled_docs(t).where(F.col("quality").isNotNull()).withColumn("hint", C.term_hint(F.col("text"), ["token", "@"], ["the", "der"]))
    return d.groupBy("hint", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@plan("A33", with_(more=KINDS.replace("l.toxic, CASE", "l.toxic, d.text, CASE")) + "SELECT doc_id, toxic FROM lk WHERE quality IS NOT NULL AND (contains(text, 'token') OR contains(text, '@')) <> (toxic = 1)")
def label_disagreements(t: Tables) -> DataFrame:
    d = labelled_docs(t).where(F.col("quality").isNotNull())
    return d.where((F.col("text").contains("token") | F.col("text").contains("@")) != (F.col("toxic") == 1)).select("doc_id", "toxic")


@plan("S13", """SELECT doc_id AS key, CASE WHEN d.n_chars > 500 AND b.doc_id IS NOT NULL THEN 1 - a.toxic ELSE a.toxic END AS toxic FROM labels a JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) b USING (doc_id)""")
def label_sidecar(t: Tables) -> DataFrame:
    base = t.labels.select(F.col("doc_id").alias("key"), "toxic", F.col("doc_id").alias("line"))
    fix = t.labels.where(F.col("quality") == 1).join(t.spread("documents", "doc_id").where(F.col("n_chars") > 500).select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("key"), (1 - F.col("toxic")).alias("toxic"), F.col("doc_id").alias("line"))
    return X.latest_labels(base, fix)


@plan("J25", "SELECT sha256(text) AS key, min(text) AS text FROM documents WHERE trim(text) <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def pending_labels(t: Tables) -> DataFrame:
    d = t.spread("documents", "doc_id").withColumn("key", F.sha2("text", 256))
    return X.pending(d, d.join(t.labels, "doc_id", "left_semi"), "key", "text")


@plan("P26", """SELECT doc_id, sha256(text) AS content_hash, substr(sha256('["' || doc_id || '","' || source || '"]'), 1, 20) AS digest FROM documents""")
def content_keys(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", F.sha2("text", 256).alias("content_hash"), C.digest20(F.col("doc_id"), F.col("source")).alias("digest"))


PHRASES = ["token", "tion the", "der die", "que de", "ab"]
SEARCH = """ph AS (SELECT * FROM (VALUES ('token'), ('tion the'), ('der die'), ('que de')) v(phrase)),
    hit AS (SELECT phrase, doc_id, CAST((length(text) - length(replace(lower(text), phrase, ''))) / length(phrase) AS BIGINT) AS tf, text FROM documents, ph WHERE contains(lower(text), phrase))"""


def phrases(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(p,) for p in PHRASES], "phrase string")


def document_index(t: Tables) -> DataFrame:
    """The kept postings of ``documents``: written by the first query that asks, read by all later ones."""
    name = P.content_name(t.spark, os.path.join(t.folder, "documents.parquet"))
    return P.kept_index(t.spread("documents", "doc_id"), "doc_id", "text", f"documents-{name}")


@plan("T3", with_(more=SEARCH) + "SELECT phrase, doc_id, tf FROM hit")
def trigram_search(t: Tables) -> DataFrame:
    return P.find_phrases(document_index(t), phrases(t)).select("phrase", F.col("key").alias("doc_id"), "tf")


@plan("T3", with_(more=SEARCH + """, tot AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS a FROM documents), f AS (SELECT phrase, count(*) AS df FROM hit GROUP BY 1)""") + """SELECT phrase, doc_id,
    round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length(text) - 2, 0) / a)), 6) AS score FROM hit JOIN f USING (phrase), tot""")
def bm25_rank(t: Tables) -> DataFrame:
    hits = P.ranked_phrases(document_index(t), phrases(t), fixed.BM25_K1, fixed.BM25_B)
    return hits.select("phrase", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def probe_step(k: int) -> str:
    """Windows behind the k-th found term that do not nest with it, numbered on as probes; the next found one."""
    held = ", ".join(f"t{i}" for i in range(1, k + 1))
    return f"""b{k + 1} AS (SELECT w.item_id, w.o, w.term, w.have, p{k} + row_number() OVER (PARTITION BY w.item_id ORDER BY w.o) AS p, {held} FROM b{k} w JOIN r{k} r ON r.item_id = w.item_id
        WHERE w.p > p{k} AND NOT contains(t{k}, w.term) AND NOT contains(w.term, t{k})), r{k + 1} AS (SELECT item_id, arg_min(term, p) AS t{k + 1}, min(p) AS p{k + 1} FROM b{k + 1} WHERE have AND p <= 240 GROUP BY 1)"""


def probe_sql(questions: str) -> str:
    """Table expressions from the questions (item_id, question) to r1 .. r4 with up to four terms."""
    return f"""q AS (SELECT item_id, string_split(trim(question), '') AS c FROM {questions}), co AS (SELECT string_split(text, '') AS c FROM conversations), sz AS (SELECT unnest(range(4, 11)) AS s),
    asked AS (SELECT item_id, s, unnest(range(1, len(c) - s + 2)) AS st, c FROM q, sz), a2 AS (SELECT item_id, s, st, array_to_string(c[st:st+s-1], '') AS term FROM asked),
    have AS (SELECT DISTINCT array_to_string(c[st:st+s-1], '') AS term FROM (SELECT s, c, unnest(range(1, len(c) - s + 2)) AS st FROM co, sz)),
    b1 AS (SELECT item_id, term, term IN (SELECT term FROM have) AS have, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, st) AS o, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, st) AS p FROM a2),
    r1 AS (SELECT item_id, arg_min(term, p) AS t1, min(p) AS p1 FROM b1 WHERE have AND p <= 240 GROUP BY 1), {probe_step(1)}, {probe_step(2).replace(", t1, t2", ", w.t1, t2")}, {probe_step(3).replace(", t1, t2, t3", ", w.t1, w.t2, t3")}"""


@plan("T4", f"""WITH q AS (SELECT item_id, string_split(trim(text), '') AS c FROM benchmark), co AS (SELECT string_split(text, '') AS c FROM conversations), sz AS (SELECT unnest(range(4, 11)) AS s),
    asked AS (SELECT item_id, s, unnest(range(1, len(c) - s + 2)) AS st, c FROM q, sz), a2 AS (SELECT item_id, s, st, array_to_string(c[st:st+s-1], '') AS term FROM asked),
    have AS (SELECT DISTINCT array_to_string(c[st:st+s-1], '') AS term FROM (SELECT s, c, unnest(range(1, len(c) - s + 2)) AS st FROM co, sz)),
    k AS (SELECT * FROM a2 WHERE term IN (SELECT term FROM have)), r1 AS (SELECT item_id, arg_min(term, (-s, st)) AS t1 FROM k GROUP BY 1),
    k2 AS (SELECT k.*, t1 FROM k JOIN r1 USING (item_id) WHERE NOT contains(t1, term) AND NOT contains(term, t1)), r2 AS (SELECT item_id, arg_min(term, (-s, st)) AS t2 FROM k2 GROUP BY 1),
    k3 AS (SELECT k2.*, t2 FROM k2 JOIN r2 USING (item_id) WHERE NOT contains(t2, term) AND NOT contains(term, t2)), r3 AS (SELECT item_id, arg_min(term, (-s, st)) AS t3 FROM k3 GROUP BY 1),
    k4 AS (SELECT k3.*, t3 FROM k3 JOIN r3 USING (item_id) WHERE NOT contains(t3, term) AND NOT contains(term, t3)), r4 AS (SELECT item_id, arg_min(term, (-s, st)) AS t4 FROM k4 GROUP BY 1)
    SELECT item_id AS question_id, concat_ws('|', t1, t2, t3, t4) AS terms FROM r1 LEFT JOIN r2 USING (item_id) LEFT JOIN r3 USING (item_id) LEFT JOIN r4 USING (item_id)""")
def term_probe(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return X.probe_terms(q, t.conversations.select("text"), budget=None).select("question_id", F.array_join("terms", "|").alias("terms"))


QUESTIONS = """qs AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN p_name || ' ' || text WHEN item_id % 7 = 3 THEN '〇〇〇〇' ELSE text END AS question FROM benchmark JOIN part ON p_partkey = item_id + 1)"""


@plan("T7 J26 T2", f"""WITH {QUESTIONS}, {probe_sql("qs")},
    tm AS (SELECT item_id, 0 AS pos, t1 AS phrase FROM r1 UNION ALL SELECT item_id, 1, t2 FROM r2 UNION ALL SELECT item_id, 2, t3 FROM r3 UNION ALL SELECT item_id, 3, t4 FROM r4
        UNION ALL SELECT item_id, 0, question FROM qs WHERE item_id NOT IN (SELECT item_id FROM r1)),
    ps AS (SELECT conv_id * 100 + turn AS passage_id, role, text FROM conversations), tot AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS a FROM ps),
    hit AS (SELECT phrase, passage_id, role, (length(lower(text)) - length(replace(lower(text), lower(phrase), ''))) // length(phrase) AS tf, greatest(length(text) - 2, 0) AS dl
        FROM (SELECT DISTINCT phrase FROM tm), ps WHERE contains(lower(text), lower(phrase))),
    f AS (SELECT phrase, count(*) AS df FROM hit GROUP BY 1),
    sc AS (SELECT phrase, passage_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM hit JOIN f USING (phrase), tot WHERE role = 'assistant'),
    bp AS (SELECT item_id, passage_id, pos, round(-score, 9) AS less FROM tm JOIN sc USING (phrase) QUALIFY row_number() OVER (PARTITION BY item_id, passage_id ORDER BY pos, -score) = 1),
    fp AS (SELECT item_id AS question_id, 'passage' AS kind, CAST(passage_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY item_id ORDER BY pos, less, passage_id) AS position FROM bp QUALIFY position <= 12),
    nf AS (SELECT item_id, p_partkey, p_name FROM qs JOIN part ON contains(question, p_name) WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 10) AND p_size > 10),
    ff AS (SELECT item_id AS question_id, 'fact' AS kind, CAST(p_partkey AS VARCHAR) AS subject, row_number() OVER (PARTITION BY item_id ORDER BY length(p_name) DESC, p_name, p_partkey) AS position FROM nf QUALIFY position <= 12),
    al AS (SELECT * FROM fp UNION ALL SELECT * FROM ff)
    SELECT * FROM al UNION ALL SELECT item_id, 'coverage', 'searched, ' || (SELECT count(*) FROM labels) || ', ' || (SELECT count(*) FROM documents), 1 FROM qs WHERE item_id NOT IN (SELECT question_id FROM al)""", wide="position")
def retrieve_evidence(t: Tables) -> DataFrame:
    """Questions answered with passages (the assistant's turns), facts and, where nothing is found, what was searched."""
    text = F.when(F.col("item_id") % 2 == 0, F.concat("p_name", F.lit(" "), "text")).when(F.col("item_id") % 7 == 3, "〇〇〇〇").otherwise(F.col("text"))
    q = t.benchmark.join(t.part, F.col("p_partkey") == F.col("item_id") + 1).select(F.col("item_id").alias("question_id"), text.alias("question"))
    passages = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("passage_id"), "text", F.col("role").alias("institution"))
    name = P.content_name(t.spark, os.path.join(t.folder, "conversations.parquet"))
    index = P.kept_index(passages, "passage_id", "text", f"conversations-{name}")
    facts = t.part.where(F.col("p_size") > 10).select(F.col("p_partkey").alias("fact_id"), F.concat("p_name", F.lit(" （unit）")).alias("label"), F.lit("assistant").alias("institution"))
    cover = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("c")), "doc_id", "left").agg(F.count("c").alias("covered"), F.count(F.lit(1)).alias("total"))
    return X.retrieve(q, passages, index, facts, cover, institution="assistant")


@plan("T5", """WITH n AS (SELECT DISTINCT p_name AS core FROM part), q AS (SELECT o_orderkey AS question_id, 'what about ' || a.p_name || ' and ' || b.p_name || '?' AS question FROM orders JOIN part a ON a.p_partkey = o_custkey JOIN part b ON b.p_partkey = o_custkey + 1)
    SELECT question_id, core FROM q JOIN n ON contains(question, core)""")
def field_matches(t: Tables) -> DataFrame:
    a, b = (t.part.select((F.col("p_partkey") - i).alias("o_custkey"), F.col("p_name").alias(f"n{i}")) for i in (0, 1))
    q = t.orders.join(a, "o_custkey").join(b, "o_custkey").select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("what about "), "n0", F.lit(" and "), "n1", F.lit("?")).alias("question"))
    return X.matching_fields(q, t.part.select(F.concat("p_name", F.lit(" （unit）")).alias("label")), limit=64)


@plan("T1", """SELECT l_orderkey, l_linenumber, l_partkey, u.* FROM lineitem, LATERAL (SELECT 0 AS clause, 'preamble' AS marker, l_returnflag AS body UNION ALL SELECT 1, '一', '(一)' || l_linestatus UNION ALL SELECT 2, '二', '（二）' || l_quantity) u""")
def clause_split(t: Tables) -> DataFrame:
    text = F.concat(F.col("l_returnflag"), F.lit(" (一)"), F.col("l_linestatus"), F.lit("\n（二）"), F.col("l_quantity").cast("string"))
    d = t.lineitem.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"), text.alias("text"))
    return X.clauses(d, "k").select("k.*", "clause", "marker", "body")


# --- document index ----------------------------------------------------------

INDEX = """dc AS (SELECT doc_id, source AS institution, lang AS kind, 1900 + CAST(substr(source, 4) AS INTEGER) AS year, 'files/' || source || '/' || doc_id || '.txt' AS path FROM documents),
    fa AS (SELECT l_orderkey AS doc_id, 'src' || (l_suppkey % 20) AS institution, year(l_shipdate) AS year, l_returnflag AS field, CASE WHEN l_discount <> 0 THEN l_discount END AS value, l_linenumber AS page FROM lineitem)"""


def index_documents(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", F.col("source").alias("institution"), F.col("lang").alias("kind"), (F.substring("source", 4, 9).cast("int") + 1900).alias("year"),
                              F.concat(F.lit("files/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))


def index_facts(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("institution"), F.year("l_shipdate").alias("year"),
                             F.col("l_returnflag").alias("field"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("value"), F.col("l_linenumber").alias("page"))


@plan("T6 J26", with_(more=INDEX) + """SELECT fa.doc_id, fa.year, field, value, value IS NULL AS is_blank, coalesce(regexp_extract(path, '[^/]+$') || ' p.' || page, 'p.' || page) AS citation FROM fa LEFT JOIN dc ON dc.doc_id = fa.doc_id
    WHERE contains(fa.institution, 'src1') AND fa.year = 1999 AND field = 'A'""", wide="year")
def find_facts(t: Tables) -> DataFrame:
    return X.facts_with_citation(index_facts(t), index_documents(t), institution="src1", year=1999, field="A").select("doc_id", "year", "field", "value", "is_blank", "citation")


@plan("T6", with_(more=INDEX) + "SELECT doc_id, institution, year, kind FROM dc WHERE contains(institution, 'src1') AND kind = 'en' ORDER BY year DESC, doc_id LIMIT 50")
def locate_documents(t: Tables) -> DataFrame:
    d = index_documents(t).where(F.col("institution").contains("src1") & (F.col("kind") == "en"))
    return d.orderBy(F.desc("year"), "doc_id").limit(50).select("doc_id", "institution", "year", "kind")


@plan("T2 T6", with_(more=INDEX) + """SELECT kind AS scope, count(*) FILTER (l.doc_id IS NOT NULL) AS covered, count(*) AS total, CASE WHEN count(*) FILTER (l.doc_id IS NOT NULL) = 0 THEN 'none' WHEN count(*) FILTER (l.doc_id IS NULL) = 0 THEN 'all' ELSE 'partial' END AS state
    FROM dc LEFT JOIN labels l ON l.doc_id = dc.doc_id GROUP BY kind""")
def coverage_summary(t: Tables) -> DataFrame:
    d = index_documents(t).join(t.labels.select("doc_id", F.lit(1).alias("c")), "doc_id", "left")
    covered, total = F.count("c"), F.count(F.lit(1))
    return d.groupBy(F.col("kind").alias("scope")).agg(covered.alias("covered"), total.alias("total"), F.when(covered == 0, "none").when(covered == total, "all").otherwise("partial").alias("state"))


@plan("T2 S15 R17", with_(more=INDEX) + """SELECT 'documents' AS tab, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents UNION ALL SELECT 'facts', count(*), count(value) FROM fa UNION ALL SELECT 'sections', count(*), count(DISTINCT institution) FROM dc
    UNION ALL SELECT 'passages', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT), CAST(sum(length(text)) AS BIGINT) FROM documents""")
def index_statistics(t: Tables) -> DataFrame:
    one = lambda d, name, n, size: d.agg(n.cast("long").alias("n"), size.cast("long").alias("size")).select(F.lit(name).alias("tab"), "n", "size")
    rows = F.count(F.lit(1))
    return (one(t.spread("documents", "doc_id"), "documents", rows, F.sum("n_chars")).unionByName(one(index_facts(t), "facts", rows, F.count("value")))
            .unionByName(one(index_documents(t), "sections", rows, F.count_distinct("institution")))
            .unionByName(one(t.spread("documents", "doc_id"), "passages", F.sum(F.size(F.split("text", "\n"))), F.sum(F.length("text").cast("long")))))


@plan("T7", with_(more=SEARCH + ",\n" + INDEX) + """SELECT 'passage' AS kind, phrase AS subject, count(*) AS found FROM hit GROUP BY 2 UNION ALL SELECT 'fact', field, count(*) FROM fa WHERE institution = 'src3' AND year = 2000 GROUP BY 2
    UNION ALL SELECT 'section', kind, count(*) FROM dc WHERE institution = 'src3' GROUP BY 2""")
def retrieve_summary(t: Tables) -> DataFrame:
    p = P.find_phrases(document_index(t), phrases(t)).select(F.lit("passage").alias("kind"), F.col("phrase").alias("subject"))
    f = index_facts(t).where((F.col("institution") == "src3") & (F.col("year") == 2000)).select(F.lit("fact").alias("kind"), F.col("field").alias("subject"))
    s = index_documents(t).where(F.col("institution") == "src3").select(F.lit("section").alias("kind"), F.col("kind").alias("subject"))
    return p.unionByName(f).unionByName(s).groupBy("kind", "subject").agg(F.count(F.lit(1)).alias("found"))


@plan("T8", """SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey) AS uid, l_returnflag AS section, l_quantity AS qty, CASE WHEN l_discount <> 0 THEN l_discount END AS discount FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 7 AND year(l_shipdate) = 1998""")
def table_catalogue(t: Tables) -> DataFrame:
    d = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_suppkey") == 7) & (F.year("l_shipdate") == 1998))
    return d.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("uid"), F.col("l_returnflag").alias("section"), F.col("l_quantity").alias("qty"),
                    F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"))


@plan("R17", with_("inst", "pen") + """SELECT i.id, count(p.rec) AS n_sanctions, CAST(coalesce(sum(p.severity), 0) AS BIGINT) AS severity, round(max(p.fine), 2) AS largest_fine, count(p.rec) FILTER (p.fine IS NULL) AS unknown_fines,
    CASE WHEN count(p.rec) = 0 THEN 'no sanction on file; not evidence of compliance' WHEN count(p.fine) < count(p.rec) THEN 'some amounts not published' ELSE 'complete' END AS coverage FROM inst i LEFT JOIN pen p ON p.id = i.id GROUP BY i.id""")
def letter_facts(t: Tables) -> DataFrame:
    p = R.sanctions(t).groupBy("id").agg(F.count(F.lit(1)).alias("n_sanctions"), F.sum("severity").alias("severity"), F.round(F.max("fine"), 2).alias("largest_fine"), F.count("fine").alias("_f"))
    d = R.institutions(t).select("id").join(p, "id", "left").na.fill(0, ["n_sanctions", "severity", "_f"])
    note = F.when(F.col("n_sanctions") == 0, "no sanction on file; not evidence of compliance").when(F.col("_f") < F.col("n_sanctions"), "some amounts not published").otherwise("complete")
    return d.select("id", "n_sanctions", "severity", "largest_fine", (F.col("n_sanctions") - F.col("_f")).alias("unknown_fines"), note.alias("coverage"))
