"""Conservative identity: crosswalks, ladders, siblings, attribution and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import ordering as O
from tallyscope.operators.containment import contains_pairs
from tallyscope.session import cut_lineage, small_side


def crosswalk(reports: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status per report, candidate rows per short name) of reports against registry titles.

    A candidate is a registry row whose title contains the report's short name. Candidates
    are counted per short name, operators are compared as distinct names, and the nearest
    capacity is read from the distinct capacities, so reports are never multiplied by
    candidates. reports: key, short_name, operator, contract_period, school_year, capacity
    registry: id, title, entity, operator, capacity
    """
    names = reports.select("short_name").distinct().withColumn("_sid", F.xxhash64("short_name"))
    pairs = contains_pairs(registry.select("id", "title"), "id", "title", names, "_sid", "short_name")
    cand = pairs.join(names, "_sid").join(registry.drop("title"), "id").drop("_sid")
    cand = cut_lineage(cand.select("short_name", "id", "entity", F.col("operator").alias("_op"), F.col("capacity").alias("_cap")))
    counts = cand.groupBy("short_name").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_distinct(F.when(F.col("entity") != "", F.col("entity"))).alias("n_entities"), F.min("entity").alias("_entity"))
    offered = cand.groupBy("short_name", "_op").agg(F.count(F.lit(1)).alias("_n"))
    asked = reports.select("short_name", "operator").where(F.col("operator").isNotNull()).distinct()
    operators = (asked.join(offered, "short_name").where(C.same_operator(F.col("operator"), F.col("_op")))
                 .groupBy("short_name", "operator").agg(F.sum("_n").alias("n_operator")))
    gaps = nearest_gap(reports.select("short_name", "capacity"), cand.select("short_name", "_cap"))
    d = (reports.join(counts, "short_name", "left").join(operators, ["short_name", "operator"], "left")
         .join(gaps, ["short_name", "capacity"], "left").na.fill(0, ["n_candidates", "n_entities", "n_operator"]))
    covered = C.covers_school_year(F.col("contract_period"), F.col("school_year"))
    status = (F.when(F.col("n_entities") == 0, "no_entity").when(F.col("n_entities") > 1, "ambiguous_entity")
              .when(F.col("n_operator") == 0, "operator_unmatched")
              .when(~F.coalesce(covered, F.lit(False)), "contract_uncovered").otherwise("matched"))
    out = d.select("key", "short_name", "n_candidates", "n_entities", "n_operator",
                   F.when(F.col("n_entities") == 1, F.col("_entity")).alias("entity"),
                   covered.alias("covered"), "capacity_gap", status.alias("status"))
    return out, cand.select("short_name", "id", "entity")


def nearest_gap(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """Distance of each asked capacity to the nearest offered one of the same short name.

    Both sides are reduced to distinct capacities; the line of a name is as long as the
    number of different capacities, not of rows.
    """
    a = asked.where(F.col("capacity").isNotNull()).distinct().select("short_name", F.col("capacity").alias("_x"), F.lit(None).cast("double").alias("_o"))
    o = offered.where(F.col("_cap").isNotNull()).distinct().select(
        "short_name", F.col("_cap").alias("_x"), F.col("_cap").cast("double").alias("_o"))
    line = Window.partitionBy("short_name").orderBy("_x")
    low = F.max("_o").over(line.rangeBetween(Window.unboundedPreceding, 0))
    high = F.min("_o").over(line.rangeBetween(0, Window.unboundedFollowing))
    d = a.unionByName(o).withColumns({"_low": low, "_high": high}).where(F.col("_o").isNull())
    return d.select("short_name", F.col("_x").alias("capacity"), F.least(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_x")).alias("capacity_gap"))


def crosswalk_problems(status: DataFrame, candidates: DataFrame) -> DataFrame:
    """Violations: repeated report keys, unmatched reports, entities with differing siblings.

    Sibling sets are compared through an order-free fingerprint (count and hash sum).
    """
    twice = status.groupBy("key").count().where("count > 1").select(
        F.lit("duplicate_key").alias("problem"), F.col("key").cast("string").alias("subject"))
    open_ = status.where(F.col("status") != "matched").select(
        F.lit("not_matched").alias("problem"), F.col("key").cast("string").alias("subject"))
    prints = candidates.groupBy("short_name").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("c"),
                                                  F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    mixed = prints.groupBy("entity").agg(F.count_distinct(F.struct("c", "h")).alias("v")).where("v > 1").select(
        F.lit("inconsistent_siblings").alias("problem"), F.col("entity").alias("subject"))
    return twice.unionByName(open_).unionByName(mixed)


def identity_ladder(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Exact title, then entity, then unique name core in the town, else unresolved.

    The registry is counted per rung first, so each join adds one row at most.
    sources: key, title, entity, core, town; registry: id, title, entity, core, town
    """
    by_title = registry.groupBy("title").agg(F.count(F.lit(1)).alias("n_title"), F.min("entity").alias("e1"))
    by_entity = registry.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    core = registry.where(F.col("core") != "")
    stats = [F.count(F.lit(1)).alias("n_core"), F.count_distinct("entity").alias("n_core_entities"), F.min("entity").alias("e3")]
    by_core = core.groupBy("core", "town").agg(*stats)
    by_core_any = core.groupBy("core").agg(*stats).select(
        "core", *[F.col(c).alias("a_" + c) for c in ("n_core", "n_core_entities", "e3")])
    d = (sources.join(by_title, "title", "left").join(by_entity, "entity", "left")
         .join(by_core, ["core", "town"], "left").join(by_core_any, "core", "left"))
    local = F.coalesce("town", F.lit("")) != ""
    for c in ("n_core", "n_core_entities", "e3"):
        d = d.withColumn(c, F.when(local, F.col(c)).otherwise(F.col("a_" + c)))
    d = d.na.fill(0, ["n_title", "n_entity", "n_core", "n_core_entities"])
    status = (F.when(F.col("n_title") == 1, "matched_exact_title").when(F.col("n_entity") > 0, "matched_entity")
              .when(F.col("n_core_entities") == 1, "matched_unique_name_core")
              .when(F.col("n_core") > 0, "unresolved_ambiguous_name_core")
              .otherwise("unresolved_historical_institution"))
    entity = (F.when(status == "matched_exact_title", F.col("e1")).when(status == "matched_entity", F.col("entity"))
              .when(status == "matched_unique_name_core", F.col("e3")))
    return d.select("key", status.alias("status"), entity.alias("matched_entity"), "n_title", "n_entity", "n_core")


def sibling_sets(registry: DataFrame) -> DataFrame:
    """Per entity: number of registry ids, the first and last, and an order-free fingerprint.

    The ids themselves stay in the registry table (entity, id): an event refers to its whole
    sibling set through the entity, and nobody multiplies events by siblings.
    """
    return registry.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_siblings"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def with_siblings(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with their entity's sibling set; an unknown entity is left out (see the violations)."""
    return rows.join(sibling_sets(registry), "entity")


def candidate_links(actions: DataFrame, penalties: DataFrame, registry: DataFrame) -> DataFrame:
    """Per action the sanctions of its sibling set: count, first and last record.

    A candidate only: nothing says it is the same event. The sanctions are counted per
    entity first, so an entity of any size adds one row to the join.
    actions: action, entity; penalties: rec, id
    """
    per = penalties.join(registry.select("id", "entity"), "id").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min("rec").alias("first_penalty"), F.max("rec").alias("last_penalty"))
    return actions.join(per, "entity")


def sibling_members(registry: DataFrame) -> DataFrame:
    """(entity, id, position, n_siblings): every registry id with its place in its entity's set.

    Events carry the entity; this table gives the ids themselves back, without a copy of the set in each event.
    """
    return O.row_number(registry.select("entity", "id"), F.col("id"), F.col("id"), ["entity"], "position", size="n_siblings")


def candidate_sanctions(penalties: DataFrame, registry: DataFrame) -> DataFrame:
    """(entity, rec, id, candidate_index, candidate_count): the sanctions that an action of the entity may refer to.

    With (action, entity) it is the list of candidates of every action, held once per entity. penalties: rec, id
    """
    d = penalties.join(registry.select("id", "entity"), "id").select("entity", "rec", "id")
    return O.row_number(d, F.col("rec"), F.col("rec"), ["entity"], "candidate_index", size="candidate_count")


def sanction_records(rows: DataFrame, key: Sequence[str], law: str) -> DataFrame:
    """Canonical sanction records with their group: one row per key and canonical law text.

    Rows of one key are one penalty; the laws it cites are its records, numbered in order. ``law_variants`` counts the
    texts that became the record, ``law_texts`` names them, ``source_row_count`` counts the rows behind it.
    """
    records = merge_short_laws(rows, key, law).select(*key, F.col("target").alias(law), F.col("variants").alias("law_variants"), F.array_join("texts", "|").alias("law_texts"),
                                                      F.col("source_rows").alias("source_row_count"))
    group = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    # A penalty cites a handful of laws, so its window is short.
    one = Window.partitionBy(*key)
    return records.withColumns({"penalty_group_id": group, "group_record_index": F.row_number().over(one.orderBy(law)).cast("long"),
                                "group_record_count": F.count(F.lit(1)).over(one)})


def sibling_violations(claimed: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims (key, entity, id) that name an unknown entity, add an id or omit one."""
    known = registry.select("entity", "id")
    unknown = claimed.join(known.select("entity").distinct(), "entity", "left_anti").select(
        "key", F.lit("unknown_entity").alias("problem")).distinct()
    added = claimed.join(known, ["entity", "id"], "left_anti").join(
        known.select("entity").distinct(), "entity", "left_semi").select("key", F.lit("added_id").alias("problem")).distinct()
    have = claimed.join(known, ["entity", "id"], "left_semi").groupBy("key", "entity").agg(F.count_distinct("id").alias("c"))
    full = known.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    omitted = have.join(full, "entity").where(F.col("c") < F.col("n")).select("key", F.lit("omitted_id").alias("problem"))
    return unknown.unionByName(added).unionByName(omitted)


def supplier_match(supplier: Column, operator: Column) -> Column:
    a, b = C.squeeze(supplier), C.squeeze(operator)
    na, nb = C.operator_core(supplier), C.operator_core(operator)
    return (F.when(supplier.isNull() | operator.isNull() | (a == "") | (b == ""), "missing_name").when(a == b, "exact_name")
            .when(na == nb, "normalised_legal_name")
            .when((na != "") & (nb != "") & (na.contains(nb) | nb.contains(na)), "weak_contains_unconfirmed")
            .otherwise("no_match"))


def award_year_status(awards: DataFrame, reports: DataFrame) -> DataFrame:
    """Every (award, report year) of one entity with its four-way temporal status.

    awards: award, entity, supplier, start, end; reports: entity, year, operator — one row
    per entity and year. The join key is the entity; adaptive execution splits a hot one.
    """
    d = awards.join(reports, "entity")
    overlap = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(),
                     (F.col("start") < F.make_date(F.col("year") + 1, F.lit(8), F.lit(1)))
                     & (F.col("end") >= F.make_date(F.col("year"), F.lit(8), F.lit(1))))
    method = supplier_match(F.col("supplier"), F.col("operator"))
    matched = method.isin("exact_name", "normalised_legal_name")
    status = (F.when(~matched, "supplier_operator_unconfirmed").when(overlap, "matched_operator_contract_covered")
              .when(~overlap, "matched_operator_contract_uncovered").otherwise("matched_operator_contract_unconfirmed"))
    return d.select("award", "entity", "year", method.alias("method"), status.alias("status"))


# --- attribution of texts ----------------------------------------------------

def distinctive_name(title: Column) -> Column:
    """The identifying core of an official title: without what many titles share."""
    return F.trim(F.regexp_replace(title, fixed.TITLE_NOISE, ""))


def attribute_texts(texts: DataFrame, institutions: DataFrame, other_places: Sequence[str] = fixed.OTHER_CITIES,
                    own_city: str = fixed.OWN_CITY, districts: Sequence[str] = fixed.DISTRICTS) -> DataFrame:
    """Institution named by each text, or the reason why none is given.

    texts: text_id, text, optionally is_anonymised (such a text is never attributed). institutions: id, title, town,
    optionally core, else the title's distinctive name. A full title counts by itself; a core, unless it is a
    district's name, only directly before a facility word or in quotes. More than one id, or another city without the
    institution's town in the text, means no attribution.

    Titles and cores are one table of distinct names, each with a number of its own, so the texts are searched once;
    institutions are counted per name first, so a name that many share costs one row per text.
    """
    silent = F.coalesce(F.col("is_anonymised"), F.lit(False)) if "is_anonymised" in texts.columns else F.lit(False)
    t = texts.select("text_id", F.trim(F.regexp_replace("text", fixed.PUBLISHER_TAIL, "")).alias("text"), silent.alias("_silent"))
    core = F.col("core") if "core" in institutions.columns else distinctive_name(F.col("title"))
    own = institutions.select("id", "town", F.explode(F.array(
        F.struct(F.col("title").alias("name"), F.lit(1).alias("full")), F.struct(core.alias("name"), F.lit(0).alias("full")))).alias("_n")).select("id", "town", "_n.*")
    usable = (F.col("full") == 1) & (F.col("name") != "") | (F.length("name") >= 2) & ~F.col("name").isin(*districts)
    who = own.where(usable).groupBy("name", "full").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("id").alias("last"), F.min("town").alias("town"))
    # Numbers are given once and stored; a name that is a title and a core has one number.
    names = cut_lineage(who.groupBy("name").agg(F.max(F.when(F.col("full") == 1, F.struct("n", "id", "last", "town"))).alias("as_title"),
                                                F.max(F.when(F.col("full") == 0, F.struct("n", "id", "last", "town"))).alias("as_core"))
                        .withColumn("_nid", F.monotonically_increasing_id()))
    found = contains_pairs(t, "text_id", "text", names, "_nid", "name").join(small_side(names), "_nid").join(t.drop("_silent"), "text_id")
    quoted = F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E"))
    named = F.regexp_like(F.col("text"), F.concat(quoted, F.lit(r"\s*(?:" + "|".join(fixed.FACILITY_WORDS) + ")"))) | F.regexp_like(
        F.col("text"), F.concat(F.lit("[「『\"]"), quoted, F.lit("[」』\"]")))
    uses = F.array_compact(F.array(F.when(F.col("as_title").isNotNull(), F.struct(F.lit(1).alias("full"), F.col("as_title").alias("who"))),
                                   F.when(F.col("as_core").isNotNull() & named, F.struct(F.lit(0).alias("full"), F.col("as_core").alias("who")))))
    hits = found.select("text_id", F.explode(uses).alias("_u")).select("text_id", "_u.full", "_u.who.*")
    per = hits.groupBy("text_id").agg(
        ((F.max("n") > 1) | (F.min("id") != F.max("last"))).alias("_many"), F.min("id").alias("_id"),
        F.min("town").alias("_town"), F.max("full").alias("_full"))
    scanned = F.replace(F.col("text"), F.lit(own_city), F.lit(""))
    other = F.coalesce(*[F.when(scanned.contains(p), F.lit(p)) for p in other_places])
    d = t.join(per, "text_id", "left").withColumn("_other", other)
    town = F.replace(F.coalesce("_town", F.lit("")), F.lit("區"), F.lit(""))
    near_town = (town != "") & F.col("text").contains(town)
    ok = ~F.col("_silent") & F.coalesce(~F.col("_many"), F.lit(False)) & (F.col("_other").isNull() | near_town)
    basis = (F.when(F.col("_silent"), "anonymised")
             .when(F.col("_many").isNull(), F.when(F.col("_other").isNotNull(), "other_city").otherwise("no_name"))
             .when(F.col("_many"), "ambiguous").when(~ok, "other_city_uncorroborated")
             .when(F.col("_full") == 1, "full_title").otherwise("distinctive_name"))
    return d.select("text_id", F.when(ok, F.col("_id")).alias("institution_id"), basis.alias("basis"),
                    F.when(ok, near_town).otherwise(F.lit(False)).alias("town_corroborated"))


def cascade_candidates(posts: DataFrame) -> DataFrame:
    """Ordered attribution candidates of a post: hashtags, headline, whole text."""
    tags, head, body = C.hashtags(F.col("text")), C.headline(F.col("text")), C.one_spaced(F.col("text"))
    parts = F.array_distinct(F.filter(F.array(tags, head, body), lambda x: x.isNotNull() & (x != "")))
    d = posts.select("post_id", F.posexplode(parts).alias("pos", "text"))
    # One integer id per (post, candidate) keeps the text join key narrow.
    return d.withColumn("text_id", F.col("post_id") * 4 + F.col("pos"))


def first_attribution(candidates: DataFrame, attributed: DataFrame) -> DataFrame:
    """First attributed candidate per post, else the first refusal."""
    d = candidates.select("post_id", "pos", "text_id").join(attributed, "text_id")
    order = F.struct(F.col("institution_id").isNull(), F.col("pos"))
    return d.groupBy("post_id").agg(
        F.min_by(F.struct("institution_id", "basis", "pos"), order).alias("_a")).select(
        "post_id", "_a.institution_id", "_a.basis", F.col("_a.pos").alias("candidate"))


def inherit_from_root(replies: DataFrame, roots: DataFrame) -> DataFrame:
    """Reply attribution: own name, else the root's, else none; unknown roots are skipped.

    replies: post_id, root_id, own_id; roots: root_id, institution_id
    """
    d = replies.join(roots.select("root_id", F.col("institution_id").alias("_r")), "root_id")
    own = F.col("own_id")
    return d.select(
        "post_id", "root_id", F.coalesce(own, F.col("_r")).alias("institution_id"),
        F.when(own.isNotNull(), "own").when(F.col("_r").isNotNull(), "inherited").otherwise("none").alias("source"),
        (own.isNotNull() & F.col("_r").isNotNull() & (own != F.col("_r"))).alias("named_other"))


# --- sanction rows -----------------------------------------------------------

def merge_short_laws(rows: DataFrame, key: Sequence[str], law: str) -> DataFrame:
    """Canonical sanction records: a shorter law text joins the one longer text it prefixes.

    Works on distinct (key, law) texts. Every text is cut into its prefixes, which meet the
    shorter texts in an equality join; exactly one longer match makes it the target. Rows
    of one identical text stay separate records; rows of several texts become one record.
    """
    texts = rows.groupBy(*key, F.col(law).alias("_law")).agg(F.count(F.lit(1)).alias("_rows"))
    cuts = texts.where(F.length("_law") > 1).select(
        *key, F.col("_law").alias("_long"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("_law") - 1),
                              lambda i: F.left(F.col("_law"), i))).alias("_law"))
    longer = cuts.groupBy(*key, "_law").agg(F.count(F.lit(1)).alias("_c"), F.min("_long").alias("_long"))
    d = texts.join(longer, [*key, "_law"], "left")
    d = d.withColumn("target", F.when(F.col("_c") == 1, F.col("_long")).otherwise(F.col("_law")))
    out = d.groupBy(*key, "target").agg(F.sum("_rows").alias("source_rows"), F.count(F.lit(1)).alias("variants"),
                                        F.max_by("_law", F.struct(F.length("_law"), F.col("_law"))).alias("law"),
                                        F.array_sort(F.collect_set("_law")).alias("texts"))
    return out.withColumn("records", F.when(F.col("variants") == 1, F.col("source_rows")).otherwise(F.lit(1).cast("long")))


def three_of_four_pairs(old: DataFrame, new: DataFrame, scope: str, fields: Sequence[str], key: str) -> DataFrame:
    """Old and new keys that are each other's only partner with at least three of four equal fields.

    Three equal fields of four means agreement on one of the four 3-field subsets, so each
    row gets four equality keys. Per key only the smallest and largest partner are kept;
    smallest = largest over all keys is the proof that there is one partner. No row pairs
    are formed.
    """
    def keyed(d: DataFrame) -> DataFrame:
        packed = [F.to_json(F.struct(F.lit(i).alias("s"), *[F.col(f) for f in fields if f != fields[i]]))
                  for i in range(len(fields))]
        return d.select(F.col(key).alias("_key"), scope, F.explode(F.array(*packed)).alias("_sub"))

    def partner(of: DataFrame, to: DataFrame) -> DataFrame:
        edge = to.groupBy(scope, "_sub").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"))
        return (of.join(edge, [scope, "_sub"]).groupBy("_key")
                .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).where(F.col("_a") == F.col("_b")).select(
                    "_key", F.col("_a").alias("_other")))

    o, n = keyed(old), keyed(new)
    forward = partner(o, n).select(F.col("_key").alias("old_key"), F.col("_other").alias("new_key"))
    back = partner(n, o).select(F.col("_other").alias("old_key"), F.col("_key").alias("new_key"))
    return forward.join(back, ["old_key", "new_key"])


def unique_identity_pairs(old: DataFrame, new: DataFrame, parts: Sequence[str], key: str) -> DataFrame:
    """Old and new keys of one identity (institution and plate, say) that only one row on each side has."""
    def single(d: DataFrame, out: str) -> DataFrame:
        known = d.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in parts], F.lit(False)) == F.lit(False))
        return known.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(out)).where(F.col("_n") == 1).drop("_n")

    return single(old, "old_key").join(single(new, "new_key"), list(parts))


# --- findings and registry ids ------------------------------------------------

def findings_as_of(findings: DataFrame, crosswalk: DataFrame, as_of: str) -> DataFrame:
    """Failed findings observable at a date, spread over the registry ids of their report.

    findings: code, year, kind, rule, passed, severity (years in the report's own calendar)
    crosswalk: code, year, ids_json. Only ``passed = false`` fails; NULL does not.
    """
    day = F.lit(as_of).cast("date")
    seen = findings.where((F.col("passed") == F.lit(False)) & (F.col("year") <= C.latest_observable_year(day, F.col("kind"))))
    # Count per report and rule first, so that only small rows meet the id lists.
    per = seen.groupBy("code", "year", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("h"))
    ids = crosswalk.select("code", "year", F.explode(F.from_json("ids_json", "array<string>")).alias("id"))
    return per.join(ids, ["code", "year"]).groupBy("id").agg(
        F.sum("n").alias("cross_fail"), F.sum("h").alias("cross_fail_high"), F.count_distinct("rule").alias("cross_rules_n"))


def first_listed(lists: DataFrame, key: str, titles: str, lookup: DataFrame, title: str, value: str) -> DataFrame:
    """Value of the first title of an ordered list that the lookup knows."""
    d = lists.select(key, F.posexplode(titles).alias("_pos", title)).join(lookup.where(F.col(value).isNotNull()).select(title, value), title)
    return d.groupBy(key).agg(F.min_by(value, "_pos").alias(value), F.min_by(title, "_pos").alias("used_title"))


def identity_audit(d: DataFrame, low: float, high: float) -> DataFrame:
    """Operator, period and size plausibility of a filed report; NULL when not judgeable.

    An opening year has no size verdict, because its assets are not comparable yet.
    """
    op, reg = C.operator_core(F.col("operator")), C.operator_core(F.col("registry_operator"))
    opening = C.opens_in_school_year(F.col("contract_period"), F.col("school_year"))
    per = C.ratio(F.col("total_assets"), F.col("registry_capacity"))
    return d.select(
        "key", F.when((op != "") & (reg != ""), op.contains(reg) | reg.contains(op)).alias("operator_match"),
        C.covers_school_year(F.col("contract_period"), F.col("school_year")).alias("period_ok"), opening.alias("opening_year"),
        per.alias("assets_per_place"), F.when(~opening, per.between(low, high)).alias("magnitude_ok"))
