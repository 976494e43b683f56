"""Row-wise expressions: ratios, calendars, text normalisation, closed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscope.functions import fixed

# --- arithmetic -------------------------------------------------------------


def ratio(top: Column, bottom: Column) -> Column:
    """NULL when either side is NULL or the denominator is zero."""
    return F.when(bottom != 0, F.try_divide(top, bottom))


def execution_rate(actual: Column, budget: Column) -> Column:
    """Spent share of a budget line; an absent actual counts as nothing spent."""
    return F.when(budget != 0, F.coalesce(actual, F.lit(0.0)) / budget)


def any_sum(*parts: Column) -> Column:
    """Sum of the parts that are present; NULL when all are absent."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def years_between(later: Column, earlier: Column) -> Column:
    return F.round(F.datediff(later, earlier) / F.lit(365.25), 2)


def log_factorial(n: Column) -> Column:
    """ln(n!): from the exact product up to 20, by Stirling's series beyond, whose next term is below 1e-15 there."""
    y = F.greatest(n.cast("double"), F.lit(20.0)) + 1
    y2 = y * y
    series = ((y - 0.5) * F.log(y) - y + 0.5 * F.log(2 * F.pi())
              + (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / y2) / y2) / y2) / y)
    exact = F.log(F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20)).cast("int")))
    return F.when(n <= 20, exact).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (rational approximation, error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / F.sqrt(2 * F.pi()) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def byar_limits(observed: Column, expected: Column) -> tuple[Column, Column]:
    """Byar's approximate 95 % limits of an observed / expected ratio (z taken as 3·⅓)."""
    o = observed.cast("double")
    o1 = o + 1
    low = F.when(o == 0, F.lit(0.0)).otherwise(
        o * F.pow(1 - 1 / (9 * F.greatest(o, F.lit(1.0)))
                  - 1 / (3 * F.sqrt(F.greatest(o, F.lit(1.0)))), 3) / expected)
    high = o1 * F.pow(1 - 1 / (9 * o1) + 1 / (3 * F.sqrt(o1)), 3) / expected
    return F.greatest(F.lit(0.0), low), high


def decile_of_rank(ascending_rank: Column, n: Column) -> Column:
    """Quantile-cut decile of an ascending rank (differs from NTILE at the edges)."""
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil((ascending_rank - 1) * 10 / (n - 1)))).cast("int")


# --- text -------------------------------------------------------------------


def squeeze(text: Column) -> Column:
    """Remove every kind of white space, the full-width one included."""
    return F.regexp_replace(text, fixed.ANY_SPACE, "")


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, f"^{fixed.ANY_SPACE}|{fixed.ANY_SPACE}$", "")


def one_spaced(text: Column) -> Column:
    """Collapse white space runs to single blanks and trim."""
    return F.trim(F.regexp_replace(text, fixed.ANY_SPACE, " "))


def first_number(text: Column) -> Column:
    """First number in the text with thousands separators removed, else NULL."""
    raw = F.regexp_extract(text, fixed.NUMBER, 1)
    return F.when(raw != "", F.replace(raw, F.lit(","), F.lit("")).try_cast("double"))


def fine_amount(text: Column) -> Column:
    raw = F.regexp_extract(text, fixed.MONEY, 1)
    return F.when(raw != "", F.replace(raw, F.lit(","), F.lit("")).try_cast("bigint"))


def sanction_form(text: Column) -> Column:
    """Money pattern first, then the fixed prefixes, else NULL (fails the gate)."""
    value = F.when(fine_amount(text).isNotNull(), F.lit("fine"))
    for prefix, name in fixed.SANCTION_PREFIXES:
        value = value.when(F.trim(text).startswith(prefix), F.lit(name))
    return value


def actor_parts(text: Column) -> tuple[Column, Column]:
    """Split "role：name"; without the separator the role is unknown."""
    role = F.regexp_extract(F.trim(text), fixed.ACTOR, 1)
    name = F.regexp_extract(F.trim(text), fixed.ACTOR, 2)
    hit = role != ""
    return (F.when(hit, F.trim(role)).otherwise(F.lit("unknown")),
            F.when(hit, F.trim(name)).otherwise(F.trim(text)))


def citation(text: Column) -> tuple[Column, Column]:
    """(article, paragraph) of a law citation, empty strings when absent."""
    return (F.regexp_extract(text, fixed.LAW_CITATION, 1),
            F.regexp_extract(text, fixed.LAW_CITATION, 2))


def article_severity(article: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (_, s) in fixed.ARTICLES.items() for x in (k, s)])
    return F.coalesce(F.try_element_at(table, article.cast("int")), F.lit(fixed.DEFAULT_SEVERITY))


def article_category(article: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (c, _) in fixed.ARTICLES.items() for x in (k, c)])
    return F.coalesce(F.try_element_at(table, article.cast("int")), F.lit(fixed.DEFAULT_CATEGORY))


def asset_state(text: Column) -> Column:
    t = F.trim(text)
    return (F.when(t.isin(*fixed.ASSET_ACTIVE), "active")
            .when(t.isin(*fixed.ASSET_INACTIVE), "inactive")
            .when(t.isin(*fixed.ASSET_SUSPENDED), "suspended")
            .otherwise("unknown"))


def operator_in_title(title: Column) -> Column:
    raw = F.regexp_extract(title, fixed.OPERATOR_CLAUSE, 1)
    return F.when(raw != "", raw)


def operator_core(name: Column) -> Column:
    """Operator name without white space and legal-form words."""
    out = squeeze(F.coalesce(name, F.lit("")))
    for word in fixed.LEGAL_FORMS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def same_operator(left: Column, right: Column) -> Column:
    """Containment in either direction of the non-empty cores."""
    a, b = operator_core(left), operator_core(right)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def parent_title(title: Column) -> Column:
    raw = F.regexp_extract(title, fixed.BRANCH, 1)
    return F.when(raw != "", raw).otherwise(title)


def entity_key(title: Column) -> Column:
    return parent_title(F.trim(F.regexp_replace(title, fixed.OPERATOR_CLAUSE, "")))


def document_number(text: Column) -> Column:
    """Only the one verified typing variant is repaired."""
    return F.replace(squeeze(text), F.lit(fixed.DOC_DOUBLED), F.lit(fixed.DOC_SINGLE))


def headline(text: Column) -> Column:
    """First line that is neither blank nor a lone tag / mention."""
    lines = F.transform(F.split(text, "\n"), lambda s: strip(s))
    useful = F.filter(lines, lambda s: (s != "") & ~(
        (s.startswith("#") | s.startswith("@")) & (F.size(F.split(s, r"\s+")) <= 1)))
    return F.coalesce(F.get(useful, F.lit(0)), F.get(F.split(strip(text), "\n"), F.lit(0)))


def hashtags(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(fixed.HASHTAG), F.lit(1)), " ")


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    return F.when(F.length(phrase) > 0,
                  (F.length(text) - F.length(F.replace(text, phrase, F.lit(""))))
                  / F.length(phrase)).cast("long")


def char_windows(text: Column, width: int) -> Column:
    """All character windows of the given width (empty when the text is shorter).

    A zero-width look-ahead walks the text once; cutting with ``substring`` would count
    characters from the start for every window.
    """
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))" % width), F.lit(1))


def term_hint(text: Column, loud: list[str], quiet: list[str],
              names: tuple[str, str] = ("incident", "routine")) -> Column:
    """Queue hint: exactly one of the two vocabularies must speak."""
    a, b = F.lit(False), F.lit(False)
    for word in loud:
        a = a | text.contains(word)
    for word in quiet:
        b = b | text.contains(word)
    return F.when(a & ~b, names[0]).when(b & ~a, names[1]).otherwise("unclear")


def clamp_word(value: Column, allowed: list[str], fallback: str) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.isin(*allowed), v).otherwise(fallback)


def digest20(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the parts as a JSON list of strings."""
    body = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.substring(F.sha2(body, 256), 1, 20)


# --- calendars --------------------------------------------------------------


def minguo_dates(text: Column) -> Column:
    """Array of {y, m, d} for every "110年8月1日"-like date, day optional."""
    found = F.regexp_extract_all(squeeze(text), F.lit(fixed.MINGUO_DATE), F.lit(0))
    part = lambda s, g: F.regexp_extract(s, fixed.MINGUO_DATE, g)
    return F.transform(found, lambda s: F.struct(
        part(s, 1).try_cast("int").alias("y"), part(s, 2).try_cast("int").alias("m"),
        part(s, 3).try_cast("int").alias("d")))


def minguo_period(text: Column) -> tuple[Column, Column]:
    """Start and end as dates; only the first two dates count, later ones are notes."""
    dates = minguo_dates(text)
    def as_date(d: Column) -> Column:
        return F.try_make_timestamp(
            d["y"] + fixed.MINGUO_OFFSET, d["m"], F.coalesce(d["d"], F.lit(1)),
            F.lit(0), F.lit(0), F.lit(0)).cast("date")
    enough = F.size(dates) >= 2
    return (F.when(enough, as_date(F.get(dates, F.lit(0)))),
            F.when(enough, as_date(F.get(dates, F.lit(1)))))


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def covers_school_year(text: Column, school_year: Column) -> Column:
    """Overlap of a contract text with August..July; NULL under two dates."""
    dates = minguo_dates(text)
    first, last = F.get(dates, F.lit(0)), F.get(dates, F.lit(1))
    opens = month_index(school_year, F.lit(8))
    closes = month_index(school_year + 1, F.lit(7))
    return F.when(F.size(dates) >= 2,
                  (month_index(first["y"], first["m"]) <= closes)
                  & (month_index(last["y"], last["m"]) >= opens))


def opens_in_school_year(text: Column, school_year: Column) -> Column:
    first = F.get(minguo_dates(text), F.lit(0))
    at = month_index(first["y"], first["m"])
    return F.coalesce(at.between(month_index(school_year, F.lit(8)),
                                 month_index(school_year + 1, F.lit(7))), F.lit(False))


def months_covered(text: Column) -> Column:
    """Inclusive months of a period text, NULL outside 1..24 or under two dates."""
    dates = minguo_dates(F.regexp_replace(squeeze(text), fixed.DOTTED_DATE, "$1年$2月$3日"))
    a, b = F.get(dates, F.lit(0)), F.get(dates, F.lit(1))
    months = month_index(b["y"], b["m"]) - month_index(a["y"], a["m"]) + 1
    return F.when((F.size(dates) >= 2) & months.between(1, 24), months)


def own_period(label: Column, school_year: Column) -> Column:
    """The period label starts with this school year's August."""
    flat = squeeze(label)
    return flat.rlike(r"^\d+[.年]8[.月]") & (
        F.regexp_extract(flat, r"^(\d+)", 1) == school_year.cast("string"))


def utc_instant(local: Column) -> Column:
    """Zone-free timestamp read as UTC, whatever the session zone is."""
    return F.make_timestamp(F.year(local), F.month(local), F.day(local), F.hour(local), F.minute(local),
                            F.extract(F.lit("SECOND"), local), F.lit("UTC"))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def observable_from(year: Column, kind: Column) -> Column:
    """Date from which a report of the given calendar kind can be known."""
    return F.when(kind == "school", F.make_date(year + fixed.MINGUO_OFFSET + 2, F.lit(1), F.lit(1))) \
        .otherwise(F.make_date(year + fixed.MINGUO_OFFSET + 1, F.lit(7), F.lit(1)))


def latest_observable_year(as_of: Column, kind: Column) -> Column:
    base = F.year(as_of) - fixed.MINGUO_OFFSET
    before_july = F.month(as_of) < 7
    return F.when(kind == "school", base - 2).otherwise(
        F.when(before_july, base - 2).otherwise(base - 1))
