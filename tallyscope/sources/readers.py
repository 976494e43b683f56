"""Readers with explicit schemas, required columns and consistency gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed

CELL = "struct<`單價`:string,`小計`:string,`收費期間`:string>"
SLIP = (f"struct<slip:map<string,map<string,struct<months:string,class:map<string,map<string,{CELL}>>>>>>")


def require_columns(df: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL mean the same here; keep NULL only."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema
                           if f.dataType.simpleString() in ("double", "float")})


def typed_sanctions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, contradicting rows) of an all-text sanction table.

    Dates that do not parse and amounts that are no number become NULL; a row whose
    monetary flag disagrees with its amount, or whose form is unclassified, contradicts.
    """
    require_columns(raw, ["id", "date", "fine", "is_monetary", "sanction_type", "actor_role"], "sanction table")
    d = raw.withColumns({
        "date": F.to_date(F.try_to_timestamp(F.col("date"), F.lit("yyyy/MM/dd"))),
        "fine": F.col("fine").try_cast("double").cast("bigint"),
        "is_monetary": F.col("is_monetary").cast("int")})
    wrong = (F.col("is_monetary") != F.col("fine").isNotNull().cast("int")) | (F.col("sanction_type") == "other")
    bad = F.coalesce(wrong, F.lit(True))
    return d.where(~bad), d.where(bad)


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """CSV sanctions; fails when any row contradicts itself."""
    good, bad = typed_sanctions(spark.read.option("header", True).csv(path))
    if bad.take(1):
        raise ValueError("sanction table contradicts itself: fine / is_monetary / sanction_type")
    return good


def flatten_assets(raw: DataFrame, text: str = "value") -> DataFrame:
    """Map of owner to asset records, one text per row, to one row per asset."""
    record = "struct<plate_no:string,on_production_date:string,next_exam_dt:string,txn_name:string>"
    m = F.from_json(text, f"map<string,array<{record}>>")
    d = raw.select(F.explode(m).alias("id", "_cars")).select("id", F.explode("_cars").alias("_c")).select("id", "_c.*")
    return d.withColumns({"state": C.asset_state(F.coalesce("txn_name", F.lit(""))),
                          "built": F.to_date(F.try_to_timestamp(F.col("on_production_date"), F.lit("yyyyMM")))})


def invert_actors(raw: DataFrame, text: str = "value") -> DataFrame:
    """Map of actor to sanction records, to rows that carry the entity id and the actor."""
    record = "struct<id:string,date:string,law:string,punishment:string>"
    m = F.from_json(text, f"map<string,array<{record}>>")
    return raw.select(F.explode(m).alias("actor", "_r")).select("actor", F.explode("_r").alias("_e")).select("_e.*", "actor")


def feature_points(raw: DataFrame, properties: str, text: str = "value") -> DataFrame:
    """Features of a FeatureCollection with their properties and lon / lat."""
    schema = f"struct<features:array<struct<properties:struct<{properties}>,geometry:struct<coordinates:array<double>>>>>"
    f = raw.select(F.explode(F.from_json(text, schema)["features"]).alias("_f"))
    xy = F.col("_f.geometry.coordinates")
    return f.select("_f.properties.*", F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"))


def read_reports(spark: SparkSession, folder: str, schema: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(reports, mismatches) of a folder of JSON documents.

    Code, name and year come from the file name and must equal the payload's.
    """
    d = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("_file", F.col("_metadata.file_name"))
    part = lambda i: F.regexp_extract(F.url_decode("_file"), pattern, i)
    d = d.withColumns({"_code": part(1), "_name": part(2), "_year": part(3)})
    same = ((F.col("code") == F.col("_code")) & (F.col("short_name") == F.col("_name"))
            & (F.col("academic_year").cast("string") == F.col("_year")))
    same = F.coalesce(same, F.lit(False))
    return d.where(same).drop("_code", "_name", "_year"), d.where(~same).select("_file", "_code", "_name", "_year")


def fee_lines(slips: DataFrame, keys: Sequence[str], text: str = "payload") -> DataFrame:
    """Age group, semester, class and item levels of a fee slip to lines; uncharged cells leave none."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    d = slips.select(*keys, F.explode(F.from_json(text, SLIP)["slip"]).alias("age_group", "_s"))
    d = d.select(*keys, "age_group", F.explode("_s").alias("semester", "_b"))
    d = d.select(*keys, "age_group", "semester", number(F.col("_b.months")).alias("months"), F.explode("_b.class").alias("class_type", "_i"))
    d = d.select(*keys, "age_group", "semester", "months", "class_type", F.explode("_i").alias("item", "_c"))
    return d.select(*keys, "age_group", "semester", "months", "class_type", "item", F.col("_c.`收費期間`").alias("period"),
                    number(F.col("_c.`單價`")).alias("unit_price"), number(F.col("_c.`小計`")).alias("subtotal")).where(
        F.col("unit_price").isNotNull() | F.col("subtotal").isNotNull())


def feed_rows(raw: DataFrame, text: str = "value") -> DataFrame:
    """Records of a feed whose lines are a record, a list, or a wrapper around a list."""
    as_list = lambda c: F.from_json(c, "array<string>")
    wrapped = F.coalesce(*[as_list(F.get_json_object(text, f"$.{w}")) for w in fixed.FEED_WRAPPERS])
    bare = F.when(F.ltrim(F.col(text)).startswith("["), as_list(F.col(text)))
    records = F.coalesce(bare, wrapped, F.array(F.col(text)))
    d = raw.select(F.explode(records).alias("_r"))
    pick = lambda field: F.coalesce(*[F.when(v != "", v) for v in (
        F.coalesce(F.get_json_object("_r", f"$.{a}.text"), F.get_json_object("_r", f"$.{a}.value"), F.get_json_object("_r", f"$.{a}"))
        for a in fixed.FEED_ALIASES[field])])
    return d.select(*[pick(f).alias(f) for f in fixed.FEED_ALIASES]).where(F.col("text").isNotNull())


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed by its format: CSV by header, JSON whole, JSON lines by line."""
    if path.endswith(".csv"):
        d = spark.read.option("header", True).csv(path)
        have = lambda field: [F.when(F.col(a) != "", F.col(a)) for a in fixed.FEED_ALIASES[field] if a in d.columns]
        return d.select(*[(F.coalesce(*have(f)) if have(f) else F.lit(None).cast("string")).alias(f) for f in fixed.FEED_ALIASES]).where(
            F.col("text").isNotNull())
    return feed_rows(spark.read.text(path, wholetext=not path.endswith(".jsonl")))


def verify_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unlisted, or differ from the manifest in hash or length.

    manifest: name, sha256, byte_length. Hashing runs where the file is read.
    """
    f = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_h"), F.col("length").alias("_l"))
    d = f.join(manifest, "name", "full_outer")
    why = (F.when(F.col("_h").isNull(), "missing_file").when(F.col("sha256").isNull(), "no_hash")
           .when((F.col("_h") != F.col("sha256")) | (F.col("_l") != F.col("byte_length")), "mismatch"))
    return d.select("name", why.alias("problem")).where(F.col("problem").isNotNull())


def fresh_rows(df: DataFrame, key: Column, when: Column, cutoff: Column) -> DataFrame:
    """Rows with a key and a known time not before the cutoff; an unknown age is refused."""
    return df.where(key.isNotNull() & (key.cast("string") != "") & when.isNotNull() & (when >= cutoff))


def page_records(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Links of each page with their order, target and text."""
    tags = F.regexp_extract_all(html, F.lit(r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    d = pages.select(key, F.posexplode(tags).alias("position", "_t"))
    return d.select(key, "position", F.regexp_extract("_t", r'href="([^"]*)"', 1).alias("href"),
                    C.strip(F.regexp_replace(F.regexp_replace("_t", r"(?s)<[^>]*>", ""), "&amp;", "&")).alias("label"))
