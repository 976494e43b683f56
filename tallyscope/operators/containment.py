"""Which names occur inside which texts, without a nested loop over all pairs.

Names are represented by character windows that meet windows of the texts in an equality
join; the candidates are then checked on the whole text, so the result is exact.

* A name of at least 2w-1 characters covers one whole w-block of any text it occurs in, so
  such texts are only cut into adjacent blocks. The name gives one window per possible
  offset of that block, the rarest one where there is a choice.
* A shorter name gives its single rarest window, and texts are cut at every position.

Window rows carry the text id only, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.session import counted_side

BLOCKS = (16, 8)
SLIDING = (8, 4, 2, 1)


def _class_of(length: Column) -> Column:
    """Window width, negative for adjacent blocks."""
    out = F.lit(1)
    for w in sorted(SLIDING):
        out = F.when(length >= w, w).otherwise(out)
    for w in sorted(BLOCKS):
        out = F.when(length >= 2 * w - 1, -w).otherwise(out)
    return out


def name_anchors(names: DataFrame, name_id: str, name: str) -> DataFrame:
    """(name id, class, window) rows: every window a text of the name must share one of."""
    d = names.where(F.length(name) > 0).select(name_id, name, _class_of(F.length(name)).alias("_w"))
    grams = F.when(F.lit(False), F.array().cast("array<string>"))
    for w in sorted({*BLOCKS, *SLIDING}):
        grams = grams.when(F.abs("_w") == w, C.char_windows(F.col(name), w))
    cut = d.select(name_id, "_w", F.posexplode(grams).alias("_p", "_g"))
    cut = cut.withColumn("_o", F.when(F.col("_w") < 0, F.pmod(F.col("_p"), -F.col("_w"))).otherwise(0))
    rarity = cut.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    return cut.join(rarity, "_g").groupBy(name_id, "_w", "_o").agg(
        F.min_by("_g", F.struct("_c", "_g")).alias("_g")).drop("_o").distinct()


def text_windows(text: Column, classes: list[int]) -> Column:
    """Windows of a text for the classes in use; tiny windows only once per text."""
    parts = []
    for w in classes:
        if w < 0:
            parts.append(F.regexp_extract_all(text, F.lit(r"(?s)(.{%d})" % -w), F.lit(1)))
        elif w <= 2:
            parts.append(F.array_distinct(C.char_windows(text, w)))
        else:
            parts.append(C.char_windows(text, w))
    return F.concat(*parts)


def contains_pairs(texts: DataFrame, text_id: str, text: str, names: DataFrame, name_id: str,
                   name: str) -> DataFrame:
    """All (text id, name id) pairs where the name is a substring of the text."""
    anchors = name_anchors(names, name_id, name)
    # The classes in use are at most six small numbers.
    used = sorted(r["_w"] for r in names.where(F.length(name) > 0).select(_class_of(F.length(name)).alias("_w")).distinct().collect())
    if not used:
        return texts.where(F.lit(False)).select(text_id, F.lit(None).cast(names.schema[name_id].dataType).alias(name_id))
    cut = texts.select(F.col(text_id), F.explode(text_windows(F.col(text), used)).alias("_g"))
    found = cut.join(counted_side(anchors.select(name_id, "_g")), "_g").select(text_id, name_id).distinct()
    checked = (found.join(texts.select(text_id, F.col(text).alias("_text")), text_id)
               .join(names.select(name_id, F.col(name).alias("_name")), name_id))
    return checked.where(F.col("_text").contains(F.col("_name"))).select(text_id, name_id)
