"""Image rows: filters and de-duplication.

De-duplication uses ``groupBy`` + ``min_by`` (hash aggregate with map-side
partial results) instead of a window, so a URL or content hash shared by a
huge number of rows never has to be sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import G_PATH, url_part

# Image file extensions.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".avif"]


def filter_images(df: DataFrame, exts=None, url_col: str = "url", type_col: str | None = "content_type") -> DataFrame:
    """Keep rows whose lower-cased URL path ends with an image extension,
    or (when a content type is known) whose type starts with image/."""
    exts = IMAGE_EXTENSIONS if exts is None else exts
    alt = "|".join(e.lstrip(".").replace(".", r"\.") for e in exts)
    by_ext = F.lower(url_part(url_col, G_PATH)).rlike(rf"\.({alt})$")
    cond = by_ext
    if type_col and type_col in df.columns:
        cond = cond | F.coalesce(F.lower(F.col(type_col)).startswith("image/"), F.lit(False))
    return df.where(cond)


def min_image_size(df: DataFrame, min_w: int = 100, min_h: int = 100,
                   w_col: str = "px_width", h_col: str = "px_height") -> DataFrame:
    """Drop images with either side below the bound (unknown sizes stay)."""
    small = (F.col(w_col) < min_w) | (F.col(h_col) < min_h)
    return df.where(~F.coalesce(small, F.lit(False)))


def first_seen_images(df: DataFrame, url_col: str = "url", order=("page_seq", "pos")) -> DataFrame:
    """H2: one row per image URL: the first in (page order, position in page)."""
    cols = df.columns
    key = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(url_col).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("_r"))
    return best.select("_r.*")


def dedupe_by_hash(df: DataFrame, content_col: str, order_col: str, hash_col: str = "hash") -> DataFrame:
    """H3: one row per md5 of the content (the first by ``order_col``, nulls last; null content counts as one), with the
    copy count. Hash, order and count alone are aggregated; whole rows meet them on (hash, order), so copies of one content
    spread over tasks. Rows that tie in both are told apart by a hash of all columns."""
    h = df.withColumn(hash_col, F.md5(F.col(content_col)))
    cols = h.columns

    def keyed(rows: DataFrame, order) -> DataFrame:
        return rows.withColumn("__hash", F.coalesce(hash_col, F.lit(""))).withColumn(
            "__order", F.coalesce(order.cast("string"), F.lit(""))).withColumn("__null", order.isNull())

    key = ["__hash", "__order", "__null"]
    least = h.groupBy(hash_col).agg(F.min(order_col).alias("__least"), F.count(F.lit(1)).alias("n_copies"))
    kept = keyed(h, F.col(order_col)).join(keyed(least, F.col("__least")).select(*key, "n_copies"), key)
    row = F.struct(*[F.col(c) for c in cols])
    best = kept.groupBy(*key).agg(F.min_by(row, F.xxhash64(*cols)).alias("_r"), F.first("n_copies").alias("n_copies"))
    return best.select("_r.*", "n_copies")
