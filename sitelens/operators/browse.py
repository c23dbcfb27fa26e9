"""Results browser operators.

The browser works on a results table with at least ``url``; optional
``title``, ``content``, ``crawler_type``, ``crawl_time``, ``content_type`` and
``seq`` (input order, the tie-break that stands in for a stable sort).
Sorting is a global ``orderBy`` (range-partitioned, no single-task sort);
pages and top-k lists are ``limit``/``offset`` on that order, which Spark
plans as a bounded take-ordered step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import snippet
from sitelens.plans.ids import dense_ids

PAGE_SIZE = 10
FEED_SIZE = 1000
EPOCH_ISO = "1970-01-01T00:00:00"


def _lower_has(col: str, term: str) -> Column:
    return F.coalesce(F.instr(F.lower(F.col(col)), term) > 0, F.lit(False))


def filter_results(df: DataFrame, term: str | None = None, type_: str = "all") -> DataFrame:
    """Crawler-type equality (unless 'all') and a case-insensitive substring
    of title, url or content; null fields never match."""
    out = df
    if type_ and type_ != "all":
        out = out.where(F.col("crawler_type") == type_)
    if term:
        t = term.lower()
        cond = F.lit(False)
        for c in ("title", "url", "content"):
            if c in df.columns:
                cond = cond | _lower_has(c, t)
        out = out.where(cond)
    return out


def _tiebreak(df: DataFrame) -> list[Column]:
    return [F.col("seq").asc()] if "seq" in df.columns else [F.col("url").asc()]


def _ts(col: str = "crawl_time") -> Column:
    # crawl times are zone-less ISO strings: compare them as wall-clock values
    return F.coalesce(F.col(col).try_cast("timestamp_ntz"), F.to_timestamp_ntz(F.lit(EPOCH_ISO)))


def sort_results(df: DataFrame, order: str = "date_desc", term: str | None = None) -> DataFrame:
    """H5 (date_desc/date_asc, missing time = epoch) and H6 (relevance)."""
    if order == "relevance":
        df = relevance(df, term)
    return df.orderBy(*_orders(sort_keys(df, order)))


def relevance(df: DataFrame, term: str | None) -> DataFrame:
    """H6: 10 if the title contains the term, + 5 if the content does."""
    if not term:
        return df.withColumn("relevance", F.lit(0))
    t = term.lower()
    return df.withColumn(
        "relevance",
        F.when(_lower_has("title", t), 10).otherwise(0) + F.when(_lower_has("content", t), 5).otherwise(0),
    )




def paginate(df: DataFrame, order: list[tuple[Column, bool]], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """H7: rows of page ``page`` (1-based, ``size`` rows) in a total order
    given as (expression, ascending) pairs, with their 1-based ``position``.

    The sort keys alone are numbered with distributed dense ids, whatever the
    page; the keys of the page's first row (one driver row) then select the
    wide rows from there on, of which a take-ordered step keeps ``size``.
    Rows with equal keys are interchangeable. Keys must not be null.
    """
    start = (max(page, 1) - 1) * size
    names = [f"_o{i}" for i in range(len(order))]
    keys = df.select(*[e.alias(k) for (e, _), k in zip(order, names)])
    spec = [(F.col(k), asc) for (_, asc), k in zip(order, names)]
    numbered = dense_ids(keys, _orders(spec), "_pos")
    first = numbered.where(F.col("_pos") == start).first()
    w = Window.orderBy(*_orders(order))  # numbers at most `size` rows
    position = (F.row_number().over(w) + start).cast("long")
    if first is None:
        return df.where(F.lit(False)).withColumn("position", F.lit(None).cast("long"))
    # at or after the first row's keys, compared one key after the other
    reached = F.lit(True)
    for (e, asc), k in reversed(list(zip(order, names))):
        bound = F.lit(first[k]).cast(keys.schema[k].dataType)
        reached = ((e > bound) if asc else (e < bound)) | ((e == bound) & reached)
    return df.where(reached).orderBy(*_orders(order)).limit(size).withColumn("position", position)


def _orders(spec: list[tuple[Column, bool]]) -> list[Column]:
    return [e.asc() if asc else e.desc() for e, asc in spec]


def sort_keys(df: DataFrame, order: str = "date_desc") -> list[tuple[Column, bool]]:
    """Total order of H5/H6 as (expression, ascending) pairs (relevance
    expects a ``relevance`` column); ties broken by input order."""
    tie = (F.col("seq"), True) if "seq" in df.columns else (F.col("url"), True)
    if order == "date_desc":
        return [(_ts(), False), tie]
    if order == "date_asc":
        return [(_ts(), True), tie]
    if order == "relevance":
        return [(F.col("relevance"), False), tie]
    raise ValueError(f"unknown order {order!r}")


def total_pages(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_results")).withColumn(
        "total_pages", F.ceil(F.col("total_results") / F.lit(size)).cast("long"))


def most_recent(df: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    """H4: the ``n`` most recent rows by crawl_time string (missing sorts last)."""
    return df.orderBy(F.coalesce(F.col("crawl_time"), F.lit("")).desc(), *_tiebreak(df)).limit(n)


def results_feed(df: DataFrame, n: int = FEED_SIZE, last_updated: str | None = None,
                 cols=("url", "title", "crawler_type", "crawl_time")) -> DataFrame:
    """One row {last_updated, total_results, results}: results is the JSON
    array of the ``n`` most recent rows (bounded by n)."""
    top = most_recent(df, n)
    w = Window.orderBy(F.coalesce(F.col("crawl_time"), F.lit("")).desc(), *_tiebreak(df))
    ranked = top.withColumn("rank", F.row_number().over(w))  # at most n rows
    rec = F.struct(F.col("rank").cast("long").alias("rank"), *[F.col(c) for c in cols])
    ts = F.lit(last_updated) if last_updated else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return ranked.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.to_json(F.sort_array(F.collect_list(rec))).alias("results"),
    ).withColumn("last_updated", ts)


def result_counters(df: DataFrame) -> DataFrame:
    """Distinct URLs, non-image rows, image rows."""
    is_img = F.coalesce(F.col("crawler_type") == "image", F.lit(False))
    return df.agg(
        F.count_distinct("url").alias("total_urls"),
        F.count_if(~is_img).alias("total_pages"),
        F.count_if(is_img).alias("total_images"),
    )


def result_cards(df: DataFrame) -> DataFrame:
    """Display fields of a result card."""
    desc = F.col("metadata")["description"] if "metadata" in df.columns else None
    title = F.col("title") if "title" in df.columns else F.lit(None)
    content = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.select(
        "url",
        F.when(F.length(title) > 0, title).otherwise(F.lit("No Title")).alias("card_title"),
        F.concat(F.lit("Crawler: "), F.coalesce(F.col("crawler_type"), F.lit("unknown"))).alias("card_crawler"),
        F.concat(F.lit("Type: "), F.when(F.length("content_type") > 0, F.split("content_type", ";")[0])
                 .otherwise(F.lit("unknown"))).alias("card_type"),
        snippet(content, desc).alias("card_snippet"),
        F.coalesce(F.col("crawl_time"), F.lit("")).alias("card_time"),
    )
