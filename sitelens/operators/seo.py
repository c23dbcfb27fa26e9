"""SEO factors, metrics, score, issues and sitemap rows.

Per-page factors are column expressions over the stored HTML plus one small
per-URL aggregate (internal/external link counts) joined on the page URL
after the html column is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions.text import detect_language, tokenize, words
from sitelens.functions.urls import scheme, url_domain
from sitelens.operators.links import distinct_links
from sitelens.plans.ids import dense_ids

# Scoring factors (bounds and weights). page_load_speed is
# declared too but cannot be computed from stored pages, so it is left out of
# both the numerator and the denominator.
FACTORS = {
    "title_length": {"min": 30, "max": 60, "weight": 5},
    "meta_description_length": {"min": 120, "max": 160, "weight": 4},
    "headings_structure": {"weight": 3},
    "content_word_count": {"min": 300, "weight": 3},
    "keyword_density": {"min": 0.5, "max": 2.5, "weight": 4},
    "image_alt_text": {"weight": 2},
    "internal_links": {"min": 2, "weight": 3},
    "external_links": {"weight": 2},
    "mobile_friendly": {"weight": 5},
    "https": {"weight": 5},
    "structured_data": {"weight": 3},
}

# Issue messages per factor (shown when the factor fails).
MESSAGES = {
    "title_length": "Title length outside the recommended range",
    "meta_description_length": "Meta description length outside the recommended range",
    "headings_structure": "Page should have exactly one h1 heading",
    "content_word_count": "Content is too short",
    "keyword_density": "Keyword density outside the recommended range",
    "image_alt_text": "Some images lack alt text",
    "internal_links": "Too few internal links",
    "external_links": "No external links",
    "mobile_friendly": "No viewport meta tag",
    "https": "Page is not served over https",
    "structured_data": "No structured data",
}

# Score bands and sitemap priority steps.
BAND_GOOD, BAND_AVERAGE = 80, 60
PRIORITY_STEPS = [(90, 1.0), (80, 0.8), (70, 0.6)]
PRIORITY_DEFAULT, PRIORITY_FLOOR, PRIORITY_DEPTH_STEP = 0.5, 0.1, 0.1
SITEMAP_SHARD_SIZE = 50000


def keyword_density(df: DataFrame, key_col: str, tokens_col: str = "tokens", out: str = "keyword_density",
                    carry: list[str] | None = None) -> DataFrame:
    """(key, density) with density = 100 x (count of the most frequent
    token) / (number of tokens), half-up to 2 decimals; 0 without tokens.
    ``carry`` names per-key columns passed through (they must be constant per key).

    Counted as a distributed aggregation: explode, count per (key, term) with
    map-side partial counts, max per key. A single huge document spreads over
    many tasks instead of being folded inside one row (measured faster here
    than both an in-row lambda fold and an Arrow UDF with a Counter).
    """
    keys = [key_col] + list(carry or [])
    ex = df.select(*keys, F.explode_outer(tokens_col).alias("_t"))
    per_term = ex.groupBy(*keys, "_t").agg(F.count("_t").alias("_c"))
    per_key = per_term.groupBy(*keys).agg(F.max("_c").alias("_b"), F.sum("_c").alias("_n"))
    # half-up rounding in exact integer arithmetic: floor((20000 b + n) / 2n) / 100
    x100 = F.floor((F.lit(20000) * F.col("_b") + F.col("_n")) / (F.lit(2) * F.col("_n")))
    return per_key.select(*keys, F.when(F.col("_n") > 0, x100 / F.lit(100.0)).otherwise(F.lit(0.0)).alias(out))


def top_share(tokens: Column) -> Column:
    """J2 inside one row, no shuffle; the same rounding as :func:`keyword_density`. The sorted tokens are joined and one
    backreference finds the runs of equal ones, so only repeated tokens are looked at one by one."""
    # tokens are word characters alone, so a space stands between them only
    runs = F.regexp_extract_all(F.array_join(F.array_sort(tokens), " "), F.lit(r"(?<![^ ])([^ ]++)(?: \1(?![^ ]))+"), 0)
    most = F.array_max(F.transform(runs, lambda r: F.size(F.split(r, " "))))
    n = F.size(tokens).cast("long")
    best = F.coalesce(most, F.lit(1)).cast("long")
    return F.when(n > 0, F.floor((F.lit(20000) * best + n) / (F.lit(2) * n)) / F.lit(100.0)).otherwise(F.lit(0.0))


def link_counts(edges: DataFrame) -> DataFrame:
    """(src_url, internal_links, external_links) from D4 edges (same domain = internal); the links of a URL that stands
    in several rows count once."""
    internal = url_domain("src_url") == url_domain("dst_url")
    return distinct_links(edges).groupBy("src_url").agg(
        F.count_if(internal).alias("internal_links"),
        F.count_if(~internal).alias("external_links"),
    )


def seo_factors(pages: DataFrame, edges: DataFrame | None = None, url_col: str = "url",
                html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """Factor inputs, one output row for each input row.

    Everything read from the HTML is a narrow projection of the row itself;
    the html column is then dropped before the per-URL link counts (one row
    each) are joined.
    """
    h = F.col(html_col)
    carried = [c for c in pages.columns if keep_html or c != html_col]
    # markup without hidden parts, its meta tags and its text are each read once (Catalyst keeps what is used several times)
    read = pages.select(*carried, h.alias("_html"), H.shown(h).alias("_shown"))
    read = read.withColumns({"_meta": H.tags(F.col("_shown"), "meta"), "_words": H.text_of(F.col("_shown"))})
    read = read.select(
        *carried,
        H.page_title("_html").alias("title"),
        F.coalesce(H.meta_value(F.col("_meta"), "description"), F.lit("")).alias("description"),
        H.count_matches("_html", H.H1_RE).cast("long").alias("h1_count"),
        H.counts_of(H.tags(F.col("_shown"), "img")).alias("_img"),
        (F.length(H.meta_value(F.col("_meta"), "viewport")) > 0).eqNullSafe(F.lit(True)).alias("mobile_friendly"),
        (scheme(url_col) == "https").alias("is_https"),
        (F.size(H.structured_data("_html")) > 0).alias("has_structured_data"),
        H.any_og(F.col("_meta")).alias("has_og_tags"),
        F.size(words("_words")).cast("long").alias("word_count"),
        tokenize("_words").alias("_tokens"),
    ).withColumn("keyword_density", top_share(F.col("_tokens")))
    out = read.select(
        *carried, "title", "description", "h1_count", F.col("_img.images").alias("image_count"),
        F.col("_img.with_alt").alias("image_alt_count"), "mobile_friendly", "is_https", "has_structured_data", "has_og_tags",
        "word_count", "keyword_density")
    if edges is not None:
        lc = link_counts(edges)
        out = out.join(lc, out[url_col] == lc["src_url"], "left").drop("src_url")
        out = out.fillna(0, ["internal_links", "external_links"])
    else:
        out = out.withColumn("internal_links", F.lit(0).cast("long")).withColumn("external_links", F.lit(0).cast("long"))
    return out


def factor_passes(df: DataFrame) -> dict[str, Column]:
    f = FACTORS
    tl, dl = F.length("title"), F.length("description")
    return {
        "title_length": tl.between(f["title_length"]["min"], f["title_length"]["max"]),
        "meta_description_length": dl.between(f["meta_description_length"]["min"], f["meta_description_length"]["max"]),
        "headings_structure": F.col("h1_count") == 1,
        "content_word_count": F.col("word_count") >= f["content_word_count"]["min"],
        "keyword_density": F.col("keyword_density").between(f["keyword_density"]["min"], f["keyword_density"]["max"]),
        "image_alt_text": F.col("image_alt_count") >= F.col("image_count"),
        "internal_links": F.col("internal_links") >= f["internal_links"]["min"],
        "external_links": F.col("external_links") >= 1,
        "mobile_friendly": F.col("mobile_friendly"),
        "https": F.col("is_https"),
        "structured_data": F.col("has_structured_data"),
    }


def seo_score(df: DataFrame) -> DataFrame:
    """100 x sum(weight x pass) / sum(weight), one decimal."""
    passes = factor_passes(df)
    total = sum(v["weight"] for v in FACTORS.values())
    num = sum((F.when(passes[k], F.lit(v["weight"])).otherwise(0) for k, v in FACTORS.items()), F.lit(0))
    # half-up to one decimal in integer arithmetic: floor((2000 num + total) / 2 total) / 10
    x10 = F.floor((F.lit(2000) * num + F.lit(total)) / F.lit(2 * total))
    return df.withColumn("seo_score", x10 / F.lit(10.0))


def seo_issues(df: DataFrame) -> DataFrame:
    """array<struct<type, factor, message>>: 'good' for passing factors,
    'issue' for failing factors of weight >= 4, else 'improvement'."""
    passes = factor_passes(df)
    items = [
        F.struct(
            F.when(passes[k], F.lit("good")).otherwise(F.lit("issue" if v["weight"] >= 4 else "improvement")).alias("type"),
            F.lit(k).alias("factor"),
            F.when(passes[k], F.lit("ok")).otherwise(F.lit(MESSAGES[k])).alias("message"),
        )
        for k, v in FACTORS.items()
    ]
    return df.withColumn("seo_issues", F.array(*items))


def seo_metrics(df: DataFrame) -> DataFrame:
    """Metrics struct."""
    return df.withColumn("seo_metrics", F.struct(
        F.length("title").alias("title_length"),
        F.length("description").alias("meta_desc_length"),
        F.col("keyword_density"),
        F.col("has_structured_data"),
        F.col("has_og_tags"),
        F.col("mobile_friendly"),
    ))


def score_band(col) -> Column:
    """Good >= 80, average >= 60, else poor; null score -> null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c >= BAND_GOOD, "good").when(c >= BAND_AVERAGE, "average").when(c.isNotNull(), "poor")


def language_checks(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Declared html lang, hreflang presence, detected language, agreement."""
    h = F.col(html_col)
    return df.select(
        "*",
        H.html_lang(h).alias("declared_lang"),
        (F.size(H.hreflangs(h)) > 0).alias("has_hreflang"),
        detect_language(H.visible_text(h)).alias("detected_lang"),
    ).withColumn("lang_declared", F.length("declared_lang") > 0).withColumn(
        "lang_matches", F.col("declared_lang") == F.col("detected_lang"))


def sitemap_priority(score, depth) -> Column:
    """0.5 by default; 1.0/0.8/0.6 for score >= 90/80/70; minus 0.1 per
    depth level (when depth is known), floor 0.1; one decimal."""
    s = F.col(score) if isinstance(score, str) else score
    d = F.col(depth) if isinstance(depth, str) else depth
    p = F.lit(PRIORITY_DEFAULT)
    for bound, value in reversed(PRIORITY_STEPS):
        p = F.when(s >= bound, F.lit(value)).otherwise(p)
    p = F.when(d.isNotNull(), F.greatest(F.lit(PRIORITY_FLOOR), p - d.cast("double") * PRIORITY_DEPTH_STEP)).otherwise(p)
    return F.round(p, 1)


def change_freq(col) -> Column:
    """Daily for news/blog content types, weekly for product, else monthly."""
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    return (F.when(c.contains("news") | c.contains("blog"), "daily")
            .when(c.contains("product"), "weekly").otherwise("monthly"))


def latest_by_url(df: DataFrame, time_col: str = "crawl_time", seq_col: str = "seq") -> DataFrame:
    """H1: newest row per URL by the time string; on equal times the first in
    input order wins. Only (url, time, seq) go through the aggregate; the wide
    rows meet its result in one join on all three. ``seq_col`` is unique."""
    latest = df.groupBy("url").agg(F.max(F.struct(F.col(time_col).alias("t"), (-F.col(seq_col)).alias("s"))).alias("_k"))
    latest = latest.select(F.col("url").alias("_u"), F.col("_k.t").alias("_t"), (-F.col("_k.s")).alias("_s"))
    same = F.col("url").eqNullSafe(F.col("_u")) & F.col(time_col).eqNullSafe(F.col("_t")) & (F.col(seq_col) == F.col("_s"))
    return df.join(latest, same).select(*df.columns)


def sitemap_rows(df: DataFrame, score_col: str | None = "seo_score", latest_only: bool = False) -> DataFrame:
    """One row per URL (latest version) with domain, lastmod, changefreq,
    priority. ``latest_only`` says the input already holds one row per URL."""
    latest = df if latest_only else latest_by_url(df)
    score = F.col(score_col) if score_col and score_col in latest.columns else F.lit(None).cast("double")
    depth = F.col("depth") if "depth" in latest.columns else F.lit(None).cast("long")
    ctype = F.col("content_type") if "content_type" in latest.columns else F.lit(None).cast("string")
    return latest.select(
        url_domain("url").alias("domain"),
        F.col("url").alias("loc"),
        F.col("crawl_time").alias("lastmod"),
        change_freq(ctype).alias("changefreq"),
        sitemap_priority(score, depth).alias("priority"),
    )


def shard_sitemap(rows: DataFrame, n: int = SITEMAP_SHARD_SIZE) -> DataFrame:
    """H9: shard number per domain, ``n`` URLs per shard, in loc order."""
    ranked = dense_ids(rows, "loc", "_pos", group_by="domain")
    return ranked.withColumn("shard", F.floor(F.col("_pos") / F.lit(n)).cast("long")).drop("_pos")


def sitemap_index(shards: DataFrame, base_url: str, lastmod: str) -> DataFrame:
    """One entry per sitemap file: loc = base_url/sitemap_<domain>_<shard>.xml."""
    files = shards.select("domain", "shard").distinct()
    name = F.concat(F.lit("sitemap_"), F.col("domain"), F.lit("_"), F.col("shard").cast("string"), F.lit(".xml"))
    return files.select(
        "domain", "shard",
        F.concat(F.lit(base_url.rstrip("/")), F.lit("/"), name).alias("loc"),
        F.lit(lastmod).alias("lastmod"),
    )
