"""URL-change notification batches as tables.

No request is sent: the operators build the payload rows a submitter would
post, fan them out to engines and roll results up. A host's URLs are split
into chunks of at most ``MAX_URLS_PER_BATCH`` (the protocol's per-request
limit) with a distributed per-host numbering, so a host holding a third of
all URLs is never collected into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import key_location, netloc, url_part, G_SCHEME
from sitelens.plans.ids import dense_ids

# Notification endpoints by engine name.
ENDPOINTS = {
    "default": "https://api.indexnow.org/indexnow",
    "bing": "https://www.bing.com/indexnow",
    "yandex": "https://yandex.com/indexnow",
    "seznam": "https://search.seznam.cz/indexnow",
    "naver": "https://searchadvisor.naver.com/indexnow",
    "yep": "https://yep.com/indexnow",
}
MAX_URLS_PER_BATCH = 10000

# Crawler user-agent strings by name (public crawler identifiers).
USER_AGENTS = {
    "Googlebot": "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Bingbot": "Mozilla/5.0 (compatible; bingbot/2.0; +https://www.bing.com/bingbot.htm)",
    "YandexBot": "Mozilla/5.0 (compatible; YandexBot/3.0; +http://yandex.com/bots)",
    "AppleBot": "Mozilla/5.0 (iPhone; CPU iPhone OS 10_3_1 like Mac OS X) AppleWebkit/603.1.30 (KHTML, like Gecko) Version/10.0 Mobile/14E304 Safari/602.1 (Applebot/0.1)",
    "DuckDuckBot": "DuckDuckBot/1.0; (+http://duckduckgo.com/duckduckbot.html)",
    "BaiduSpider": "Mozilla/5.0 (compatible; Baiduspider/2.0; +http://www.baidu.com/search/spider.html)",
    "SogouSpider": "sogou Pic Spider/3.0( http://www.sogou.com/docs/help/webmasters.htm#07)",
    "FacebookExternalHit": "facebookexternalhit/1.0 (+http://www.facebook.com/externalhit_uatext.php)",
    "Exabot": "Mozilla/5.0 (compatible; Exabot/3.0; +http://www.exabot.com/go/robot)",
    "Swiftbot": "Mozilla/5.0 (compatible; Swiftbot/1.0; UID/54e1c2ebd3b687d3c8000018; +http://swiftype.com/swiftbot)",
    "SlurpBot": "Mozilla/5.0 (compatible; Yahoo! Slurp; http://help.yahoo.com/help/us/ysearch/slurp)",
    "CCBot": "CCBot/2.0 (https://commoncrawl.org/faq/)",
    "GoogleInspectionTool": "Mozilla/5.0 (compatible; Google-InspectionTool/1.0)",
    "AhrefsBot": "Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)",
    "SemrushBot": "Mozilla/5.0 (compatible; SemrushBot/7~bl; +http://www.semrush.com/bot.html)",
    "Rogerbot": "rogerbot",
    "ScreamingFrog": "Screaming Frog SE Spider",
    "Lumar": "Lumar Crawler",
    "Majestic": "MJ12bot",
    "CognitiveSEO": "JamesBOT",
    "Oncrawl": "Oncrawl",
}
DEFAULT_USER_AGENT = "sitelens/0.1"


def user_agent_table(spark) -> DataFrame:
    return spark.createDataFrame(list(USER_AGENTS.items()), "ua_key string, user_agent string")


def with_user_agent(df: DataFrame, key_col: str = "ua_key", default: str = DEFAULT_USER_AGENT) -> DataFrame:
    """User-agent string by key; missing or unknown keys get the default.
    The lookup table has a fixed 21 rows, so it is broadcast."""
    t = F.broadcast(user_agent_table(df.sparkSession)).withColumnRenamed("ua_key", "__k")
    return (df.join(t, df[key_col] == t["__k"], "left").drop("__k")
            .withColumn("user_agent", F.coalesce(F.col("user_agent"), F.lit(default))))


def endpoint_table(spark) -> DataFrame:
    return spark.createDataFrame(list(ENDPOINTS.items()), "engine string, endpoint string")


def submit_candidates(df: DataFrame, col: str = "url") -> DataFrame:
    """M1: rows with a non-empty URL."""
    return df.where(F.col(col).isNotNull() & (F.length(col) > 0))


def notify_batches(df: DataFrame, key: str, bulk: bool = True, key_loc: str | None = None,
                   col: str = "url", max_urls: int = MAX_URLS_PER_BATCH) -> DataFrame:
    """M2: payload rows (origin, chunk, host, key, keyLocation, urlList, n_urls, payload json).

    URLs are grouped by origin (scheme://host). With ``bulk`` an origin with
    more than one URL gets one payload per chunk of ``max_urls`` URLs (sorted);
    otherwise every URL is its own payload.
    """
    u = submit_candidates(df, col).select(F.col(col).alias("url")).distinct()
    u = u.withColumn("origin", F.concat(url_part("url", G_SCHEME), F.lit("://"), netloc("url")))
    if bulk:
        # an origin with a single URL lands in chunk 0 alone: the single-URL payload
        numbered = dense_ids(u, "url", "_pos", group_by="origin")
        keyed = numbered.withColumn("chunk", F.floor(F.col("_pos") / F.lit(max_urls)).cast("long"))
        grouped = keyed.groupBy("origin", "chunk").agg(
            F.sort_array(F.collect_list("url")).alias("urlList"))
    else:
        grouped = u.select("origin", F.lit(0).cast("long").alias("chunk"), F.array("url").alias("urlList"))
    first = F.element_at("urlList", 1)
    out = grouped.select(
        "origin", "chunk",
        netloc(first).alias("host"),
        F.lit(key).alias("key"),
        key_location(first, key, key_loc).alias("keyLocation"),
        "urlList",
        F.size("urlList").cast("long").alias("n_urls"),
    )
    return out.withColumn("payload", F.to_json(F.struct("host", "key", "keyLocation", "urlList")))


def fan_out_engines(batches: DataFrame, engines=("default",)) -> DataFrame:
    """M3 + E8: every payload once per requested engine; unknown engines keep
    their row with a null endpoint and an error text."""
    names = F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine")
    fanned = batches.select("*", names)
    ep = F.broadcast(endpoint_table(batches.sparkSession))  # 6 fixed rows
    return validate_engine(fanned.join(ep, "engine", "left"))


def validate_engine(df: DataFrame) -> DataFrame:
    """Error row for an engine without endpoint."""
    return df.withColumn("error", F.when(F.col("endpoint").isNull(),
                                         F.concat(F.lit("No endpoint known for "), F.col("engine"))))


def notify_rollup(results: DataFrame) -> DataFrame:
    """Per engine: submissions, successes, overall success (all succeeded)."""
    return results.groupBy("engine").agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_if("success").alias("success_count"),
        F.bool_and("success").alias("overall_success"),
    )


def notify_overall(results: DataFrame) -> DataFrame:
    """One row over all engines: submissions, successes, and whether there were any and all succeeded."""
    return results.agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_if("success").alias("success_count"),
        F.coalesce(F.bool_and("success"), F.lit(False)).alias("overall_success"),
    )
