"""robots.txt rules as tables.

``parse_robots`` turns ``(host, body)`` rows into rule rows with one
``posexplode`` over the lines and a ``last(..., ignorenulls)`` window that
carries the applicability of the most recent User-agent line down the file
(a window per file: a robots file is bounded in size). ``robots_filter`` is an
equi-join of URLs and rules on host, a per-URL aggregate of the longest
matching allow and disallow, and a left join back so URLs without rules stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import G_PATH, netloc, py_strip, url_part

DEFAULT_AGENT = "sitelens/0.1"


def _value(line: Column, prefix_len: int) -> Column:
    return py_strip(F.substring(line, prefix_len + 1, 1 << 30))


def robots_lines(df: DataFrame, agent: str = DEFAULT_AGENT, host_col: str = "host",
                 body_col: str = "body") -> DataFrame:
    """One row per meaningful line: (host, line_no, directive, value, applies)."""
    main_agent = agent.lower().split("/")[0].strip()
    lines = df.select(F.col(host_col).alias("host"),
                      F.posexplode(F.split(F.coalesce(F.col(body_col), F.lit("")), "\n")).alias("line_no", "raw"))
    line = py_strip(F.split(F.col("raw"), "#")[0])
    lines = lines.select("host", "line_no", line.alias("line")).where(F.length("line") > 0)
    low = F.lower("line")
    directive = (F.when(low.startswith("sitemap:"), "sitemap")
                 .when(low.startswith("user-agent:"), "user-agent")
                 .when(low.startswith("disallow:"), "disallow")
                 .when(low.startswith("allow:"), "allow")
                 .when(low.startswith("crawl-delay:"), "crawl-delay"))
    value = (F.when(directive == "sitemap", _value(F.col("line"), 8))
             .when(directive == "user-agent", F.lower(_value(F.col("line"), 11)))
             .when(directive == "disallow", _value(F.col("line"), 9))
             .when(directive == "allow", _value(F.col("line"), 6))
             .when(directive == "crawl-delay", _value(F.col("line"), 12)))
    lines = lines.select("host", "line_no", directive.alias("directive"), value.alias("value"))
    ua_match = F.when(F.col("directive") == "user-agent",
                      (F.col("value") == "*") | (F.instr(F.lit(main_agent), F.col("value")) > 0))
    w = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("applies", F.coalesce(F.last(ua_match, ignorenulls=True).over(w), F.lit(False)))


def parse_robots(df: DataFrame, agent: str = DEFAULT_AGENT, host_col: str = "host",
                 body_col: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """F4 -> (rules(host, kind, path), delays(host, crawl_delay), sitemaps(host, line_no, sitemap)).

    Sitemap lines are global; Allow/Disallow/Crawl-delay count while the most
    recent User-agent line is '*' or a substring of our agent's name; empty
    values and unparsable delays are ignored; the last valid delay wins.
    """
    lines = robots_lines(df, agent, host_col, body_col)
    rules = (lines.where(F.col("directive").isin("allow", "disallow") & F.col("applies") & (F.length("value") > 0))
             .select("host", F.col("directive").alias("kind"), F.col("value").alias("path")).distinct())
    delay = F.expr("try_cast(value AS DOUBLE)")
    delays = (lines.where((F.col("directive") == "crawl-delay") & F.col("applies"))
              .select("host", "line_no", delay.alias("d")).where(F.col("d").isNotNull())
              .groupBy("host").agg(F.max_by("d", "line_no").alias("crawl_delay")))
    sitemaps = (lines.where((F.col("directive") == "sitemap") & (F.length("value") > 0))
                .select("host", "line_no", F.col("value").alias("sitemap")))
    return rules, delays, sitemaps


def rule_regex(path: Column) -> Column:
    """Regex for a rule with '*' or a trailing '$': literal characters quoted,
    '*' -> '.*', trailing '$' -> end anchor; otherwise null (prefix rule)."""
    body = F.regexp_replace(path, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")),
                       F.when(path.endswith("$"), F.lit("$")).otherwise(F.lit("")))
    return F.when(path.contains("*") | path.endswith("$"), pattern)


def url_path(col) -> Column:
    p = F.regexp_extract(url_part(col, G_PATH), r"^((?:.*/)?[^;/]*)(;[^/]*)?$", 1)
    return F.when(F.length(p) > 0, p).otherwise(F.lit("/"))


def robots_filter(urls: DataFrame, rules: DataFrame, col: str = "url") -> DataFrame:
    """urls + ``allowed``. The longest matching disallow blocks unless a
    strictly longer allow matches; rules match the path only (query ignored,
    empty path = '/'); URLs of hosts without rules are allowed."""
    r = rules.select("host", "kind", "path", rule_regex(F.col("path")).alias("re"))
    # one row for each host; a robots file is bounded by what crawlers read of it
    files = r.groupBy("host").agg(F.collect_list(F.struct("kind", "path", "re")).alias("_rules")).withColumnRenamed("host", "_host")
    hit = lambda x: F.when(x["re"].isNotNull(), F.regexp_like(F.col("_path"), x["re"])).otherwise(
        F.col("_path").startswith(x["path"]))

    def longest(kind):
        matching = F.filter("_rules", lambda x: (x["kind"] == kind) & hit(x))
        return F.coalesce(F.array_max(F.transform(matching, lambda x: F.length(x["path"]))), F.lit(-1))

    out = urls.withColumn("_path", url_path(col)).join(files, F.lower(netloc(col)) == F.col("_host"), "left")
    out = out.withColumn("_dis", longest("disallow")).withColumn("_all", longest("allow"))
    return out.withColumn("allowed", (F.col("_dis") < 0) | (F.col("_all") > F.col("_dis"))).drop(
        "_path", "_host", "_rules", "_dis", "_all")


def robots_by_prefix(urls: DataFrame, rules: DataFrame, col: str = "url") -> DataFrame:
    """F5 by a longest-prefix join: the same verdicts as :func:`robots_filter`, for hosts with any number of rules.

    A rule lies under (host, literal beginning): its whole path, or what stands before its first wildcard. Distinct paths
    give their prefixes of the lengths that the host's rules have (one small array a host), the prefixes meet the rules by
    equality, wildcards are then tried on what met, and the longest allow and disallow of each path are kept. Rules and
    URLs of one host are spread over tasks by their prefixes; no file is collected into a row."""
    literal = F.when(F.col("path").contains("*"), F.regexp_extract("path", r"^[^*]*", 0)).otherwise(F.regexp_replace("path", r"\$$", ""))
    keyed = rules.select("host", "kind", F.length("path").alias("_size"), literal.alias("_prefix"), rule_regex(F.col("path")).alias("_re"))
    lengths = keyed.groupBy("host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    named = urls.withColumns({"_host": F.lower(netloc(col)), "_path": url_path(col)})
    paths = named.select(F.col("_host").alias("host"), "_path").distinct().join(lengths, "host")
    prefixes = paths.select("host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"))
    prefixes = prefixes.select("host", "_path", F.substring(F.col("_path"), F.lit(1), F.col("_n")).alias("_prefix"))
    met = prefixes.join(keyed, ["host", "_prefix"]).where(F.col("_re").isNull() | F.regexp_like(F.col("_path"), F.col("_re")))
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("_size"))), F.lit(-1))
    verdict = met.groupBy("host", "_path").agg(longest("disallow").alias("_dis"), longest("allow").alias("_all"))
    verdict = verdict.where((F.col("_dis") >= 0) & (F.col("_all") <= F.col("_dis"))).select(
        F.col("host").alias("_h"), F.col("_path").alias("_p"))
    out = named.join(verdict, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
    return out.withColumn("allowed", F.col("_h").isNull()).drop("_host", "_path", "_h", "_p")


def effective_delay(hosts: DataFrame, delays: DataFrame, base: float, host_col: str = "host") -> DataFrame:
    """max(configured delay, robots crawl-delay) per host."""
    j = hosts.join(delays.withColumnRenamed("host", host_col), host_col, "left")
    return j.withColumn("delay", F.greatest(F.lit(float(base)), F.coalesce(F.col("crawl_delay"), F.lit(float(base)))))


def robots_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """sitemap URLs listed by each host, in file order."""
    return sitemaps.select("host", "line_no", "sitemap")
