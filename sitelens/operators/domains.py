"""Domain-name analytics.

All per-domain work is a single wide projection; the summary is three
group-bys (partial aggregation map-side) unioned into a long
``(metric, key, value)`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# TLD categories and suspicious name patterns (case-insensitive, searched anywhere).
TLD_CATEGORIES = {
    "generic": ["com", "net", "org", "info", "biz"],
    "country": ["uk", "us", "eu", "cn", "ru", "in"],
    "new": ["app", "dev", "web", "cloud", "ai", "io"],
}
SUSPICIOUS_PATTERNS = [
    r"login.*\d+",
    r"secure.*\d+",
    r"account.*verify",
    r"wallet.*verify",
    r"crypto.*invest",
    r"\d+.*login",
    r"verify.*\d+",
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _host_of(domain: Column) -> Column:
    # the host part a URL parser sees in "http://" + domain
    return F.regexp_extract(F.concat(F.lit("http://"), domain), r"^http://([^/?#]*)", 1)


def domain_features(df: DataFrame, col: str = "domain") -> DataFrame:
    """L1: length, dot-separated parts, digits, hyphens, tld ('' for one part)."""
    d = F.col(col)
    parts = F.split(_host_of(d), r"\.")
    return df.withColumns({
        "length": F.length(d).cast("long"),
        "num_parts": F.size(parts).cast("long"),
        "num_digits": F.length(F.regexp_replace(d, r"[^\p{Nd}]", "")).cast("long"),
        "num_hyphens": (F.length(d) - F.length(F.replace(d, F.lit("-"), F.lit("")))).cast("long"),
        "tld": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")),
    })


def tld_category(col) -> Column:
    """L2: generic / country / new / other."""
    t = _c(col)
    out = F.lit("other")
    for cat in reversed(list(TLD_CATEGORIES)):
        out = F.when(t.isin(*TLD_CATEGORIES[cat]), F.lit(cat)).otherwise(out)
    return out


def suspicious_patterns(col) -> Column:
    """L3: the patterns (in their fixed order) that match the domain."""
    d = _c(col)
    hits = [F.when(d.rlike(f"(?i){p}"), F.lit(p)) for p in SUSPICIOUS_PATTERNS]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def analyze_domains(df: DataFrame, col: str = "domain", whois: DataFrame | None = None,
                    dns: DataFrame | None = None) -> DataFrame:
    """L4: distinct stripped domains with L1-L3 (and F9/F10 when lookup tables are given)."""
    d = df.select(F.regexp_replace(F.col(col), r"^\s+|\s+$", "").alias("domain")).distinct()
    out = domain_features(d)
    out = out.withColumn("tld_category", tld_category("tld")).withColumn(
        "suspicious_patterns", suspicious_patterns("domain"))
    if whois is not None:
        out = enrich_whois(out, whois)
    if dns is not None:
        out = enrich_dns(out, dns)
    return out


def enrich_whois(df: DataFrame, whois: DataFrame) -> DataFrame:
    """creation_date, registrar, country from a supplied table; null when absent."""
    w = whois.select("domain", F.struct(
        F.col("creation_date").cast("string").alias("creation_date"),
        F.col("registrar").cast("string").alias("registrar"),
        F.col("country").cast("string").alias("country"),
    ).alias("whois"))
    return df.join(w, "domain", "left")


DNS_TYPES = ["A", "MX", "NS", "TXT"]


def enrich_dns(df: DataFrame, dns: DataFrame) -> DataFrame:
    """map record type -> list of values (A, MX, NS, TXT) from (domain, type, value) rows; a type without an
    answer is a null entry, a domain that the rows don't hold has a null map. The per-domain lists are bounded by what a DNS answer holds."""
    agg = dns.where(F.col("type").isin(*DNS_TYPES)).groupBy("domain", "type").agg(
        F.sort_array(F.collect_list("value")).alias("values"))
    per = agg.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("type", "values"))).alias("dns"))
    entries = [x for t in DNS_TYPES for x in (F.lit(t), F.try_element_at("dns", F.lit(t)))]
    return df.join(per.withColumn("dns", F.create_map(*entries)), "domain", "left")


def domain_summary(analysed: DataFrame) -> DataFrame:
    """Long table (metric, key, value): totals, tld / category / pattern
    distributions and mean length, parts and digits (6 decimals)."""
    dist = lambda name, c: analysed.groupBy(F.col(c).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
    pats = (analysed.select(F.explode("suspicious_patterns").alias("key")).groupBy("key")
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
            .select(F.lit("suspicious_patterns").alias("metric"), "key", "value"))
    means = analysed.agg(
        F.count(F.lit(1)).cast("double").alias("total_domains"),
        F.round(F.avg("length"), 6).alias("avg_domain_length"),
        F.round(F.avg("num_parts"), 6).alias("avg_num_parts"),
        F.round(F.avg("num_digits"), 6).alias("avg_num_digits"),
    )
    scalars = means.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(m).alias("value"))
        for m in ("total_domains", "avg_domain_length", "avg_num_parts", "avg_num_digits")
    ])).alias("s")).select("s.*")
    return (dist("tld_distribution", "tld").unionByName(dist("tld_category_distribution", "tld_category"))
            .unionByName(pats).unionByName(scalars))


def union_domains(a: DataFrame, b: DataFrame, distinct: bool = False, col: str = "domain") -> DataFrame:
    """H8: all rows of both sources (tags kept), or the distinct domain set."""
    if distinct:
        return a.select(col).unionByName(b.select(col)).distinct()
    return a.unionByName(b, allowMissingColumns=True)


# Source and type labels of the labelled domain rows.
NEW_SOURCE, PHISHING_SOURCE = "whoisds", "phishing_list"
NEW_TYPE, PHISHING_TYPE = "new_registration", "phishing"


def domain_dataset(new: DataFrame, phishing: DataFrame, phishing_date: str) -> DataFrame:
    """Labelled rows (domain, source, date, type); new-registration rows
    carry the date of their list, phishing rows the given date."""
    n = new.select(F.regexp_replace("domain", r"^\s+|\s+$", "").alias("domain"), F.lit(NEW_SOURCE).alias("source"),
                   F.col("date").cast("string").alias("date"), F.lit(NEW_TYPE).alias("type"))
    p = phishing.select(F.regexp_replace("domain", r"^\s+|\s+$", "").alias("domain"), F.lit(PHISHING_SOURCE).alias("source"),
                        F.lit(phishing_date).alias("date"), F.lit(PHISHING_TYPE).alias("type"))
    return n.unionByName(p)
