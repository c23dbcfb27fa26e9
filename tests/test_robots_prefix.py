"""Longest-prefix join of robots rules: the verdicts of robots_filter, and rules of one host spread over tasks."""

import random

from pyspark.sql import functions as F

from sitelens.operators.robots import robots_by_prefix, robots_filter

RULES = "host string, kind string, path string"


def test_same_verdicts(spark):
    rnd = random.Random(2)
    some = lambda: "/" + "/".join(rnd.choice(["a", "ab", "b.c", "é", "x$y", ""]) for _ in range(rnd.randrange(4)))
    rules = [(f"h{i % 3}.org", rnd.choice(["allow", "disallow"]), some() + rnd.choice(["", "", "*", "*b", "$", "*/b$"])) for i in range(60)]
    rules += [("h0.org", "disallow", "*c"), ("h1.org", "allow", "/"), ("h1.org", "disallow", "/")]
    urls = [(i, f"http://h{rnd.randrange(4)}.org{some()}{rnd.choice(['', '?q=1', ';p'])}") for i in range(300)] + [(900, None), (901, "http://H0.org"), (902, "x")]
    u = spark.createDataFrame(urls, "page_id long, url string").withColumn("path", F.lit("clash"))
    r = spark.createDataFrame(rules, RULES).distinct()
    want = {x.page_id: x.allowed for x in robots_filter(u, r).collect()}
    got = robots_by_prefix(u, r)
    assert got.columns == ["page_id", "url", "path", "allowed"]
    assert {x.page_id: x.allowed for x in got.collect()} == want and False in want.values()
    assert robots_by_prefix(u, r.limit(0)).where("NOT allowed").count() == 0


def test_a_host_with_many_rules(spark):
    rules = spark.range(100_000).select(F.lit("h.org").alias("host"), F.when(F.col("id") % 2 == 0, "allow").otherwise("disallow").alias("kind"),
                                        F.concat(F.lit("/p"), F.col("id")).alias("path"))
    urls = spark.range(0, 200_000, 50).select(F.concat(F.lit("http://h.org/p"), F.col("id"), F.lit("/x")).alias("url"), "id")
    spread = rules.repartition(8, "host", "path").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 20_000
    got = {r.id: r.allowed for r in robots_by_prefix(urls, rules).collect()}

    def slow(i):
        best = max((len(f"/p{k}"), k % 2 == 0) for k in {int(str(i)[:n]) for n in range(1, len(str(i)) + 1)} if k < 100_000 and str(i).startswith(str(k)))
        return best[1]

    assert got == {i: slow(i) for i in got}
