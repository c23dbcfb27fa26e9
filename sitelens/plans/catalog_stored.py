"""Queries on tables that are written first and read back: the stored index and its merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelens.functions.text import snippet
from sitelens.plans import fixtures as FX
from sitelens.plans import oracle_sql as Q
from sitelens.plans.catalog import BOOST_QUERY, FLAGSHIP_QUERY, pages_index_input, register
from sitelens.session import ensure_checkpoint_dir, read_table
from sitelens.sources import segments as SG

#: Bytes of pages for each bucket of a stored index.
BUCKET_BYTES = 256 << 20
_STORED: dict = {}


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_input(spark, sf_dir):
    """Index rows of the pages: snippet and description are the beginnings of the text, page_id orders a URL's rows."""
    rows = pages_index_input(spark, sf_dir)
    return rows.select("url", "title", "content", snippet("content").alias("snippet"),
                       F.substring("content", 1, 120).alias("description"), F.col("page_id").alias("seq"))


def stored_pages(spark, sf_dir) -> SG.Index:
    """The stored index of the pages: written once for each state of the files and read by all searches of a session."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path).getLength()
    key = (spark.sparkContext.applicationId, sf_dir, size, fs.getFileStatus(path).getModificationTime())
    if key not in _STORED:
        root = scratch(spark, "stored-index")
        SG.merge(spark, root, stored_input(spark, sf_dir), buckets=max(8, size // BUCKET_BYTES))
        _STORED.clear()
        _STORED[key] = root
    return SG.Index(spark, _STORED[key])


SQL_STORED = f"""newest AS (SELECT page_id, url, {Q.title('html')} AS title, {Q.visible_text('html')} AS content FROM pages
  WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
docs AS (SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url, title, content, substr(content, 1, 120) AS description,
  CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' WHEN length(content) > 0 THEN content
       ELSE 'No description available' END AS snippet FROM newest),
toks AS (SELECT doc_id, {Q.tokenize("title || ' ' || snippet || ' ' || content")} AS tokens FROM docs),
postings AS (SELECT DISTINCT unnest(list_distinct(tokens)) AS term, doc_id FROM toks)"""

SQL_FOUND = """CAST(r.rank AS BIGINT) AS rank, r.score, CAST(r.doc_id AS BIGINT) AS doc_id, d.url, d.title, d.snippet, 'unknown' AS type, '' AS date"""


@register("stored_search", f"""WITH {SQL_STORED},
q AS (SELECT token, count(*) AS weight FROM (SELECT unnest({Q.tokenize(Q.lit(FLAGSHIP_QUERY))}) AS token) GROUP BY token),
w AS (SELECT v.term, sum(q.weight) AS w FROM (SELECT DISTINCT term FROM postings) v JOIN q ON strpos(v.term, q.token) > 0 GROUP BY v.term),
scored AS (SELECT p.doc_id, CAST(sum(w.w) AS BIGINT) AS score FROM postings p JOIN w USING (term) GROUP BY p.doc_id),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT {SQL_FOUND} FROM r JOIN docs d USING (doc_id) WHERE r.rank <= 10""")
def stored_search(spark, sf_dir):
    """Top-10 contains-search on the stored index, with the whole documents."""
    return SG.search(stored_pages(spark, sf_dir), FLAGSHIP_QUERY)


def _sql_boosts(query: str) -> str:
    from sitelens.operators.index import BOOSTS
    return " + ".join(f"(CASE WHEN strpos(lower({field}), {Q.lit(t)}) > 0 THEN {boost} ELSE 0 END)"
                      for field, boost in BOOSTS.items() for t in query.split())


@register("stored_boosted", f"""WITH {SQL_STORED},
scored AS (SELECT doc_id, CAST({_sql_boosts(BOOST_QUERY)} AS DOUBLE) AS score FROM docs),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT {SQL_FOUND} FROM r JOIN docs d USING (doc_id) WHERE r.rank <= 100""")
def stored_boosted(spark, sf_dir):
    """Boosted search over title, url, description and content by block bounds on the stored index, top 100."""
    return SG.search_boosted(stored_pages(spark, sf_dir), BOOST_QUERY)


@register("stored_batch", f"""WITH {SQL_STORED},
qt AS (SELECT query_id, token, count(*) AS weight
  FROM (SELECT item_id AS query_id, unnest({Q.tokenize('text')}) AS token FROM benchmark) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM postings),
m AS (SELECT DISTINCT v.term, t.token FROM vocab v JOIN (SELECT DISTINCT token FROM qt) t ON strpos(v.term, t.token) > 0),
w AS (SELECT qt.query_id, m.term, sum(qt.weight) AS w FROM qt JOIN m USING (token) GROUP BY ALL),
scored AS (SELECT w.query_id, p.doc_id, sum(w.w) AS score FROM w JOIN postings p USING (term) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10""")
def stored_batch(spark, sf_dir):
    """Every benchmark text, whole, against the stored index, top 10 each."""
    return SG.search_batch(stored_pages(spark, sf_dir), FX.benchmark_queries(spark, sf_dir))


def merged_index(spark, sf_dir) -> SG.Index:
    """I4: pages with SEO fields, then a batch: every ninth page anew, every tenth under a new URL; the scores of all but
    every 18th page are missing in the batch."""
    pages = read_table(spark, sf_dir, "pages").where("url IS NOT NULL")
    base = pages_index_input(spark, sf_dir).where("url IS NOT NULL").select(
        "url", "title", "content", F.col("page_id").alias("seq"), ((F.col("page_id") * 7 % 1001) / 10).alias("seo_score"),
        F.array(F.concat(F.lit("page "), F.col("page_id"))).alias("structured_data"))
    again = pages.where("page_id % 9 = 0").select(
        "url", F.concat(F.lit("Updated "), F.col("page_id")).alias("title"), F.lit("second crawl").alias("content"),
        F.col("page_id").alias("seq"), F.when(F.col("page_id") % 18 == 0, F.lit(1.0)).alias("seo_score"), F.lit("mobile").alias("type"))
    fresh = pages.where("page_id % 10 = 0").select(
        F.concat("url", F.lit("/new")).alias("url"), F.lit("New page").alias("title"), F.lit("first crawl").alias("content"),
        F.col("page_id").alias("seq"), F.lit(None).cast("double").alias("seo_score"), F.lit("image").alias("type"))
    root = scratch(spark, "merged-index")
    SG.merge(spark, root, base, batch=0, buckets=8)
    SG.merge(spark, root, again.unionByName(fresh), batch=1)
    return SG.Index(spark, root)


SQL_MERGED = f"""base AS (SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, * FROM (
  SELECT url, {Q.title('html')} AS title, {Q.visible_text('html')} AS content, (page_id * 7 % 1001) / 10.0 AS seo_score,
    'page ' || page_id AS structured FROM pages WHERE url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)),
batch AS (SELECT * FROM (
  SELECT page_id, url, 'Updated ' || page_id AS title, 'second crawl' AS content, 'mobile' AS type,
    CASE WHEN page_id % 18 = 0 THEN 1.0 END AS seo_score FROM pages WHERE url IS NOT NULL AND page_id % 9 = 0
  UNION ALL SELECT page_id, url || '/new', 'New page', 'first crawl', 'image', NULL FROM pages WHERE url IS NOT NULL AND page_id % 10 = 0)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
docs AS (
  SELECT b.doc_id, b.url, coalesce(n.title, b.title) AS title, coalesce(n.content, b.content) AS content,
    coalesce(n.type, 'unknown') AS type, CAST(coalesce(n.seo_score, b.seo_score) AS DOUBLE) AS seo_score, b.structured
  FROM base b LEFT JOIN batch n USING (url)
  UNION ALL SELECT (SELECT max(doc_id) FROM base) + row_number() OVER (ORDER BY n.url), n.url, n.title, n.content, n.type,
    CAST(n.seo_score AS DOUBLE), NULL FROM batch n WHERE n.url NOT IN (SELECT url FROM base))"""


@register("stored_merge", f"""WITH {SQL_MERGED}
SELECT CAST(doc_id AS BIGINT) AS doc_id, url, title, type, seo_score, structured FROM docs""")
def stored_merge(spark, sf_dir):
    """I4: documents of a stored index after a merge; SEO fields that the batch lacks stay."""
    return merged_index(spark, sf_dir).documents.select(
        "doc_id", "url", "title", "type", "seo_score", F.get("structured_data", F.lit(0)).alias("structured"))


@register("stored_merge_postings", f"""WITH {SQL_MERGED},
toks AS (SELECT doc_id, {Q.tokenize("title || ' ' || '' || ' ' || content")} AS tokens FROM docs)
SELECT DISTINCT unnest(list_distinct(tokens)) AS term, CAST(doc_id AS BIGINT) AS doc_id FROM toks""")
def stored_merge_postings(spark, sf_dir):
    """I4: postings of a stored index after a merge (those of updated documents replaced)."""
    return merged_index(spark, sf_dir).postings


# --------------------------------------------------------------------------- streams with state, bucketed graph, sitemap files

@register("change_stream", f"""WITH prev AS ({Q.page_records_cte()}),
versions AS (SELECT page_id, url, html, page_id * 2 AS seq FROM prev
  UNION ALL SELECT page_id, url, CASE WHEN page_id % 8 = 0 THEN html || '<!-- v2 -->' ELSE html END, page_id * 2 + 1 FROM prev WHERE page_id % 4 = 0),
state AS (SELECT url, max(md5(html)) AS md5 FROM prev GROUP BY url)
SELECT v.url, CAST(v.seq AS BIGINT) AS seq, CASE WHEN s.url IS NULL THEN 'new' WHEN md5(v.html) = s.md5 THEN 'unchanged' ELSE 'changed' END AS change_status
FROM versions v LEFT JOIN state s USING (url)""")
def change_stream(spark, sf_dir):
    """A second crawl as a stream, compared with the state that a stream of the first crawl left."""
    from sitelens.streaming import change_stream as CS

    base = scratch(spark, "change-stream")
    first = FX.page_records(spark, sf_dir).select("url", "html", (F.col("page_id") * 2).alias("seq"))
    second = FX.page_versions(spark, sf_dir).select("url", "html", "seq")
    for k, rows in enumerate((first, second)):
        rows.write.parquet(f"{base}/in/crawl={k}")
        source = spark.readStream.schema("url string, html string, seq long").parquet(f"{base}/in/*")
        CS.run_available(CS.change_stream(source), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("url string, seq long, change_status string").parquet(f"{base}/out/batch=1")


def stored_graph(spark, sf_dir, **options):
    from sitelens.operators import linkgraph as LG

    return LG.store_graph(FX.derived_edges(spark, sf_dir), **options)


from sitelens.plans.catalog import BFS_MAX_DEPTH, SHARD_SIZE, SITEMAP_BASE, SITEMAP_LASTMOD, SQL_SITEMAP, bfs_seeds, sitemap_table, sql_bfs  # noqa: E402


@register("crawl_graph", sql_bfs(BFS_MAX_DEPTH))
def crawl_graph(spark, sf_dir):
    """the same BFS over the stored graph; only frontiers are shuffled."""
    from sitelens.operators import linkgraph as LG

    return LG.crawl_graph(stored_graph(spark, sf_dir), bfs_seeds(spark, sf_dir), BFS_MAX_DEPTH)


@register("sitemap_files", f"""SELECT 'sitemap_' || domain || '_' || shard || '.xml' AS name, loc, lastmod, changefreq, CAST(priority AS VARCHAR) AS priority,
  '{SITEMAP_BASE}sitemap_' || domain || '_' || shard || '.xml' AS listed
FROM (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY loc) - 1) // {SHARD_SIZE} AS shard FROM ({SQL_SITEMAP}))""")
def sitemap_files(spark, sf_dir):
    """The URLs of the sitemap files under their names, each file joined with its entry of the index file."""
    from sitelens.operators import seo as SEO
    from sitelens.sources import sitemap_source as SS

    path = scratch(spark, "sitemaps")
    SS.write_sitemaps(SEO.shard_sitemap(sitemap_table(spark, sf_dir), SHARD_SIZE), path, SITEMAP_BASE, SITEMAP_LASTMOD)
    read = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, changefreq string, priority string")
    urls = read.load(f"{path}/sitemap_*_*.xml").withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    listed = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(f"{path}/{SS.INDEX_NAME}")
    listed = listed.select(F.col("loc").alias("listed"), F.element_at(F.split("loc", "/"), -1).alias("name"))
    return urls.join(listed, "name", "full").select("name", "loc", "lastmod", "changefreq", "priority", "listed")


# --------------------------------------------------------------------------- language model, sketches

def language_counts(spark, sf_dir):
    from sitelens.operators import langmodel as LM

    docs = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2", "3")
    return LM.word_counts(docs.withColumn("held_out", held), keys=("doc_id", "lang", "held_out"))


_SQL_WORDS = Q.lit(r"[\p{L}\p{N}_]+")
SQL_LANGUAGE = f"""docs AS (SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out,
  unnest(regexp_extract_all(lower(text), {_SQL_WORDS})) AS word FROM documents WHERE doc_id IS NOT NULL),
counts AS (SELECT doc_id, lang, held_out, word, count(*) AS n FROM docs GROUP BY ALL),
cut AS (SELECT word, ' ' || word || ' ' AS w FROM (SELECT DISTINCT word FROM counts)),
wgrams AS (SELECT word, substr(w, i, 3) AS gram FROM (SELECT word, w, unnest(range(1, length(w) - 1)) AS i FROM cut)),
seen AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, word, sum(n) AS n FROM counts WHERE NOT held_out GROUP BY ALL) JOIN wgrams USING (word)
  GROUP BY ALL),
totals AS (SELECT lang, sum(n) + 0.5 * (SELECT count(DISTINCT gram) FROM seen) AS under FROM seen GROUP BY lang),
scores AS (SELECT c.doc_id, t.lang AS guess, sum(c.n * ln((coalesce(s.n, 0) + 0.5) / t.under)) AS score
  FROM counts c JOIN wgrams g USING (word) CROSS JOIN totals t LEFT JOIN seen s ON s.lang = t.lang AND s.gram = g.gram GROUP BY ALL),
predicted AS (SELECT doc_id, arg_min(guess, (-score, guess)) AS predicted FROM scores GROUP BY doc_id)"""


@register("language_model", f"""WITH {SQL_LANGUAGE}
SELECT p.doc_id, d.lang, d.held_out, p.predicted FROM predicted p JOIN (SELECT DISTINCT doc_id, lang, held_out FROM docs) d USING (doc_id)""")
def language_model(spark, sf_dir):
    """K3: language of every document by trigrams learnt from documents.lang on hash-chosen rows."""
    from sitelens.operators import langmodel as LM

    counts = language_counts(spark, sf_dir)
    model = LM.train_language_model(counts.where("NOT held_out"))
    return LM.detect_by_model(counts, model, keys=("doc_id", "lang", "held_out"))


@register("run_sketches", f"""WITH r AS ({Q.page_records_cte()}), {SQL_STORED}
SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(DISTINCT url) FROM r) AS urls, (SELECT count(DISTINCT term) FROM postings) AS terms,
  true AS urls_within, true AS terms_within""")
def run_sketches(spark, sf_dir):
    """Distinct URLs and terms over all runs from the runs' stored sketches, checked against exact counts."""
    from sitelens.operators import sketches as SK

    runs = FX.page_records(spark, sf_dir).select("crawler_type", "url")
    path = scratch(spark, "sketches")
    SK.run_sketches(runs, ["crawler_type"], {"urls": "url"}).write.parquet(f"{path}/urls")
    postings = stored_pages(spark, sf_dir).table("postings").where(SG._searched())
    SK.run_sketches(postings, ["bucket"], {"terms": "term"}).write.parquet(f"{path}/terms")
    urls = SK.merge_sketches(spark.read.parquet(f"{path}/urls"), ["urls"]).withColumnRenamed("urls", "near_urls")
    terms = SK.merge_sketches(spark.read.parquet(f"{path}/terms"), ["terms"]).select(F.col("terms").alias("near_terms"))
    exact = runs.agg(F.count_distinct("url").alias("urls")).crossJoin(postings.agg(F.count_distinct("term").alias("terms")))
    bound = SK.error_bound()
    one = urls.crossJoin(terms).crossJoin(exact)  # one row each
    return one.select("rows", "urls", "terms", *[
        (F.abs(F.col(f"near_{c}") - F.col(c)) <= F.ceil(F.lit(bound) * F.col(c))).alias(f"{c}_within") for c in ("urls", "terms")])


# --------------------------------------------------------------------------- longest-prefix join

from sitelens.plans.catalog import QUERIES, robots_parsed  # noqa: E402


@register("robots_by_prefix", QUERIES["robots_filter"][1])
def robots_by_prefix(spark, sf_dir):
    """robots verdict for every page URL by joining its path's prefixes with the rules."""
    from sitelens.operators import robots as RB

    return RB.robots_by_prefix(read_table(spark, sf_dir, "pages").select("page_id", "url"), robots_parsed(spark, sf_dir)[0])


# --------------------------------------------------------------------------- image headers

@register("image_sizes", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' END AS format,
  CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 700 AS BIGINT) ELSE -1 END AS px_width,
  CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 300 + 1 AS BIGINT) ELSE -1 END AS px_height,
  CASE WHEN page_id % 4 = 3 OR page_id % 700 = 0 THEN 'no image size found' END AS error,
  NOT coalesce(page_id % 4 < 3 AND (page_id % 700 < 100 OR page_id % 300 + 1 < 100), false) AS kept FROM pages""")
def image_sizes(spark, sf_dir):
    """Sides of stand-in images of the pages (headers of three formats, and no image) from their bytes; kept: not
    under 100 pixels on a side."""
    from sitelens.functions.images import image_size
    from sitelens.operators.images import min_image_size

    pages = read_table(spark, sf_dir, "pages").select("page_id")
    w, h = F.col("page_id") % 700, F.col("page_id") % 300 + 1
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    little = lambda x: F.concat(F.substring(big(x, 2), 3, 2), F.substring(big(x, 2), 1, 2))
    kind = F.col("page_id") % 4
    header = (F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)))
              .when(kind == 1, F.concat(F.lit("474946383961"), little(w), little(h)))
              .when(kind == 2, F.concat(F.lit("FFD8FFE000040000FFC0000B08"), big(h, 2), big(w, 2), F.lit("0100")))
              .otherwise(F.lit("3C68746D6C3E")))
    sized = pages.select("page_id", image_size(F.unhex(header)).alias("_i")).select(
        "page_id", F.col("_i.format").alias("format"), F.col("_i.width").alias("px_width"), F.col("_i.height").alias("px_height"),
        F.col("_i.error").alias("error"))
    kept = min_image_size(sized).select("page_id", F.lit(True).alias("kept"))
    out = sized.join(kept, "page_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.fillna(-1, ["px_width", "px_height"])


# --------------------------------------------------------------------------- held-out quality of the text classifiers

HELD_DIGITS = ("0", "1", "2", "3")


@register("classifier_auc", None)
def classifier_auc(spark, sf_dir):
    """K5-K7: classifiers learnt from labels of three quarters of the texts by hash, and the area under ROC over the others."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from sitelens.operators import textmodels as TM

    both = read_table(spark, sf_dir, "documents").select("doc_id", "text").join(read_table(spark, sf_dir, "labels"), "doc_id")
    out = None
    for kind, column in (("quality", "quality"), ("toxicity", "toxic")):
        rows = both.select("text", F.col(column).cast("double").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
        held = F.substring(F.md5("text"), 1, 1).isin(*HELD_DIGITS)
        model = TM.train_classifier(rows.where(~held), test_percent=0)
        asked = rows.where(held)
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(asked))  # one number
        part = asked.agg(F.count("*").alias("held_out"), F.sum("label").cast("long").alias("positive")).select(
            F.lit(kind).alias("kind"), "held_out", "positive", F.lit(round(auc, 4)).alias("auc"))
        out = part if out is None else out.unionByName(part)
    return out
