"""Stored index in hash buckets with a manifest.

A document belongs to the bucket of its URL's hash, and everything about it is in that bucket's files::

    <root>/<table>/v=<version>/bucket=<b>/part-*.parquet
    <root>/manifest/<version>.json

* ``documents``  whole index documents (every field that was given but the full text), sorted by doc_id;
* ``postings``   (term, block, doc_id, mask): the fields of a document that hold a word, sorted by term;
* ``blocks``     (term, block, mask, first_doc): the fields in which any document of a block holds the word, which
  bounds what the word can add to a score there;
* ``grams``      (gram, term): the trigrams of the bucket's words, sorted by trigram.

A merge reads and rewrites the buckets of the batch's URLs alone. A manifest names for each bucket the version that
holds its files; it is written last, under a name of its own and by a rename, so readers see a whole version or the one
before. Files that neither of the last two manifests names are removed then. Merges are numbered by their batch: one that
is repeated after a failure finds its number in the manifest and does nothing. One writer at a time.

Searches read the row groups that a query needs: trigrams by equality, then postings by the ranges of terms found.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.text import STOPWORDS, WORD, tokenize
from sitelens.operators.index import BOOSTED_MAX_RESULTS, BOOSTS, DEFAULT_LIMIT, indexable, query_tokens, small
from sitelens.plans.ids import dense_ids
from sitelens.session import cut_lineage

#: Fields whose words are in the postings: bit i of a mask is field i. The first three are the text of a contains-search.
FIELDS = ("title", "snippet", "content", "url", "description")
SEARCHED = 0b00111
TABLES = ("documents", "postings", "blocks", "grams")
#: Documents of a block, about (ids are dealt out to buckets by hash).
BLOCK_DOCS = 1024
#: Ranges of terms that a search pushes down to the postings' scan; blocks whose scores are computed first.
RANGES, FIRST_BLOCKS = 64, 16
#: Terms of a range from which the ranges cover about the whole alphabet and skip nothing; ids of a batch that are broadcast.
RANGE_TERMS, BATCH_IDS = 32, 1_000_000
KEPT_VERSIONS = 2

_POSTINGS = "term string, block long, doc_id long, mask int"
_SCHEMAS = {"postings": _POSTINGS, "blocks": "term string, block long, mask int, first_doc long", "grams": "gram string, term string"}
_MISSING = {"snippet": "", "type": "unknown", "date": ""}


# ------------------------------------------------------------------------------------------------ files

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _manifest_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifest/{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions whose manifest is there, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{root.rstrip('/')}/manifest") if n.endswith(".json")]


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The newest manifest (or that of a version): one small file of one entry for each bucket."""
    found = versions(spark, root)
    if not found:
        return None
    path = _manifest_path(root, found[-1] if version is None else version)
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    path = _manifest_path(root, manifest["version"])
    fs, target = _fs(spark, path)
    _, draft = _fs(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, target):
        raise OSError(f"manifest {path} is there already: another writer?")


def _clean(spark: SparkSession, root: str) -> None:
    """Remove what none of the last KEPT_VERSIONS manifests names."""
    numbers = versions(spark, root)
    kept = [read_manifest(spark, root, n) for n in numbers[-KEPT_VERSIONS:]]
    needed = {(int(b), v) for m in kept for b, v in m["buckets"].items()}
    for number in numbers[:-KEPT_VERSIONS]:
        fs, p = _fs(spark, _manifest_path(root, number))
        fs.delete(p, False)
    newest = kept[-1]["version"]
    for table in TABLES:
        base = f"{root.rstrip('/')}/{table}"
        for name in _names(spark, base):
            version = int(name.split("=")[1])
            if version >= newest:
                continue
            held = [n for n in _names(spark, f"{base}/{name}") if n.startswith("bucket=")]
            gone = [n for n in held if (int(n.split("=")[1]), version) not in needed]
            for n in [""] if len(gone) == len(held) else gone:
                fs, p = _fs(spark, f"{base}/{name}/{n}".rstrip("/"))
                fs.delete(p, True)


# ------------------------------------------------------------------------------------------------ reading

class Index:
    """One version of a stored index; its tables stay readable while later versions are written."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = read_manifest(spark, root, version)
        if self.manifest is None:
            raise FileNotFoundError(f"no index at {root}")

    def table(self, name: str, buckets=None) -> DataFrame:
        """A table's rows with their bucket; buckets: only these."""
        held = {int(b): v for b, v in self.manifest["buckets"].items()}
        chosen = sorted(held if buckets is None else set(buckets) & set(held))
        there = set(self.manifest["files"][name])
        schema = self._schema(name)
        whole = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.root}/{name}/v={held[b]}/bucket={b}" for b in chosen if b in there]
        if not paths:
            return self.spark.createDataFrame([], whole).drop("v")
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("v")

    def _schema(self, name: str) -> T.StructType:
        if name == "documents":
            return T.StructType.fromJson(self.manifest["documents"])
        return T.StructType.fromDDL(_SCHEMAS[name])

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").drop("bucket")

    @property
    def postings(self) -> DataFrame:
        """Unique (term, doc_id) of the searched text."""
        return self.table("postings").where(_searched()).select("term", "doc_id")


def _searched() -> Column:
    return (F.col("mask").bitwiseAND(SEARCHED) > 0) & ~F.col("term").isin(*STOPWORDS)


# ------------------------------------------------------------------------------------------------ building

def bucket_of(url, n: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n)).cast("int")


def field_words(docs: DataFrame) -> DataFrame:
    """(bucket, term, block, doc_id, mask): the lower-case words of three and more characters in each field."""
    def words(i: int, field: str) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(WORD), 0)
        long = F.filter(F.array_distinct(found), lambda w: F.length(w) >= 3)
        return F.transform(long, lambda w: F.struct(w.alias("term"), F.lit(1 << i).alias("mask")))

    given = [words(i, f) for i, f in enumerate(FIELDS) if f in docs.columns]
    each = docs.select("bucket", "block", "doc_id", F.inline(F.concat(*given)))
    return each.groupBy("bucket", "term", "block", "doc_id").agg(F.bit_or("mask").cast("int").alias("mask"))


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term", "block").agg(
        F.bit_or("mask").cast("int").alias("mask"), F.min("doc_id").alias("first_doc"))


def _grams(postings: DataFrame) -> DataFrame:
    terms = postings.select("bucket", "term").distinct()
    starts = F.sequence(F.lit(1), F.length("term") - 2)
    grams = F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("term"), p, F.lit(3))))
    return terms.select("bucket", F.explode(grams).alias("gram"), "term")


_ORDER = {"documents": ["doc_id"], "postings": ["term", "block", "doc_id"], "blocks": ["term", "block"], "grams": ["gram", "term"]}


def _write(rows: DataFrame, root: str, table: str, version: int) -> None:
    """Files of a bucket are runs of its sort order; a large bucket is several tasks."""
    order = ["bucket", *_ORDER[table]]
    path = f"{root.rstrip('/')}/{table}/v={version}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _incoming(new: DataFrame, n: int) -> DataFrame:
    """The newest row of each URL by (date, seq), then by its other fields."""
    rows = indexable(new)
    for name, value in _MISSING.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in rows.columns else F.lit(value))
    rest = [c for c in rows.columns if c not in ("url", "seq", "bucket", "block", "doc_id")]
    maps = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]  # have no order
    key = ["date", *(["seq"] if "seq" in rows.columns else []), *(c for c in rest if c != "date" and c not in maps)]
    # the key holds all of the row: it is carried once, and only maps, which no key can hold, go beside it
    best = F.max(F.struct(*key)) if not maps else F.max_by(F.struct(*key, *maps), F.struct(*key))
    newest = rows.groupBy("url").agg(best.alias("_r"))
    return newest.select("url", *[F.col("_r")[c].alias(c) for c in rest]).withColumn("bucket", bucket_of("url", n))


def _fields(order: list[str], given: list[str], known: list[str]) -> list[Column]:
    """The columns of a merged document: optional fields (scores, structured data) that a batch lacks or leaves null keep
    what the index has."""
    out = []
    for c in order:
        if c in ("doc_id", "url", "title", *_MISSING) or c not in known:
            out.append(F.col(c))
        else:
            out.append((F.coalesce(F.col(c), F.col(f"_old.{c}")) if c in given else F.col(f"_old.{c}")).alias(c))
    return out


def merge(spark: SparkSession, root: str, new: DataFrame, batch: int | None = None, buckets: int = 64) -> dict:
    """I4: put crawl rows (url, title; optional snippet, content, description, type, date, seq and any other field) into the
    index. Known URLs keep their doc_id and get the new fields, others get ids after the largest, in URL order. Returns the
    manifest. `buckets` counts for a new index alone; choose it so that a bucket is a few hundred MB."""
    now = read_manifest(spark, root)
    if now and batch is not None and now["batch"] is not None and batch <= now["batch"]:
        return now
    n = now["n"] if now else buckets
    version = now["version"] + 1 if now else 0
    incoming = cut_lineage(_incoming(new, n))
    touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # at most n numbers
    stored = [c for c in incoming.columns if c not in ("bucket", "content", "description")]
    if now:
        old = Index(spark, root)
        fields = T.StructType.fromJson(now["documents"]).fieldNames()
        here = old.table("documents", touched)
    else:
        fields, here = ["doc_id"], spark.createDataFrame([], "doc_id long, url string, bucket int")
    order = list(dict.fromkeys([*fields, "url", *stored]))
    known = here.select("url", "doc_id", F.struct(*[F.col(c) for c in fields]).alias("_old"))
    matched = incoming.join(known, "url", "left")
    fresh = dense_ids(matched.where(F.col("doc_id").isNull()).select("url"), "url", "rel")
    fresh = fresh.select("url", (F.lit(now["next_id"] if now else 0) + F.col("rel")).alias("_new"))
    texts = [c for c in ("content", "description") if c in incoming.columns]
    changed = matched.join(fresh, "url", "left").withColumn("doc_id", F.coalesce("doc_id", "_new")).select(
        *_fields(order, incoming.columns, fields), *texts, "bucket")
    changed = cut_lineage(changed.withColumn("block", F.floor(F.col("doc_id") / F.lit(BLOCK_DOCS * n)).cast("long")))
    ids = changed.select("doc_id")
    documents = changed.select(*order, "bucket")
    postings = field_words(changed)
    if now:
        replaced = small(ids, BATCH_IDS)
        documents = documents.unionByName(here.join(replaced, "doc_id", "left_anti"), allowMissingColumns=True)
        postings = postings.unionByName(old.table("postings", touched).join(replaced, "doc_id", "left_anti"))
    _write(documents, root, "documents", version)
    _write(postings, root, "postings", version)
    base = f"{root.rstrip('/')}/postings/v={version}"
    written = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(base)  # what is derived from them reads them back
    _write(_blocks(written), root, "blocks", version)
    _write(_grams(written), root, "grams", version)
    files = {}
    for table in TABLES:
        before = set(now["files"][table]) if now else set()
        names = _names(spark, f"{root.rstrip('/')}/{table}/v={version}")
        files[table] = sorted((before - set(touched)) | {int(x.split("=")[1]) for x in names if x.startswith("bucket=")})
    top = ids.agg(F.max("doc_id").alias("m")).first()["m"]  # null: an empty batch
    manifest = {
        "version": version, "batch": batch if batch is not None else (now["batch"] if now else None), "n": n,
        "next_id": max(now["next_id"] if now else 0, 0 if top is None else top + 1),
        "buckets": (now["buckets"] if now else {}) | {str(b): version for b in touched},
        "files": files, "documents": documents.drop("bucket").schema.jsonValue(),
    }
    _publish(spark, root, manifest)
    _clean(spark, root)
    return manifest


# ------------------------------------------------------------------------------------------------ searching

def _tokens(spark: SparkSession, query: str) -> dict[str, int]:
    """The tokens of one query string, each with how often it stands there."""
    found = spark.sql("SELECT 1").select(F.explode(tokenize(F.lit(query or ""))).alias("t")).collect()
    weights: dict[str, int] = {}
    for r in found:
        weights[r["t"]] = weights.get(r["t"], 0) + 1
    return weights


def _any(conditions: list[Column]) -> Column:
    """OR of many conditions as a balanced tree."""
    while len(conditions) > 1:
        conditions = [conditions[i] | conditions[i + 1] if i + 1 < len(conditions) else conditions[i] for i in range(0, len(conditions), 2)]
    return conditions[0] if conditions else F.lit(False)


def matched_terms(index: Index, tokens) -> DataFrame:
    """(term, token): every index term with each token that it contains, by the token's rarest trigram."""
    grams = index.table("grams")
    of = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in tokens}
    wanted = sorted({g for gs in of.values() for g in gs})
    asked = _any([F.col("gram") == g for g in wanted])
    sizes = {r["gram"]: r["count"] for r in grams.where(asked).groupBy("gram").count().collect()}  # one row a trigram
    hits = []
    for t, gs in of.items():
        if all(g in sizes for g in gs):  # else no term holds it
            hits.append((F.col("gram") == min(gs, key=lambda g: (sizes[g], g))) & F.contains(F.col("term"), F.lit(t)))
    token = F.array(*[F.when(h, F.lit(t)) for h, t in zip(hits, [t for t, gs in of.items() if all(g in sizes for g in gs)])])
    if not hits:
        return index.spark.createDataFrame([], "term string, token string")
    rows = grams.where(_any(hits)).select("term", F.explode(F.filter(token, lambda t: t.isNotNull())).alias("token"))
    return cut_lineage(rows.distinct())


def term_ranges(matched: DataFrame, n: int = RANGES) -> Column:
    """A condition on the column term that at most n ranges make, and that holds for every matched term. Of many terms it is
    true alone: their ranges would be compared with each row and leave none out."""
    terms = matched.select("term").distinct()
    if terms.limit(n * RANGE_TERMS + 1).count() > n * RANGE_TERMS:
        return F.lit(True)
    parted = terms.repartitionByRange(n, "term")
    ends = parted.groupBy(F.spark_partition_id()).agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()  # <= n rows
    return _any([F.col("term") == r["a"] if r["a"] == r["b"] else F.col("term").between(r["a"], r["b"]) for r in ends])


def _named(index: Index, top: DataFrame, cols: list[str]) -> DataFrame:
    """The index documents of at most `limit` ranked rows, whole, each once and by their id."""
    rows = top.collect()  # at most the limit
    if not rows:
        return top.join(index.documents, "doc_id").select(*cols, "doc_id", *[c for c in index.documents.columns if c != "doc_id"])
    ranked = index.spark.createDataFrame(rows, top.schema)
    found = index.documents.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    return ranked.join(found, "doc_id").select(*cols, "doc_id", *[c for c in found.columns if c != "doc_id"])


def search(index: Index, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """I5 on a stored index: rank, score and the whole documents (url, title, snippet, type, date and other fields)."""
    weights = _tokens(index.spark, query)
    matched = matched_terms(index, weights)
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0))
    by_term = matched.groupBy("term").agg(F.sum(w[F.col("token")]).alias("w"))
    near = index.table("postings").where(term_ranges(matched)).where(_searched())
    scored = near.join(small(by_term), "term").groupBy("doc_id").agg(F.sum("w").cast("long").alias("score"))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(limit)
    number = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # of at most `limit` rows
    return _named(index, top.select(number.cast("long").alias("rank"), "doc_id", "score"), ["rank", "score"])


def _boost(masks: Column) -> Column:
    """What a token adds: the boosts of the fields whose bits are set."""
    return sum((F.when(masks.bitwiseAND(1 << FIELDS.index(f)) > 0, F.lit(b)).otherwise(F.lit(0.0)) for f, b in BOOSTS.items()), F.lit(0.0))


def _boosted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scores by keys: a token counts once in each field, however many of the field's words contain it."""
    each = rows.groupBy(*keys, "token").agg(F.bit_or("mask").alias("mask"))
    return each.groupBy(*keys).agg(F.round(F.sum(_boost(F.col("mask"))), 2).alias("score")).where("score > 0")


def block_bounds(index: Index, matched: DataFrame, ranges: Column) -> DataFrame:
    """(bucket, block, bound, first_doc): the most that a document of the block can score, and its smallest id."""
    rows = index.table("blocks").where(ranges).join(matched, "term")
    first = rows.groupBy("bucket", "block").agg(F.min("first_doc").alias("first_doc"))
    bounds = _boosted(rows, ["bucket", "block"]).withColumnRenamed("score", "bound")
    return bounds.join(first, ["bucket", "block"])


def search_boosted(index: Index, query: str, limit: int = BOOSTED_MAX_RESULTS) -> DataFrame:
    """I6 on a stored index: rank, score and the whole documents, best boosted scores first, equal ones by doc_id.

    The blocks with the highest bounds are scored first; then only those others whose bound can still enter the top."""
    matched = matched_terms(index, _tokens(index.spark, query))
    ranges = term_ranges(matched)
    matched = small(matched)
    bounds = cut_lineage(block_bounds(index, matched, ranges))
    hits = index.table("postings").where(ranges).join(matched, "term")
    first = bounds.orderBy(F.desc("bound"), "first_doc", "bucket").limit(FIRST_BLOCKS)

    def best(blocks: DataFrame) -> DataFrame:
        return _boosted(hits.join(blocks.select("bucket", "block"), ["bucket", "block"]), ["doc_id"])

    order = [F.desc("score"), F.asc("doc_id")]
    top = cut_lineage(best(first).orderBy(*order).limit(limit))
    last = top.orderBy(F.asc("score"), F.desc("doc_id")).limit(1).collect()
    rest = bounds.join(first.select("bucket", "block"), ["bucket", "block"], "left_anti")
    if top.count() == limit:
        score, doc = last[0]["score"], last[0]["doc_id"]
        rest = rest.where((F.col("bound") > score) | ((F.col("bound") == score) & (F.col("first_doc") < doc)))
    both = top.unionByName(best(rest)).orderBy(*order).limit(limit)
    number = F.row_number().over(Window.orderBy(*order))  # of at most `limit` rows
    return _named(index, both.select(number.cast("long").alias("rank"), "doc_id", "score"), ["rank", "score"])


def search_batch(index: Index, queries: DataFrame, limit: int = DEFAULT_LIMIT, text_col: str = "query",
                 id_col: str = "query_id") -> DataFrame:
    """I10 on a stored index: (query_id, rank, doc_id, score). Neither documents nor words are derived again: each token
    meets the stored trigrams of its rarest one."""
    asked = cut_lineage(query_tokens(queries, text_col, id_col))
    grams = index.table("grams")
    starts = F.sequence(F.lit(1), F.length("token") - 2)
    of = asked.select("token").distinct().select(
        "token", F.explode(F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("token"), p, F.lit(3))))).alias("gram"))
    freq = grams.groupBy("gram").agg(F.count("*").alias("f"))
    rarest = of.join(freq, "gram", "left").groupBy("token").agg(
        F.min_by("gram", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram")).alias("gram"))
    terms = grams.join(rarest, "gram").where(F.contains("term", "token")).select("term", "token").distinct()
    weighted = asked.join(terms, "token").groupBy(id_col, "term").agg(F.sum("weight").alias("w"))
    scored = weighted.join(index.postings, "term").groupBy(id_col, "doc_id").agg(F.sum("w").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select(id_col, "rank", "doc_id", "score")
