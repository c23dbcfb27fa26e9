"""Inverted index: documents, postings, vocabulary, search.

Layout (all plain DataFrames, written as Parquet by :mod:`sitelens.sources`):

* ``documents(doc_id, url, title, snippet, type, date)``
* ``postings(term, doc_id)`` - unique pairs, built narrow (no shuffle) from
  ``explode(array_distinct(tokens))`` per document;
* ``vocabulary(term, doc_freq)`` - one row per term.

Search semantics: every query token (repeats count again) adds 1 for each index
term that *contains* it, to every document holding that term. The substring
match is a trigram-index equi-join (vocabulary trigrams x each token's rarest
trigram, then an exact positional check), so it stays shuffle/broadcast-able
and never becomes a nested loop over vocabulary x tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import tokenize
from sitelens.plans.ids import dense_ids
from sitelens.session import cut_lineage, ensure_checkpoint_dir

DEFAULT_LIMIT = 10
#: Rows up to which a counted table is broadcast in a join.
SMALL_ROWS = 200_000
#: Terms and tokens in them that are broadcast of the most used terms, and the longest term among them.
OFTEN_CELLS, OFTEN_LENGTH = 500_000, 64


def _text_cols(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("snippet"), F.lit(""))]
    if "content" in df.columns:
        parts.append(F.coalesce(F.col("content"), F.lit("")))
    return F.concat_ws(" ", *parts)


def indexable(df: DataFrame) -> DataFrame:
    """Rows that carry both a url and a title."""
    return df.where(F.col("url").isNotNull() & F.col("title").isNotNull())


def build_documents(df: DataFrame, order_by: str | list[str] = "url", id_col: str | None = None) -> DataFrame:
    """Document table with ids. ``id_col`` reuses an existing unique id;
    otherwise dense ids 0..n-1 follow ``order_by`` (distributed assignment)."""
    src = indexable(df)
    if "snippet" not in src.columns:
        src = src.withColumn("snippet", F.lit(""))
    for c, default in (("type", "unknown"), ("date", "")):
        src = src.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c in src.columns else F.lit(default))
    if id_col is not None:
        src = src.withColumn("doc_id", F.col(id_col).cast("long"))
    else:
        src = dense_ids(src, order_by, "doc_id")
    keep = ["doc_id", "url", "title", "snippet", "type", "date"]
    extra = [c for c in ("content",) if c in src.columns]
    return src.select(*keep, *extra)


def document_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens) with the indexable text = title, snippet, content."""
    return docs.select("doc_id", tokenize(_text_cols(docs)).alias("tokens"))


def build_postings(docs: DataFrame) -> DataFrame:
    """Unique (term, doc_id) pairs; narrow, no shuffle."""
    return document_tokens(docs).select(
        F.explode(F.array_distinct("tokens")).alias("term"), "doc_id"
    )


def vocabulary(postings: DataFrame) -> DataFrame:
    """One row per term with its document frequency (partial aggregation map-side)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def index_stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents, distinct terms, postings."""
    both = docs.select(F.lit(1).alias("is_doc"), F.lit(None).cast("string").alias("term")).unionByName(
        postings.select(F.lit(0).alias("is_doc"), "term"))
    return both.agg(
        F.sum("is_doc").cast("long").alias("documents"),
        F.count_distinct("term").alias("terms"),
        F.count("term").alias("postings"),
    )


def query_tokens(queries: DataFrame, text_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """(query_id, token, weight): weight = how often the token repeats in the query."""
    return (
        queries.select(id_col, F.explode(tokenize(F.col(text_col))).alias("token"))
        .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("weight"))
    )


def _substring_matches(vocab_terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (term, token) with token a substring of term, as equi-joins.

    Trigram index: every vocabulary term is exploded into its trigrams (with
    positions); each query token (all are >= 3 characters) picks its rarest
    trigram; candidates are the term positions holding that trigram, and a
    positional substring comparison makes the result exact. The work grows
    with the vocabulary (about length-2 rows per term) plus the candidates of
    the rarest trigrams, never with vocabulary x tokens.
    """
    tokens = tokens.distinct()
    tri = vocab_terms.select(
        "term", F.explode(F.sequence(F.lit(1), F.greatest(F.length("term") - 2, F.lit(1)))).alias("p")
    ).select("term", "p", F.substring(F.col("term"), F.col("p"), 3).alias("g"))
    freq = tri.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    tok_tri = tokens.select(
        "token", F.explode(F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1)))).alias("off")
    ).select("token", "off", F.substring(F.col("token"), F.col("off"), 3).alias("g"))
    # a trigram absent from the vocabulary has frequency 0: that token matches nothing
    rarest = (tok_tri.join(freq, "g", "left").withColumn("f", F.coalesce("f", F.lit(0)))
              .groupBy("token").agg(F.min_by(F.struct("g", "off"), F.struct("f", "off")).alias("r"))
              .select("token", F.col("r.g").alias("g"), F.col("r.off").alias("off")))
    start = F.col("p") - F.col("off") + 1
    cand = tri.join(small(rarest), "g").where(
        (start >= 1) & (F.substring(F.col("term"), start, F.length("token")) == F.col("token")))
    return cand.select("term", "token").distinct()


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table, to be broadcast if its rows, counted, are few."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder as Parquet and read back: what is read several times is computed once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def often_used(by_term: DataFrame, cells: int = OFTEN_CELLS) -> Column:
    """Whether a term is so often used that it is broadcast: the least doc_freq, as a power of two, that terms with at most
    `cells` tokens in all reach."""
    sizes = by_term.where(F.length("term") <= OFTEN_LENGTH).groupBy(F.floor(F.log2("doc_freq")).alias("p")).agg(
        F.sum(F.size("tokens") + 1).alias("n")).collect()  # at most 63 rows
    least, n = 63, 0
    for r in sorted(sizes, key=lambda r: -r["p"]):
        n += r["n"]
        if n > cells:
            break
        least = r["p"]
    return (F.length("term") <= OFTEN_LENGTH) & (F.floor(F.log2("doc_freq")) >= least)


def scores_by_tokens(postings: DataFrame, asked: DataFrame, matches: DataFrame, uses: DataFrame, id_col: str,
                     cells: int = OFTEN_CELLS) -> DataFrame:
    """(query, doc_id, score) from the tokens of queries, the terms that contain them and the terms' doc_freq.

    A posting meets the tokens of its term, not the queries: what a document holds is counted once by token, where its
    rows come together, and only then weighed for each query that has the token. The most used terms are broadcast, so
    that a shuffle by term is left for the others' postings alone."""
    number = cut_lineage(asked.select("token").distinct().withColumn("t", F.monotonically_increasing_id()))
    by_term = matches.join(small(number), "token").groupBy("term").agg(F.collect_list("t").alias("tokens"))
    by_term = cut_lineage(by_term.join(uses, "term"))
    often = often_used(by_term, cells)
    hot = F.broadcast(by_term.where(often).select("term", "tokens"))
    near = postings.join(hot, "term").select("doc_id", "tokens")
    rest = by_term.where(~often).select("term", "tokens")
    if not rest.isEmpty():
        far = postings.join(hot.select("term"), "term", "left_anti").join(rest, "term")
        near = near.unionByName(far.select("doc_id", "tokens"))
    held = near.repartition("doc_id").select("doc_id", F.explode("tokens").alias("t"))
    held = held.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("terms"))
    each = held.join(small(asked.join(number, "token").select(id_col, "t", "weight")), "t")
    return each.groupBy("doc_id", id_col).agg(F.sum(F.col("weight") * F.col("terms")).cast("long").alias("score"))


def search_batch(postings: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT,
                 text_col: str = "query", id_col: str = "query_id",
                 vocab: DataFrame | None = None) -> DataFrame:
    """Many queries in one job -> (query_id, rank, doc_id, score).

    The postings are computed once and kept as files of the checkpoint folder.
    Ranking per query: score desc, doc_id asc, top ``limit``. The
    ``row_number() <= limit`` filter is planned with a partial per-partition
    group limit before the shuffle, so a query matching every document never
    sends all of them to one task.
    """
    qt = cut_lineage(query_tokens(queries, text_col, id_col))
    postings = kept(postings.select("term", "doc_id"))
    uses = cut_lineage(vocabulary(postings))
    matches = _substring_matches((vocab if vocab is not None else uses).select("term"), qt.select("token"))  # (term, token)
    scored = scores_by_tokens(postings, qt, matches, uses, id_col)
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .select(id_col, F.col("rank").cast("long").alias("rank"), "doc_id", "score")
    )


def search(docs: DataFrame, postings: DataFrame, query: str, limit: int = DEFAULT_LIMIT,
           vocab: DataFrame | None = None) -> DataFrame:
    """One query -> top ``limit`` documents (rank, doc_id, url, title, score).
    Empty or stopword-only queries give no rows.

    A single query has a handful of tokens (a parameter, tokenised once by the
    same column function as the index), so the contains-match becomes one
    codegen'd expression over the postings stream: each posting scores
    sum(weight of every token its term contains), then a per-document sum
    with map-side partial aggregation and a top-k. One pass over the
    postings, no vocabulary or join (``vocab`` is not needed here and is
    accepted only so callers can pass the same arguments as to search_batch).
    """
    spark = postings.sparkSession
    toks = [r.token for r in spark.createDataFrame([(query or "",)], "q string")
            .select(F.explode(tokenize(F.col("q"))).alias("token")).collect()]  # tokens of one query string
    if not toks:
        return spark.createDataFrame([], "rank long, doc_id long, url string, title string, score long")
    weights: dict[str, int] = {}
    for t in toks:
        weights[t] = weights.get(t, 0) + 1
    hit = sum((F.when(F.instr(F.col("term"), t) > 0, F.lit(w)).otherwise(F.lit(0)) for t, w in weights.items()),
              F.lit(0))
    scored = (postings.select("doc_id", hit.alias("w")).where(F.col("w") > 0)
              .groupBy("doc_id").agg(F.sum("w").cast("long").alias("score")))
    top = scored.orderBy(F.col("score").desc(), F.col("doc_id").asc()).limit(limit)
    w = Window.orderBy(F.col("score").desc(), F.col("doc_id").asc())  # numbers at most `limit` rows
    ranked = top.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.join(docs.select("doc_id", "url", "title"), "doc_id").select("rank", "doc_id", "url", "title", "score")


# Field boosts of the boosted search (title, url, description, content).
BOOSTS = {"title": 3.0, "url": 2.0, "description": 1.5, "content": 1.0}
BOOSTED_MAX_RESULTS = 100


def search_boosted(df: DataFrame, query: str, limit: int = BOOSTED_MAX_RESULTS,
                   id_col: str = "doc_id") -> DataFrame:
    """Per field, count query tokens contained (case-insensitive) in the
    field, multiply by the field boost, sum; keep score > 0; top ``limit``."""
    spark = df.sparkSession
    toks = [r[0] for r in spark.createDataFrame([(query or "",)], "q string")
            .select(F.explode(tokenize(F.col("q")))).collect()]  # tokens of one query string
    score = F.lit(0.0)
    for field, boost in BOOSTS.items():
        if field not in df.columns or not toks:
            continue
        low = F.lower(F.coalesce(F.col(field), F.lit("")))
        hits = sum((F.when(F.instr(low, t) > 0, 1).otherwise(0) for t in toks), F.lit(0))
        score = score + hits * F.lit(boost)
    out = df.select(id_col, F.round(score, 2).alias("score")).where(F.col("score") > 0)
    return out.orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(limit)


def upsert_documents(docs: DataFrame, postings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4: merge new crawl rows into the index by url.

    Existing urls keep their doc_id and get the new title/snippet/type/date;
    new urls get ids after the current maximum (dense, ordered by url). Old
    postings of updated documents are replaced by the new ones.
    """
    incoming = indexable(new)
    if "snippet" not in incoming.columns:
        incoming = incoming.withColumn("snippet", F.lit(""))
    incoming = (
        incoming.withColumn("type", F.coalesce(F.col("type"), F.lit("unknown")) if "type" in incoming.columns else F.lit("unknown"))
        .withColumn("date", F.coalesce(F.col("date"), F.lit("")) if "date" in incoming.columns else F.lit(""))
    )
    cols = ["url", "title", "snippet", "type", "date"] + (["content"] if "content" in incoming.columns else [])
    # one row per url inside a batch: the latest by (date, seq); among equals the
    # greatest row (a deterministic choice, so every consumer of the batch
    # - documents and postings - sees the same row even after a recompute)
    rest = [c for c in cols if c != "url"]
    recency = ["date"] + (["seq"] if "seq" in incoming.columns else [])
    key = F.struct(*[F.col(c) for c in recency + [c for c in rest if c != "date"]])
    incoming = (incoming.groupBy("url").agg(F.max_by(F.struct(*[F.col(c) for c in rest]), key).alias("_r"))
                .select("url", *[F.col(f"_r.{c}").alias(c) for c in rest]))
    matched = incoming.join(docs.select("url", "doc_id"), "url", "left")
    max_id = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).first()["m"]  # one scalar
    fresh = dense_ids(matched.where(F.col("doc_id").isNull()).drop("doc_id"), "url", "rel")
    fresh = fresh.select(*cols, (F.lit(int(max_id)) + 1 + F.col("rel")).alias("doc_id"))
    updated = matched.where(F.col("doc_id").isNotNull()).select("doc_id", *cols)
    changed = updated.unionByName(fresh.select("doc_id", *cols))
    keep_docs = docs.join(changed.select("doc_id"), "doc_id", "left_anti")
    doc_cols = ["doc_id", "url", "title", "snippet", "type", "date"]
    new_docs = keep_docs.select(*doc_cols).unionByName(changed.select(*doc_cols))
    new_post = postings.join(changed.select("doc_id"), "doc_id", "left_anti").select("term", "doc_id").unionByName(
        build_postings(changed).select("term", "doc_id"))
    return new_docs, new_post

