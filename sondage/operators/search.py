"""BM25, vector search, rank fusion, re-ranking, context packing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.functions import vectors as V
from sondage.operators import ivf

K1, B = 1.2, 0.75
RRF_K = 60
SHORTLIST = 4
RERANK_TOP = 20
PLAIN_COSINE = 0.85
POSTING_BUCKETS = 32


def fetch_depth(limit: int) -> int:
    return min(200, max(50, 3 * limit))


def query_phrases(query: str) -> list[str]:
    return list(dict.fromkeys(p for t in query.split() if (p := T.phrase(t))))


def bm25(chunks: DataFrame, query: str, limit: int, prefix: str | None = None, like_compat: bool = False) -> DataFrame:
    """uuid, bm25_rank, bm25: all phrases required; corpus statistics are global, the prefix is applied before the limit.

    One pass over the text computes counts; the statistics are one row. ``bm25_indexed`` reads stored postings instead.
    """
    phrases = query_phrases(query)
    words = chunks.select("uuid", "path", T.word_string(F.col("content")).alias("w"))
    counts = words.select("uuid", "path", (F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit("")))).alias("spaces"), *[T.occurrences(F.col("w"), p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    counts = counts.withColumn("len", (F.col("spaces") / 2 - 1).cast("int"))
    if not phrases:
        return counts.where("false").select("uuid", F.lit(0).alias("bm25_rank"), F.lit(0.0).alias("bm25"))
    stats = counts.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(phrases))])
    keep: Column = F.lit(True)
    for i in range(len(phrases)):
        keep = keep & (F.col(f"tf{i}") > 0)
    hits = counts.where(keep)
    if prefix:
        hits = hits.where(T.path_prefix(F.col("path"), prefix, like_compat))
    top = hits.crossJoin(F.broadcast(stats)).select("uuid", F.round(_score(len(phrases)), 9).alias("bm25")).orderBy(F.desc("bm25"), "uuid").limit(limit)
    return ranked(top, "bm25_rank", "bm25").select("uuid", "bm25_rank", "bm25")


def ranked(top: DataFrame, name: str, by: str) -> DataFrame:
    """Ranks 1..n of at most a few hundred rows."""
    return top.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(by), "uuid")))


def postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, uuid, tf) and (uuid, len). Texts are dealt by uuid once and counted row by row, so that no postings are shuffled;
    only rows that share a uuid are added up."""
    shared = F.count("*").over(Window.partitionBy("uuid")) > 1
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, else small shuffles of costly texts are merged
    dealt = chunks.select("uuid", "content").repartition(parts, "uuid").withColumn("shared", shared)
    several = _counted(dealt.where("shared")).groupBy("term", "uuid").agg(F.sum("tf").cast("int").alias("tf"))
    return _counted(dealt.where("NOT shared")).unionByName(several), chunks.select("uuid", F.size(_terms()).alias("len"))


def _terms() -> Column:
    """The words of ``word_string``, in one pass."""
    return F.array_remove(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), "")


def _counted(chunks: DataFrame) -> DataFrame:
    """(term, uuid, tf) of each row: runs of equal words in its sorted words."""
    words = chunks.select("uuid", F.sort_array(_terms()).alias("t"))
    first = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i)), lambda i: i.isNotNull())
    runs = words.withColumn("first", first)
    each = F.transform("first", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("t")) - i).alias("tf")))
    return runs.select("uuid", F.explode(each).alias("x")).select("x.term", "uuid", "x.tf")


def positions(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, uuid, path, tf, at: places of the term) and (uuid, path, len): an index for phrase queries."""
    keep = [c for c in ("uuid", "path", "batch") if c in chunks.columns]
    tokens = chunks.select(*keep, F.filter(F.split(T.word_string(F.col("content")), " +"), lambda x: x != "").alias("t"))
    each = tokens.select(*keep, F.posexplode("t").alias("at", "term"))
    index = each.groupBy("term", *keep).agg(F.sort_array(F.collect_list("at")).alias("at")).withColumn("tf", F.size("at"))
    return index, tokens.select(*keep, F.size("t").alias("len"))


def bucket_of(term: Column) -> Column:
    """Folder of a term's postings in a stored index."""
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def _occurrences(words: list[str]) -> Column:
    """Places of a phrase from the map of its words' places; a word's own count where it is one word."""
    follows = lambda word, i: lambda x: F.array_contains(F.col("found")[word], x + i)
    first = F.col("found")[words[0]]
    for i, word in enumerate(words[1:], 1):
        first = F.filter(first, follows(word, i))
    return F.greatest(F.coalesce(F.size(first), F.lit(0)), F.lit(0))


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str, limit: int, prefix: str | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """``bm25`` from postings with places: only the query's terms are read (of a stored index, only their folders).

    ``totals``: rows and words of the corpus where they are known; else one pass over ``lengths``. Overlapping
    occurrences of a phrase that repeats its own word count each.
    """
    phrases = [p.split() for p in query_phrases(query)]
    if not phrases:
        return lengths.where("false").select("uuid", F.lit(0).alias("bm25_rank"), F.lit(0.0).alias("bm25"))
    terms = sorted({w for p in phrases for w in p})
    if "bucket" in index.columns:
        spark = index.sparkSession
        own = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term")).alias("b")).distinct().collect()
        index = index.where(F.col("bucket").isin([r["b"] for r in own]))
    hits = index.where(F.col("term").isin(terms)).groupBy("uuid").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("found"))
    counts = hits.select("uuid", *[_occurrences(p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    known = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    if totals:
        stats = known.withColumns({"N": F.lit(totals[0]), "avgdl": F.lit(totals[1] / max(1, totals[0]))})
    else:
        stats = known.crossJoin(lengths.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl")))
    keep: Column = F.lit(True)
    for i in range(len(phrases)):
        keep = keep & (F.col(f"tf{i}") > 0)
    rows = counts.where(keep).join(lengths, "uuid")
    if prefix:
        rows = rows.where(T.path_prefix(F.col("path"), prefix))
    top = rows.crossJoin(F.broadcast(stats)).select("uuid", F.round(_score(len(phrases)), 9).alias("bm25")).orderBy(F.desc("bm25"), "uuid").limit(limit)
    return ranked(top, "bm25_rank", "bm25").select("uuid", "bm25_rank", "bm25")


def _score(phrases: int) -> Column:
    score: Column = F.lit(0.0)
    for i in range(phrases):
        tf, n = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("N") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return score


def update_postings(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without the changed uuids, plus their new ones. The changed uuids are hashed, so postings dealt by uuid are neither
    shuffled nor sorted for them."""
    return index.join(changed.select("uuid").distinct().hint("shuffle_hash"), "uuid", "left_anti").select(index.columns).unionByName(fresh)


def search_postings(index: DataFrame, lengths: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Batch of single-term queries (query_id, term): top ``limit`` of each, ranks per query."""
    stats = lengths.agg(F.count("*").alias("total"), F.avg("len").alias("avgdl"))
    hits = terms.join(index, "term")
    df = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    tf = F.col("tf")
    score = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.join(df, "query_id").join(lengths, "uuid").crossJoin(F.broadcast(stats)).select("query_id", "uuid", F.round(score, 9).alias("bm25"))
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "uuid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def vector_topk(vectors: DataFrame, query: list[float], limit: int, prefix: str | None = None) -> DataFrame:
    """Exact search: uuid, vector_rank, cosine_score."""
    if limit <= 0:
        vectors, limit = vectors.where("false"), 1
    if prefix:
        vectors = vectors.where(T.path_prefix(F.col("path"), prefix))
    size = F.col("norm") if "norm" in vectors.columns else None
    scored = vectors.select("uuid", V.rounded(V.cosine(V.literal(query), F.col("embedding"), size), 6).alias("cosine_score"))
    return ranked(scored.orderBy(F.desc("cosine_score"), "uuid").limit(limit), "vector_rank", "cosine_score")


def hamming_shortlist(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The ``4 * limit`` nearest by sign bits; all rows if there are no more, or if the first and last of them tie."""
    dim, k = len(query), SHORTLIST * limit
    own = V.signature(V.literal(query), dim)
    stored = F.col("signature") if "signature" in vectors.columns else V.signature(F.col("embedding"), dim)
    far = vectors.withColumn("distance", V.hamming(stored, own))
    short = far.orderBy("distance", "uuid").limit(k)
    state = short.agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).first()
    return far if state["n"] < k or state["low"] == state["high"] else short


def full_scan(vectors: DataFrame, query: list[float], limit: int, prefix: str | None = None) -> DataFrame:
    """All rows under the prefix, cut to a shortlist by sign bits, ranked exactly."""
    if prefix:
        vectors = vectors.where(T.path_prefix(F.col("path"), prefix))
    return vector_topk(hamming_shortlist(vectors, query, limit) if limit > 0 else vectors, query, limit)


def route(vectors: DataFrame, query: list[float], limit: int, prefix: str | None = None, index: ivf.VectorIndex | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Vector search: nothing for no limit; the probed buckets of a ready index (and the rows ``missing`` in it) where no prefix
    is given; else all rows, exactly. Rows of the index count only if ``vectors`` still has them."""
    if limit > 0 and not prefix and index is not None and index.ready:
        near = index.read(vectors.sparkSession, query)
        if near is not None:
            keys = [c for c in ("document_path", "batch") if c in near.columns and c in vectors.columns] or ["uuid"]
            rows = near.join(vectors.select(*keys).distinct(), keys, "left_semi").select("uuid", "embedding")
            if missing is not None:
                rows = rows.unionByName(missing.select("uuid", "embedding"))
            found = vector_topk(rows, query, limit)
            if found.limit(1).count():
                return found
    return vector_topk(vectors, query, limit, prefix)


def rrf(bm25_leg: DataFrame, vector_leg: DataFrame, limit: int) -> DataFrame:
    """Full outer join of the legs on uuid; absent ranks are 0; ties by uuid."""
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    both = bm25_leg.select("uuid", "bm25_rank").join(vector_leg.select("uuid", "vector_rank", "cosine_score"), "uuid", "full")
    fused = both.select(
        "uuid", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"),
        F.coalesce("cosine_score", F.lit(0.0)).alias("cosine_score"), F.round(part("bm25_rank") + part("vector_rank"), 9).alias("rrf_score"),
    )
    return fused.orderBy(F.desc("rrf_score"), "uuid").limit(limit)


@dataclass(frozen=True)
class SearchOptions:
    prefix: str | None = None
    rerank: Callable[[DataFrame], DataFrame | None] | None = None  # adds score 0..100 to (uuid, position, content)
    expanded: list[float] | None = None  # vector of a hypothetical passage, averaged with the query's


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int, options: SearchOptions = SearchOptions(), legs: tuple[Callable[[int], DataFrame], Callable[[list[float], int], DataFrame]] | None = None) -> DataFrame:
    """BM25 and vector legs fused by reciprocal rank; content is fetched for the survivors only. ``legs``: how a store answers
    them from its indexes, by depth; else both are scans."""
    depth = fetch_depth(limit)
    if options.expanded:
        vector = [(a + b) / 2 for a, b in zip(vector, options.expanded)]
    if legs:
        both = legs[0](depth), legs[1](vector, depth)
    else:
        both = bm25(chunks, query, depth, options.prefix), vector_topk(vectors, vector, depth, options.prefix)
    top = rrf(*both, limit)
    hits = chunks.join(F.broadcast(top), "uuid").select("uuid", "path", "content", "bm25_rank", "vector_rank", "cosine_score", "rrf_score")
    if options.rerank is None or limit <= 0:
        return hits
    return blend(hits, options.rerank)


def blend_score(position: Column, score: Column) -> Column:
    """``position`` from 0: the first stage's weight falls from 0.7 to 0.3."""
    w = F.greatest(F.lit(0.3), 0.7 - 0.05 * position)
    return w * (1 / (1 + position)) + (1 - w) * F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)) / 100


def plain_first(bm25_rank, cosine_score):
    """A first hit (numbers or columns) that both legs are sure of, so no model needs to look at it."""
    return (bm25_rank == 1) & (cosine_score >= PLAIN_COSINE)


def blend(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Top 20 re-ordered by blended score, the tail keeps its order; skipped if the first hit is plain or the scorer has no score."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rrf_score"), "uuid")
    placed = hits.withColumn("position", F.row_number().over(w) - 1)
    first = placed.where("position = 0").select("bm25_rank", "cosine_score").first()
    if first and plain_first(first["bm25_rank"], first["cosine_score"]):
        return hits
    head = scorer(placed.where(F.col("position") < RERANK_TOP))
    if head is None:
        return hits
    head = head.withColumn("order", -F.round(blend_score(F.col("position"), F.col("score")), 9)).drop("score")
    tail = placed.where(F.col("position") >= RERANK_TOP).withColumn("order", F.col("position").cast("double"))
    return head.unionByName(tail).orderBy("order", "position").drop("order", "position")


def score_array(answer: Column) -> Column:
    """The first [..] of integers in a model's answer, clamped to 0..100."""
    return F.transform(F.from_json(F.regexp_extract(answer, r"(\[[^\[\]]*\])", 1), "array<int>"), lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)))


def trim_passage(text: Column, most: int = 512) -> Column:
    """At most ``most`` code points, cut at the last space."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(cut == "", head).otherwise(cut))


def pack_context(hits: DataFrame, max_chars: int) -> DataFrame:
    """Hits (uuid, rank, content) in rank order up to the first that overflows the budget of code points."""
    w = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length("content")).over(w)).where(F.col("used") <= max_chars)


# Metrics over results (query, doc, rank) and judgments (query, doc[, grade]).


def metrics(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Per query: hit rates at 1, 3, 5, 10, reciprocal rank, NDCG at k (ranks 1 and 2 undiscounted)."""
    rel = results.join(judgments.withColumn("rel", F.lit(1)), ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    if "grade" not in judgments.columns:
        rel = rel.withColumn("grade", F.col("rel"))
    discount = F.when(F.col("rank") <= 2, 1.0).otherwise(1 / F.log2(F.col("rank") - 1))
    hit = lambda n: F.max(F.when((F.col("rank") <= n) & (F.col("rel") == 1), 1.0).otherwise(0.0)).alias(f"hr{n}")
    gain = F.pow(2.0, F.coalesce("grade", F.lit(0))) - 1
    own = rel.groupBy("query").agg(
        *[hit(n) for n in (1, 3, 5, 10)], F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rank") <= k, gain * discount).otherwise(0.0)).alias("dcg"), F.count("*").alias("n"),
    )
    grades = judgments if "grade" in judgments.columns else judgments.withColumn("grade", F.lit(1))
    order = grades.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    ideal = order.join(own.select("query", "n"), "query").where((F.col("rank") <= k) & (F.col("rank") <= F.col("n"))).groupBy("query").agg(F.sum(gain * discount).alias("idcg"))
    joined = own.join(ideal, "query", "left")
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return joined.select("query", "hr1", "hr3", "hr5", "hr10", F.round("mrr", 6).alias("mrr"), F.round(ndcg, 6).alias("ndcg"))


def space_histogram(chunks: DataFrame) -> DataFrame:
    """Rows per (dimension, model); null and '' models are unknown. More than one row: mixed spaces."""
    model = F.coalesce(F.nullif(F.col("embedding_model"), F.lit("")), F.lit("unknown"))
    dim = F.coalesce(F.col("embedding_dim").cast("string"), F.lit("unknown"))
    return chunks.groupBy(F.concat_ws("/", dim, model).alias("space")).agg(F.count("*").alias("chunks"))


def check_one_space(chunks: DataFrame) -> None:
    spaces = [r["space"] for r in space_histogram(chunks).limit(11).collect()]
    if len(spaces) > 1:
        raise ValueError(f"vectors of several spaces: {sorted(spaces)}; index again with one model")


def structured(hits: DataFrame, query: str, mode: str) -> DataFrame:
    """Hits as they leave the engine: the snippet replaces the content; spans stay where the hits have them."""
    spans = [c for c in ("char_start", "char_end") if c in hits.columns]
    return hits.select("path", "uuid", *spans, "rrf_score", T.snippet(F.col("content"), [query]).alias("snippet"), F.lit(mode).alias("mode"))
