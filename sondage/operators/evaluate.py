"""Retrieval evaluation: labelled queries, batched hybrid search, mean metrics and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.operators import search

MAX_QUERIES = 1024
TIE = 3e-6  # scores that may be equal after rounding
METRICS = ("hr1", "hr3", "hr5", "hr10", "mrr", "ndcg")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc) of a YAML file: queries: [{query, relevant_ids}]."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    rows = [(q["query"], str(d)) for q in (yaml.safe_load(text) or {}).get("queries", []) for d in q.get("relevant_ids", [])]
    return spark.createDataFrame(rows, "query string, doc string")


def _top(scored: DataFrame, by: str, rank: str, limit: int) -> DataFrame:
    """Ranks within each query; Spark cuts each task's rows to ``limit`` a query before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "uuid"))).where(F.col(rank) <= limit)


def batch_bm25(chunks: DataFrame, queries: list[str], limit: int) -> DataFrame:
    """query, uuid, bm25_rank, bm25 for a stated set of queries: one pass over the texts for all of them.

    Only the places of the queries' own terms leave the scan; phrases meet them by an equi-join on their first word.
    """
    spark = chunks.sparkSession
    pairs = [(q, p, p.split(), len(ps)) for q in dict.fromkeys(queries) for ps in [search.query_phrases(q)] for p in ps]
    terms = sorted({w for _, _, words, _ in pairs for w in words})
    phrases = spark.createDataFrame([(p, w[0], [(x, i) for i, x in enumerate(w)][1:]) for p, w in {p: w for _, p, w, _ in pairs}.items()], "phrase string, first string, rest array<struct<word:string,i:int>>")
    wanted = spark.createDataFrame([(q, p, n) for q, p, _, n in pairs], "query string, phrase string, n_phrases int")
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    words = chunks.select("uuid", F.filter(F.split(T.word_string(F.col("content")), " +"), lambda x: x != "").alias("t")).withColumn("len", F.size("t"))
    totals = words.agg(F.count("*").alias("total"), F.avg("len").alias("avgdl"))
    places = words.select("uuid", "len", F.posexplode("t").alias("at", "term")).join(asked, "term").groupBy("uuid", "len", "term").agg(F.collect_list("at").alias("at"))
    found = places.groupBy("uuid", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("found"))
    each = found.select("uuid", "len", "found", F.explode("found").alias("first", "at")).join(F.broadcast(phrases), "first")
    none = F.array().cast("array<int>")
    follows = lambda x: F.forall("rest", lambda w: F.array_contains(F.coalesce(F.col("found")[w["word"]], none), x + w["i"]))
    hits = each.select("uuid", "len", "phrase", F.size(F.filter("at", follows)).alias("tf")).where("tf > 0")
    known = hits.groupBy("phrase").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("len") / F.col("avgdl")))
    weights = wanted.join(known, "phrase").crossJoin(totals)  # one row a query and phrase
    parts = hits.join(F.broadcast(weights), "phrase").select("query", "uuid", "n_phrases", weight.alias("part"))
    every = parts.groupBy("query", "uuid").agg(F.round(F.sum("part"), 9).alias("bm25"), F.count("*").alias("found"), F.first("n_phrases").alias("n_phrases"))
    return _top(every.where("found = n_phrases"), "bm25", "bm25_rank", limit).select("query", "uuid", "bm25_rank", "bm25")


def batch_vector(vectors: DataFrame, queries: list[tuple[str, list[float]]], limit: int) -> DataFrame:
    """query, uuid, vector_rank, cosine_score by exact search of a stated set of query vectors.

    A task multiplies its batches with the matrix of the queries and sends on its best ``limit`` rows for each (more where
    rows tie), so no pair of a row and a query is ever a row of a plan.
    """
    names = [q for q, _ in queries]
    table = np.asarray([v for _, v in queries], np.float32).reshape(len(queries), -1)
    size = np.sqrt(np.sum((table * table).astype(np.float64), axis=1))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, str]]] = [[] for _ in names]
        for batch in batches:
            rows = [(u, v) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == table.shape[1]]
            if not rows or not limit:
                continue
            own = np.asarray([v for _, v in rows], np.float32)
            norms = np.sqrt(np.sum((own * own).astype(np.float64), axis=1))
            near = own.astype(np.float64) @ table.T.astype(np.float64) / np.maximum(norms[:, None] * size, 1e-300)
            for j, held in enumerate(kept):
                at = np.arange(len(rows))
                if len(rows) > limit:
                    at = np.flatnonzero(near[:, j] >= np.partition(near[:, j], -limit)[-limit] - TIE)
                exact = np.sum((own[at] * table[j]).astype(np.float64), axis=1)
                scale = norms[at] * size[j]
                held += [(-round(float(x / s), 6) if s > 0 else 0.0, rows[i][0]) for i, x, s in zip(at.tolist(), exact, scale)]
                held.sort()
                del held[limit:]
        flat = [(names[j], u, -c) for j, held in enumerate(kept) for c, u in held]
        columns = list(zip(*flat)) if flat else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["query", "uuid", "cosine_score"])

    scored = vectors.select(F.col("uuid").cast("string"), "embedding").mapInArrow(best, "query string, uuid string, cosine_score double")
    return _top(scored, "cosine_score", "vector_rank", limit)


def batch_hybrid(chunks: DataFrame, vectors: DataFrame, queries: list[tuple[str, list[float]]], limit: int, mode: str = "hybrid") -> DataFrame:
    """query, uuid, rank, bm25_rank, vector_rank, cosine_score, rrf_score. ``mode``: hybrid, vector or bm25.

    The driver holds the queries, at most 1,024 a block; more are answered block by block.
    """
    if len(queries) > MAX_QUERIES:
        half = len(queries) // 2
        return batch_hybrid(chunks, vectors, queries[:half], limit, mode).unionByName(batch_hybrid(chunks, vectors, queries[half:], limit, mode))
    depth = search.fetch_depth(limit)
    words = batch_bm25(chunks, [q for q, _ in queries], depth)
    near = batch_vector(vectors, queries, depth)
    if mode == "vector":
        words = words.where("false")
    elif mode == "bm25":
        near = near.where("false")
    elif mode != "hybrid":
        raise ValueError(f"no mode {mode}")
    part = lambda c: F.coalesce(1 / (search.RRF_K + F.col(c)), F.lit(0.0))
    fused = words.drop("bm25").join(near, ["query", "uuid"], "full").select(
        "query", "uuid", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"),
        F.coalesce("cosine_score", F.lit(0.0)).alias("cosine_score"), F.round(part("bm25_rank") + part("vector_rank"), 9).alias("rrf_score"),
    )
    return _top(fused, "rrf_score", "rank", limit)


def summary(measured: DataFrame, error: Column | None = None) -> DataFrame:
    """Means over the queries without an error, and how many there are of both."""
    bad = F.lit(False) if error is None else error.isNotNull()
    means = [F.round(F.coalesce(F.avg(F.when(~bad, F.col(m))), F.lit(0.0)), 6).alias(m) for m in METRICS]
    return measured.agg(F.count_if(~bad).alias("queries"), F.count_if(bad).alias("errors"), *means)


def evaluate(chunks: DataFrame, vectors: DataFrame, queries: list[tuple[str, list[float]]], judged: DataFrame, modes: tuple[str, ...] = ("hybrid", "vector"), limit: int = 10) -> DataFrame:
    """A row per mode: mode, queries, errors and the mean metrics. A query without a hit counts with zeros."""
    asked = chunks.sparkSession.createDataFrame([(q,) for q, _ in queries], "query string").distinct()
    out = None
    for mode in modes:
        found = batch_hybrid(chunks, vectors, queries, limit, mode).select("query", F.col("uuid").alias("doc"), "rank")
        each = asked.join(search.metrics(found, judged), "query", "left").fillna(0.0, list(METRICS))
        row = summary(each).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionByName(row)
    return out.select("mode", "queries", "errors", *METRICS)


def report(rows: DataFrame) -> DataFrame:
    """Metrics as text with four decimals, ready for write.csv(header=True)."""
    return rows.select(*[F.format_string("%.4f", c).alias(c) if c in METRICS else F.col(c) for c in rows.columns])
