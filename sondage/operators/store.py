"""Snapshot operators: upserts, cascading deletes, change detection, sidecar spans, context lookup, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete_cascade(documents: DataFrame, chunks: DataFrame, extractions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``gone``: path. Rows of all three relations without those documents."""
    paths = gone.select("path").distinct()
    by = paths.withColumnRenamed("path", "document_path")
    return documents.join(paths, "path", "left_anti"), chunks.join(by, "document_path", "left_anti"), extractions.join(by, "document_path", "left_anti")


def changed(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the manifest (path, hash) that are new or have another hash."""
    was = stored.select("path", F.col("hash").alias("was"))
    return manifest.join(was, "path", "left").where(F.col("was").isNull() | (F.col("was") != F.col("hash"))).drop("was")


def orphans(stored: DataFrame, listing: DataFrame, directory: str) -> DataFrame:
    return stored.where(T.in_directory(F.col("path"), directory)).join(listing.select("path"), "path", "left_anti")


def longest_context(paths: DataFrame, contexts: DataFrame) -> DataFrame:
    """path, context_text of the longest matching prefix: an equi-join on the path's heads of the lengths that prefixes have."""
    lengths = F.broadcast(contexts.agg(F.sort_array(F.collect_set(F.length("path_prefix"))).alias("lengths")))
    own = F.filter("lengths", lambda n: n <= F.length("path"))
    heads = paths.crossJoin(lengths).select("path", F.explode_outer(own).alias("n")).withColumn("path_prefix", F.expr("substring(path, 1, n)"))
    joined = heads.join(contexts, "path_prefix", "left").where(F.col("context_text").isNotNull()).groupBy("path").agg(F.max_by("context_text", "n").alias("context_text"))
    return paths.select("path").distinct().join(joined, "path", "left")


def span_chunks(extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extraction id and the first chunk that holds its middle, else the one with the nearest edge."""
    middle = F.floor((F.col("span_start") + F.col("span_end")) / 2)
    both = extractions.join(chunks.select("document_path", "uuid", "chunk_index", "char_start", "char_end"), "document_path").withColumn("m", middle)
    holds = (F.col("m") >= F.col("char_start")) & (F.col("m") < F.col("char_end"))
    distance = F.least(F.abs(F.col("m") - F.col("char_start")), F.abs(F.col("m") - F.col("char_end")))
    best = F.struct(F.when(holds, 0).otherwise(1), F.when(holds, F.lit(0)).otherwise(distance), F.col("chunk_index"))
    return both.groupBy("id").agg(F.min_by("uuid", best).alias("chunk_uuid"))


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("document_count"), F.max("updated_at").alias("last_indexed_at"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunk_count")))


def read_lines(text: Column, start: int = 1, most: int = 0) -> Column:
    """Lines from ``start`` (1-based), ``most`` of them (0: all); '' behind the end."""
    start = max(1, start)
    lines = F.split(text, "\n")
    count = F.greatest(F.size(lines) - (start - 1), F.lit(0)) if most <= 0 else F.lit(most)
    return F.when(F.size(lines) < start, F.lit("")).otherwise(F.array_join(F.slice(lines, F.lit(start), count), "\n"))


def list_documents(documents: DataFrame, folder: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """path, hash, position, count (all matches) and has_more."""
    limit = min(500, limit if limit > 0 else 50)
    found = documents.where(F.col("path").startswith(folder)) if folder else documents
    page = found.orderBy("path").offset(max(0, offset)).limit(limit)
    total = found.agg(F.count("*").alias("count"))
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("count") > max(0, offset) + limit)


def multi_get(documents: DataFrame, pattern: str, max_bytes: int, max_lines: int) -> DataFrame:
    """path and status of what the pattern matches: documents over a limit are skipped, not cut."""
    size, lines = F.octet_length("content"), F.size(F.split("content", "\n"))
    status = F.when(size > max_bytes, "too_large").when(lines > max_lines, "too_long").otherwise("ok")
    found = documents.where(F.col("path").rlike(T.glob_regex(pattern)))
    return found.select("path", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def extractions_of(extractions: DataFrame, path: str) -> DataFrame:
    return extractions.where(F.col("document_path") == path).orderBy(F.asc_nulls_last("span_start"), "id")


def extractions_by_class(extractions: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    return extractions.where(F.col("class") == kind).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def latest(changes: DataFrame, key: str = "path", at: str = "ts") -> DataFrame:
    """The last change of each key: what a quiet period leaves of a burst."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct(at, *[c for c in changes.columns if c not in (key, at)])).alias("x")).select(key, "x.*")


def ranks(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
