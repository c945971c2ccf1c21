"""Line dedup (7): overlapping three-line windows.

Every window of ``width`` consecutive non-blank lines (trimmed) is hashed to 128 bits. A window that occurs more than
once anywhere keeps its first occurrence, by (doc_id, position); the lines under all later ones are removed, covered
positions merged. Blank lines go with the non-blank line before them.

Only hashes are shuffled for the search: first occurrences come from a map-side combined minimum, and the windows
that repeat are joined back by hash, a join whose hot keys Spark can split. Texts are shuffled once, by document key,
to meet the positions to remove. The key is a hash of doc_id and text, so nothing depends on row order.

Null and empty texts, and texts of fewer than ``width`` lines, stay as they are. Null ids come last in order. Rows
with equal id and equal text are one document and get equal results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, small_batches, spool

WIDTH = 3


def _spans(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the indexes of the non-blank ones."""
    lines = text.split("\n") if text else []
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each window: doc_id, key of the document, position of the first line, hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, keys, at, hashes = [], [], [], []
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines, full = _spans(text)
                trimmed = [lines[i].strip() for i in full]
                for p in range(len(full) - width + 1):
                    ids.append(doc_id)
                    keys.append(key)
                    at.append(p)
                    hashes.append(xxhash.xxh3_128_digest("\n".join(trimmed[p : p + width]).encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())],
                names=["doc_id", "key", "at", "window"],
            )

    return keyed(docs).select("doc_id", "key", "text").mapInArrow(hashed, "doc_id long, key binary, at int, window binary")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.isnull("doc_id").cast("string"), text)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text"))


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, at: where windows start that occurred before."""
    found = windows(docs, width)
    place = F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id"), F.col("key"), F.col("at"))
    # Written first: then both sides of the join are plain exchanges, and Spark splits a hot window's side.
    repeated = spool(
        found.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("final"))
        .where(F.col("first") != F.col("final")).select("window", F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"))
    )
    return (
        found.join(repeated, "window").where((F.col("key") != F.col("first_key")) | (F.col("at") != F.col("first_at")))
        .groupBy("key").agg(F.collect_set("at").alias("starts"))
    )


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with shorter texts, and n_lines (non-blank before) and n_removed behind their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), F.col("doc_id"), F.col("text"))
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.isnull("doc_id").cast("string"), text)))
    both = whole.select("own", key.alias("key")).join(covered(docs, width), "key", "left").select("own", "starts")
    fields = [f for f in docs.schema.fields]
    kind = "own struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">"
    where = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, starts = batch.column(0), batch.column(1).to_pylist()
            texts, n_lines, n_removed = [], [], []
            for text, gone in zip(own.field(where).to_pylist(), starts):
                lines, full = _spans(text)
                n_lines.append(len(full))
                if gone:
                    out = {q for p in gone for q in range(p, p + width)}
                    n_removed.append(len(out))
                    owner = -1
                    kept, at = [], dict(zip(full, range(len(full))))
                    for i, line in enumerate(lines):
                        owner = at.get(i, owner)
                        if owner not in out:
                            kept.append(line)
                    text = "\n".join(kept)
                else:
                    n_removed.append(0)
                texts.append(text)
            columns = [own.field(i) if i != where else pa.array(texts, pa.string()) for i in range(own.type.num_fields)]
            struct = pa.StructArray.from_arrays(columns, names=[own.type.field(i).name for i in range(own.type.num_fields)])
            yield pa.RecordBatch.from_arrays([struct, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["own", "n_lines", "n_removed"])

    done = both.mapInArrow(cut, f"{kind}, n_lines long, n_removed long")
    return done.select(*[F.col("own").getField(c).alias(c) for c in names], F.col("n_lines").alias("n_lines"), F.col("n_removed").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
n AS (
  SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: trim(lines[i], ' ' || chr(9) || chr(13)) <> '') AS nb FROM l),
w AS (
  SELECT doc_id, p, trim(lines[nb[p]]) || chr(10) || trim(lines[nb[p + 1]]) || chr(10) || trim(lines[nb[p + 2]]) AS win
  FROM (SELECT doc_id, lines, nb, unnest(range(1, len(nb) - 1)) AS p FROM n)),
r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (
  SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS gone FROM r GROUP BY doc_id),
j AS (
  SELECT n.doc_id, lines, nb, coalesce(gone, []) AS gone FROM n LEFT JOIN g USING (doc_id))
SELECT doc_id,
  array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
    lambda i: NOT list_contains(gone, len(list_filter(nb, lambda b: b <= i)))), lambda i: lines[i]), chr(10)) AS text,
  len(nb) AS n_lines, len(gone) AS n_removed
FROM j
"""
