"""Quality rules (10), native: cross-document line frequency beside per-document rules.

Only DataFrame functions: no Python, pandas or Arrow. Per document (no shuffle): word and symbol counts, lines that
repeat an earlier line, and words in five-word windows that occur twice or more. Across documents: every line is
normalised (lower case, white space runs to one space, trimmed) and hashed, documents are counted per host and
line, lines in more than ``max_docs`` documents of the host are boilerplate, and a document that keeps less than
``min_left`` of its word characters without them is rejected.

A line counts once per document, so the count is a plain sum that combines map-side: a hot host or line never meets
in one task before it is one row per task. The lines above the limit are joined back by (host, hash); Spark
broadcasts them only where their measured size is under its own limit and otherwise splits hot keys.

Null text: no words, base_failed. Null hosts form one host. Repeated rows count as documents of their own. Empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, spool, text_or_empty

MAX_DOCS = 20
MIN_LEFT = 0.3
WINDOW = 5
SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _covered(starts: Column, width: int) -> Column:
    """Words under windows at sorted ``starts``."""
    following = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    steps = F.zip_with(starts, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def base_columns(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the base counts and the (hash, word characters) of the distinct lines."""
    text = F.col("text")
    first = docs.select(F.col("doc_id"), F.col(host).alias("host"), text_or_empty().alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    worded = first.select(
        "doc_id", "host", words_of(text).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    hashed = worded.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"),
        F.transform("lines", lambda x: F.array_join(words_of(F.lower(x)), " ")).alias("norm"),
    ).drop("words", "lines")
    pairs = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted") - 1, F.lit(0))), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))
    # A window is repeated if it equals the one after it or before it in hash order.
    flagged = F.transform("same", lambda x, i: F.struct(x["i"].alias("i"), (x["same"] | F.coalesce(F.get(F.col("same"), i - 1)["same"], F.lit(False))).alias("hit")))
    repeated = hashed.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs)).withColumn("same", same)
    starts = F.array_sort(F.transform(F.filter(flagged, lambda x: x["hit"]), lambda x: x["i"]))
    return repeated.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("same").isNotNull(), _covered(starts, WINDOW)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("norm", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(F.replace(x, F.lit(" "), F.lit(""))).cast("long").alias("chars"))).alias("norm"),
    )


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    base = spool(base_columns(docs, host).withColumn("row", F.monotonically_increasing_id()))
    line = base.select("row", "host", F.explode(F.array_distinct("norm.h")).alias("h"))
    common = spool(line.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "h"))
    every = base.select("row", "host", F.explode("norm").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.chars").alias("chars"))
    lost = (
        every.join(common.withColumnRenamed("host", "common_host").withColumnRenamed("h", "common_h"), F.col("host").eqNullSafe(F.col("common_host")) & (F.col("h") == F.col("common_h")))
        .groupBy("row").agg(F.sum("chars").alias("lost_chars"), F.count("*").alias("lost_lines"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("word_chars") - F.coalesce("lost_chars", F.lit(0))
    return (
        base.drop("norm").join(lost, "row", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= F.lit(min_left) * F.col("word_chars")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("lost_lines", F.lit(0)).cast("long").alias("n_common_lines"))
    )


def without_common_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that more than ``max_docs`` documents of a host have; null texts and
    lines without a word stay, a document may end up empty."""
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    digest = lambda x: F.xxhash64(F.array_join(words_of(F.lower(x)), " "))
    lines = F.split(F.col("text"), "\n")
    own = spool(docs.withColumn("__row", F.monotonically_increasing_id()))
    each = own.select("__row", F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.filter(lines, has_word), digest))).alias("h"))
    common = spool(each.groupBy(F.col("host").alias("common_host"), F.col("h").alias("common_h")).agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).drop("docs"))
    found = each.join(common, F.col("host").eqNullSafe(F.col("common_host")) & (F.col("h") == F.col("common_h")))
    bad = found.groupBy("__row").agg(F.collect_set("h").alias("__bad"))  # at most a document's lines
    left = F.array_join(F.filter(lines, lambda x: ~(has_word(x) & F.array_contains("__bad", digest(x)))), "\n")
    joined = own.join(bad, "__row", "left").withColumn("text", F.when(F.col("__bad").isNull(), F.col("text")).otherwise(left))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, host, array_to_string(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' ') AS norm
  FROM (SELECT doc_id, host, unnest(lines) AS x FROM d)),
c AS (SELECT host, norm FROM l GROUP BY host, norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
x AS (
  SELECT doc_id, count(*) AS n_common_lines, sum(length(replace(norm, ' ', ''))) AS lost FROM l JOIN c USING (host, norm) GROUP BY doc_id),
b AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_common_lines, 0) AS n_common_lines, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars - lost >= {MIN_LEFT} * word_chars AS kept, n_common_lines
FROM f
"""
