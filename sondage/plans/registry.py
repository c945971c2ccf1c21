"""Every query of the retrieval engine with its DuckDB SQL, over the provided tables.

Documents stand for stored documents and one-chunk documents (uuid = doc_id), embeddings for their vectors
(vec_id = doc_id), pages for fetched URLs, events for a change feed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.functions import vectors as V
from sondage.operators import chunking, embedding, evaluate, extractions, ivf, quant, search, store
from sondage.sources import files
from sondage.session import table
from sondage.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PATH = "'/' || source || '/' || lang || '/' || doc_id || '.txt'"
_DOCS = f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS uuid, {_PATH} AS path, text AS content, sha256(text) AS hash, source, lang, n_chars FROM documents"
_WORDS = r"regexp_replace(' ' || lower(content) || ' ', '[^\p{L}\p{N}]+', '  ', 'g')"
QUERY = "licensed under"
_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(CAST(a[i] * b[i] AS FLOAT) AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(CAST({0}[i] * {0}[i] AS FLOAT) AS DOUBLE))))"
_COSINE = f"{_COS} / ({_NORM.format('a')} * {_NORM.format('b')})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("uuid"), path.alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("hash"), "source", "lang", "n_chars")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("uuid"), F.concat(F.lit("/v/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("path"), "embedding", "vec_id", "label")


def probe(spark: SparkSession, d: str, vec_id: int = 25) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


@query(f"SELECT path, hash FROM ({_DOCS}) ORDER BY path")
def s08_documents(s, d):
    return docs(s, d).select("path", "hash").orderBy("path")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'(?i)<script[^>]*>[\s\S]*?</script>', '', 'g'), '(?i)<style[^>]*>[\s\S]*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
'(?i)<(?:hr|p|div|h[1-6]|li|tr)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM pages""")
def p02_html_text(s, d):
    return table(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(replace(content, '. ', chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM (" + _DOCS + ")")
def p10_newline_runs(s, d):
    return docs(s, d).select("doc_id", T.collapse_newlines(F.replace("content", F.lit(". "), F.lit("\n\n\n"))).alias("text"))


@query()
def c02_chunks(s, d):
    return chunking.chunk_documents(docs(s, d)).drop("raw")


@query(f"""SELECT path, CAST(st AS INTEGER) AS start, sha256(from_hex(substring(hex(encode(content)), 2 * CAST(st AS INTEGER) + 1, 2000))) AS hash
FROM (SELECT path, content, unnest(range(0, greatest(1, strlen(content) - 200), 800)) AS st FROM ({_DOCS}))""")
def c03_fixed_stride(s, d):
    return chunking.fixed_stride(docs(s, d))


@query(f"SELECT doc_id, hash FROM ({_DOCS})")
def c04_sha256(s, d):
    return docs(s, d).select("doc_id", "hash")


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || chr(0) || hash || chr(0) || '0')) AS h FROM ({_DOCS}))""")
def c05_chunk_ids(s, d):
    return docs(s, d).select("doc_id", T.chunk_id(F.col("path"), F.col("hash"), F.lit(0)).alias("uuid"))


@query(r"""SELECT doc_id, lower(regexp_extract(regexp_extract(t, '(?s)^---\s*\n(.*?)\n---\s*(\n|$)', 1), '(?m)^sha256:\s*"?([0-9a-fA-F]{64})"?\s*$', 1)) AS sha
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '---' || chr(10) || 'title: x' || chr(10) || 'sha256: "' || upper(hash) || '"' || chr(10) || '---' || chr(10) END || content AS t FROM (""" + _DOCS + "))")
def c07_frontmatter(s, d):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('---\ntitle: x\nsha256: "'), F.upper("hash"), F.lit('"\n---\n')))
    return docs(s, d).select("doc_id", T.frontmatter_sha256(F.concat(head, "content")).alias("sha"))


_SPLIT = "list_filter(regexp_split_to_array(translate(lower(text), '" + T.PUNCTUATION + "', repeat(' ', " + str(len(T.PUNCTUATION)) + r")), '\s+'), lambda w: w <> '')"
_BYTES = "list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS UBIGINT))"


@query(f"""WITH l AS (SELECT doc_id, sha256(text) AS digest, {_SPLIT} AS words FROM documents),
w AS (SELECT doc_id, digest, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM l),
h AS (SELECT word, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), {_BYTES}), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 64 AS slot FROM (SELECT DISTINCT word FROM w WHERE word NOT IN ('{"','".join(T.STOP_WORDS)}'))),
x AS (SELECT doc_id, slot, list_reduce(list(CAST(1 AS FLOAT) + CASE WHEN i < 32 THEN CAST(CAST(CAST('0x' || substr(digest, 2 * i + 1, 2) AS INTEGER) AS DOUBLE) / CAST(255 AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END ORDER BY i), lambda a, b: CAST(a + b AS FLOAT)) AS v FROM w JOIN h USING (word) GROUP BY doc_id, slot),
n AS (SELECT doc_id, CAST(sqrt(sum(CAST(CAST(v * v AS FLOAT) AS DOUBLE))) AS FLOAT) AS size, map(list(slot ORDER BY slot), list(v ORDER BY slot)) AS m FROM x GROUP BY doc_id)
SELECT doc_id, list_transform(range(0, 64), lambda i: round(CAST(coalesce(CASE WHEN size > 0 THEN CAST(coalesce(m[CAST(i AS UBIGINT)], 0) / size AS FLOAT) END, CASE WHEN i = 0 THEN 1 ELSE 0 END) AS DOUBLE), 6)) AS embedding,
'{embedding.LOCAL_MODEL}' AS embedding_model, CAST(64 AS INTEGER) AS embedding_dim FROM documents LEFT JOIN n USING (doc_id)""")
def e01_hash_embedding(s, d):
    done = embedding.embed(docs(s, d).select("doc_id", "content"), config=embedding.EmbedderConfig(dims=64)).drop("content")
    return done.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ('" + "','".join(T.STOP_WORDS) + "') GROUP BY word")
def e02_stop_words(s, d):
    words = table(s, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.where(F.col("word").isin(*T.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT e.vec_id, round({_COSINE}, 6) AS score FROM (SELECT x.vec_id, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q WHERE q.vec_id = 25) e")
def v01_cosine(s, d):
    return vectors(s, d).select("vec_id", V.rounded(V.cosine(V.literal(probe(s, d)), F.col("embedding")), 6).alias("score"))


@query(f"SELECT vec_id, round({_NORM.format('embedding')}, 6) AS norm FROM embeddings")
def v03_norm(s, d):
    return vectors(s, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"""SELECT uuid, CAST(row_number() OVER (ORDER BY cosine_score DESC, uuid) AS INTEGER) AS vector_rank, cosine_score FROM (
SELECT CAST(vec_id AS VARCHAR) AS uuid, round({_COSINE}, 6) AS cosine_score FROM (SELECT x.vec_id, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q WHERE q.vec_id = 25)) ORDER BY 2 LIMIT 20""")
def v04_vector_topk(s, d):
    return search.vector_topk(vectors(s, d), probe(s, d), 20).select("uuid", "vector_rank", "cosine_score")


_BITS = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END))"


@query(f"SELECT vec_id, CAST(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END AS BIGINT) AS sig FROM (SELECT vec_id, CAST({_BITS} AS HUGEINT) AS b FROM embeddings)")
def v08_signature(s, d):
    return vectors(s, d).select("vec_id", F.element_at(V.signature(F.col("embedding"), 64), 1).alias("sig"))


_HAM = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (x.embedding[i] >= 0) <> (q.embedding[i] >= 0) THEN 1 ELSE 0 END))"


@query(f"SELECT x.vec_id, CAST({_HAM} AS INTEGER) AS distance FROM embeddings x, embeddings q WHERE q.vec_id = 25")
def v09_hamming(s, d):
    own = V.signature(V.literal(probe(s, d)), 64)
    return vectors(s, d).select("vec_id", V.hamming(V.signature(F.col("embedding"), 64), own).alias("distance"))


@query(f"SELECT CAST(x.vec_id AS VARCHAR) AS uuid, CAST({_HAM} AS INTEGER) AS distance FROM embeddings x, embeddings q WHERE q.vec_id = 25 ORDER BY 2, 1 LIMIT 40")
def v10_hamming_shortlist(s, d):
    return search.hamming_shortlist(vectors(s, d), probe(s, d), 10).select("uuid", "distance")


_PROBES = tuple(range(3, 500, 50))


@query("SELECT CAST(" + str(len(_PROBES)) + " AS INTEGER) AS queries, true AS ranked_as_exact, true AS recall_over_05")
def v14_ivf_search(s, d):
    """The probed buckets' rows stand in the order of the exact search; recall at ten over ten queries."""
    own = vectors(s, d)
    centroids = ivf.build(own)
    lists = ivf.nearest(own, centroids).select("uuid", "bucket").persist()
    good = hits = 0
    for v in _PROBES:
        q = probe(s, d, v)
        inside = own.join(lists.where(F.col("bucket").isin(ivf.probes(centroids, q))), "uuid", "left_semi")
        got = [r["uuid"] for r in search.vector_topk(inside, q, 10).orderBy("vector_rank").collect()]
        held = {r["uuid"] for r in inside.select("uuid").collect()}
        exact = [r["uuid"] for r in search.vector_topk(own, q, 10).orderBy("vector_rank").collect()]
        good += [u for u in got if u in exact] == [u for u in exact if u in held]
        hits += len(set(got) & set(exact))
    lists.unpersist()
    return s.createDataFrame([(len(_PROBES), good == len(_PROBES), hits >= 5 * len(_PROBES))], "queries int, ranked_as_exact boolean, recall_over_05 boolean")


@query(f"""SELECT uuid, CAST(row_number() OVER (ORDER BY c DESC, uuid) AS INTEGER) AS vector_rank, c AS cosine_score FROM (
SELECT uuid, round({_COSINE}, 6) AS c FROM (SELECT CAST(x.vec_id AS VARCHAR) AS uuid, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q
WHERE q.vec_id = 25 AND x.label % 2 = 1 ORDER BY CAST({_HAM} AS INTEGER), 1 LIMIT 40)) ORDER BY 2 LIMIT 10""")
def v06_full_scan(s, d):
    """Path, sign-bit shortlist from stored signatures and norms, exact ranking."""
    own = vectors(s, d).withColumn("path", F.concat(F.when(F.col("label") % 2 == 1, F.lit("/odd")).otherwise(F.lit("/even")), "path"))
    own = own.withColumns({"norm": V.norm(F.col("embedding")), "signature": V.signature(F.col("embedding"), 64)})
    return search.full_scan(own, probe(s, d), 10, "/odd")


@query("SELECT x.vec_id, list_transform(range(1, 65), lambda i: round(CAST((x.embedding[i] + q.embedding[i]) / 2 AS FLOAT), 5)) AS v FROM embeddings x, embeddings q WHERE q.vec_id = 25")
def v21_average(s, d):
    m = V.mean(F.col("embedding"), V.literal(probe(s, d)))
    return vectors(s, d).select("vec_id", F.transform(m, lambda x: V.rounded(x, 5)).alias("v"))


def _bm25_sql(limit: int, where: str = "true", query: str = QUERY) -> str:
    ph = search.query_phrases(query)
    tf = ", ".join(f"CAST((length(w) - length(replace(w, '{p}', ''))) / {len(p)} AS INTEGER) AS tf{i}" for i, p in enumerate(ph))
    n = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS n{i}" for i in range(len(ph)))
    score = " + ".join(f"greatest(ln((N - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl))" for i in range(len(ph)))
    both = " AND ".join(f"tf{i} > 0" for i in range(len(ph)))
    return f"""WITH w AS (SELECT uuid, path, {_WORDS} AS w FROM ({_DOCS})),
c AS (SELECT uuid, path, CAST((length(w) - length(replace(w, ' ', ''))) / 2 - 1 AS INTEGER) AS len, {tf} FROM w),
st AS (SELECT count(*) AS N, avg(len) AS avgdl, {n} FROM c),
b AS (SELECT uuid, round({score}, 9) AS bm25 FROM c, st WHERE {both} AND {where})
SELECT uuid, CAST(row_number() OVER (ORDER BY bm25 DESC, uuid) AS INTEGER) AS bm25_rank, round(bm25, 6) AS bm25 FROM b ORDER BY 2 LIMIT {limit}"""


@query(_bm25_sql(50))
def t02_bm25(s, d):
    return search.bm25(docs(s, d), QUERY, 50).withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(50, "path LIKE '/src1%'"))
def t03_bm25_path(s, d):
    return search.bm25(docs(s, d), QUERY, 50, "/src1").withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(50))
def t02_bm25_indexed(s, d):
    return search.bm25_indexed(*search.positions(docs(s, d)), QUERY, 50).withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(50, "path LIKE '/src1%'", "under-the licensed"))
def t03_bm25_indexed_path(s, d):
    return search.bm25_indexed(*search.positions(docs(s, d)), "under-the licensed", 50, "/src1").withColumn("bm25", F.round("bm25", 6))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN p IS NULL THEN substring(text, 1, 300)
ELSE substring(text, CAST(greatest(0, least(greatest(0, p - 1 - 150), length(text) - 300)) AS BIGINT) + 1, 300) END AS snippet
FROM (SELECT doc_id, text, least(nullif(instr(lower(text), 'license'), 0), nullif(instr(lower(text), 'under'), 0)) AS p FROM documents)""")
def t07_snippet(s, d):
    return table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), ["License under"]).alias("snippet"))


@query(f"""SELECT d.path FROM ({_DOCS}) d WHERE starts_with(d.path, '/src2/') AND NOT EXISTS (SELECT 1 FROM ({_DOCS}) l WHERE l.path = d.path AND l.n_chars > 1000)""")
def j06_orphans(s, d):
    own = docs(s, d)
    return store.orphans(own, own.where("n_chars > 1000"), "/src2").select("path")


@query(f"SELECT path, hash FROM ({_DOCS}) WHERE doc_id % 2 = 0 OR doc_id % 5 = 0")
def j07_changed(s, d):
    own = docs(s, d)
    was = own.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return store.changed(own.select("path", "hash"), was)


_CONTEXTS = [("/", "all"), ("/src1", "ones"), ("/src1/en", "english one"), ("/src12/", "twelve")]


@query("SELECT path, arg_max(t, length(p)) AS context_text FROM (" + _DOCS + ") LEFT JOIN (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in _CONTEXTS) + ") c(p, t) ON starts_with(path, p) GROUP BY path")
def j08_longest_context(s, d):
    return store.longest_context(docs(s, d).select("path"), s.createDataFrame(_CONTEXTS, "path_prefix string, context_text string"))


@query("""WITH c AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS e, length(text) AS n FROM conversations),
x AS (SELECT conv_id, max(e) // 3 AS m FROM c GROUP BY conv_id)
SELECT conv_id AS id, arg_min(turn, CASE WHEN m >= e - n AND m < e THEN 0 ELSE 1 + least(abs(m - (e - n)), abs(m - e)) END * 100000 + turn) AS chunk FROM c JOIN x USING (conv_id) GROUP BY conv_id""")
def j09_span_chunks(s, d):
    from pyspark.sql import Window

    c = table(s, d, "conversations").withColumn("e", F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")).cast("int"))
    chunks = c.select(F.col("conv_id").alias("document_path"), F.col("turn").alias("uuid"), F.col("turn").alias("chunk_index"), (F.col("e") - F.length("text")).alias("char_start"), F.col("e").alias("char_end"))
    x = c.groupBy("conv_id").agg(F.floor(F.max("e") / 3).cast("int").alias("m")).select(F.col("conv_id").alias("id"), F.col("conv_id").alias("document_path"), F.col("m").alias("span_start"), F.col("m").alias("span_end"))
    return store.span_chunks(x, chunks).withColumnRenamed("chunk_uuid", "chunk")


@query("SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM conversations) AS chunk_count, (SELECT max(ts) FROM events) AS last_indexed_at")
def a01_stats(s, d):
    own = table(s, d, "documents").select(F.col("doc_id"))
    last = table(s, d, "events").agg(F.max("ts").alias("updated_at"))
    return store.stats(own.crossJoin(last), table(s, d, "conversations"))


@query("SELECT CASE WHEN label < 5 THEN '64' ELSE 'unknown' END || '/' || CASE WHEN label % 3 = 0 THEN 'unknown' ELSE 'm' || label % 3 END AS space, count(*) AS chunks FROM embeddings GROUP BY 1")
def a02_space_histogram(s, d):
    m = F.when(F.col("label") % 3 != 0, F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).when(F.col("label") == 3, F.lit(""))
    return search.space_histogram(vectors(s, d).select(F.when(F.col("label") < 5, F.size("embedding")).alias("embedding_dim"), m.alias("embedding_model")))


_VLEG = f"""SELECT uuid, row_number() OVER (ORDER BY cosine_score DESC, uuid) AS vr, cosine_score FROM (
SELECT CAST(vec_id AS VARCHAR) AS uuid, round({_COSINE}, 6) AS cosine_score FROM (SELECT x.vec_id, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q WHERE q.vec_id = 25)) ORDER BY 2 LIMIT 50"""


@query(f"""WITH bl AS ({_bm25_sql(50)}), vl AS ({_VLEG}), f AS (
SELECT coalesce(bl.uuid, vl.uuid) AS uuid, coalesce(bm25_rank, 0) AS bm25_rank, CAST(coalesce(vr, 0) AS INTEGER) AS vector_rank, coalesce(cosine_score, 0) AS cosine_score,
round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vr), 0), 9) AS rrf_score FROM bl FULL JOIN vl ON bl.uuid = vl.uuid ORDER BY rrf_score DESC, 1 LIMIT 10)
SELECT f.uuid, d.path, f.bm25_rank, f.vector_rank, f.cosine_score, f.rrf_score FROM f JOIN ({_DOCS}) d ON d.uuid = f.uuid""")
def a08_hybrid_search(s, d):
    return search.hybrid(docs(s, d), vectors(s, d), QUERY, probe(s, d), 10).drop("content")


@query("""SELECT doc_id, round(w / (1 + p) + (1 - w) * least(100, greatest(0, sc)) / 100, 6) AS blended
FROM (SELECT doc_id, doc_id % 20 AS p, greatest(0.3, 0.7 - 0.05 * (doc_id % 20)) AS w, doc_id % 130 - 10 AS sc FROM documents)""")
def a09_blend(s, d):
    score = search.blend_score((F.col("doc_id") % 20).cast("double"), (F.col("doc_id") % 130 - 10).cast("double"))
    return table(s, d, "documents").select("doc_id", F.round(score, 6).alias("blended"))


@query("SELECT doc_id, [least(100, doc_id % 150), 7] AS scores FROM documents")
def a11_score_array(s, d):
    text = F.concat(F.lit("Scores: ```json\n["), (F.col("doc_id") % 150).cast("string"), F.lit(", 7]\n``` ok"))
    return table(s, d, "documents").select("doc_id", search.score_array(text).cast("array<bigint>").alias("scores"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 512 THEN text WHEN regexp_extract(substring(text, 1, 512), '(?s)^(.*) [^ ]*$', 1) = '' THEN substring(text, 1, 512) ELSE regexp_extract(substring(text, 1, 512), '(?s)^(.*) [^ ]*$', 1) END AS passage FROM documents")
def a12_trim_passage(s, d):
    return table(s, d, "documents").select("doc_id", search.trim_passage(F.col("text")).alias("passage"))


@query(f"""WITH r AS ({_bm25_sql(200, query="the and")}), x AS (SELECT r.uuid, bm25_rank AS rank, length(content) AS n FROM r JOIN ({_DOCS}) d ON d.uuid = r.uuid)
SELECT uuid, rank, used FROM (SELECT uuid, rank, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS used FROM x) WHERE used <= 8000""")
def a13_context_pack(s, d):
    """The hits of a query over all documents, packed in rank order."""
    own = docs(s, d)
    hits = search.bm25(own, "the and", 200).withColumnRenamed("bm25_rank", "rank").join(own.select("uuid", "content"), "uuid")
    return search.pack_context(hits, 8000).select("uuid", "rank", "used")


_RES = "SELECT user_id AS query, event_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events"
_GAIN = "(CASE WHEN rank <= 2 THEN 1.0 ELSE 1 / log2(rank - 1) END)"


@query(f"""WITH r AS ({_RES}), j AS (SELECT user_id AS query, event_id AS doc FROM events WHERE event_type = 'purchase'),
x AS (SELECT r.*, (j.doc IS NOT NULL)::INT AS rel FROM r LEFT JOIN j USING (query, doc)),
o AS (SELECT query, {", ".join(f"max(CASE WHEN rank <= {k} AND rel = 1 THEN 1.0 ELSE 0.0 END) AS hr{k}" for k in (1, 3, 5, 10))},
coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0) AS mrr, sum(CASE WHEN rank <= 10 THEN rel * {_GAIN} ELSE 0 END) AS dcg, count(*) AS n, sum(rel) AS m FROM x GROUP BY query),
i AS (SELECT o.query, sum({_GAIN}) AS idcg FROM o, (SELECT unnest(range(1, 11)) AS rank) WHERE rank <= m AND rank <= n GROUP BY o.query)
SELECT query, CAST(hr1 AS DOUBLE) AS hr1, CAST(hr3 AS DOUBLE) AS hr3, CAST(hr5 AS DOUBLE) AS hr5, CAST(hr10 AS DOUBLE) AS hr10, round(mrr, 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM o LEFT JOIN i USING (query)""")
def a14_metrics(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    results = e.select(F.col("user_id").alias("query"), F.col("event_id").alias("doc"), rank.alias("rank"))
    return search.metrics(results, e.where("event_type = 'purchase'").select(F.col("user_id").alias("query"), F.col("event_id").alias("doc")))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) < 2 THEN '' ELSE array_to_string(string_split(text, chr(10))[2:4], chr(10)) END AS lines FROM documents")
def n02_read_document(s, d):
    return table(s, d, "documents").select("doc_id", store.read_lines(F.col("text"), 2, 3).alias("lines"))


@query(f"SELECT path, count(*) OVER () AS count, count(*) OVER () > 15 AS has_more FROM ({_DOCS}) WHERE starts_with(path, '/src1') ORDER BY path LIMIT 10 OFFSET 5")
def n03_list_documents(s, d):
    return store.list_documents(docs(s, d), "/src1", 10, 5).select("path", "count", "has_more")


@query(f"SELECT path, CASE WHEN strlen(content) > 4000 THEN 'too_large' WHEN len(string_split(content, chr(10))) > 8 THEN 'too_long' ELSE 'ok' END AS status FROM ({_DOCS}) WHERE regexp_matches(path, '^/src1[^/]*/(?:[^/]+/)*[^/]*5\\.txt$')")
def n07_multi_get(s, d):
    return store.multi_get(docs(s, d), "/src1*/**/*5.txt", 4000, 8).select("path", "status")


@query(f"SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE hash END AS hash FROM ({_DOCS})")
def w02_upsert(s, d):
    own = docs(s, d)
    return store.upsert(own.select("path", "hash"), own.where("doc_id % 4 = 0").select("path", F.lit("new").alias("hash")))


@query("SELECT conv_id AS document_path, turn FROM conversations WHERE conv_id % 3 <> 0")
def w03_delete_cascade(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("document_path"), "turn")
    gone = c.where("document_path % 3 = 0").select(F.col("document_path").alias("path")).distinct()
    return store.delete_cascade(c.select(F.col("document_path").alias("path")).distinct(), c, c, gone)[1]


@query("SELECT user_id, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) AS event_type FROM events GROUP BY user_id")
def st02_latest_change(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return store.latest(e, "user_id").select("user_id", "event_type")


@query("SELECT path, 'skipped ' || path || ': .' || k || ' is not supported' AS message FROM (SELECT '/' || p_partkey || '.' || lower(p_type) AS path, lower(p_type) AS k FROM (SELECT p_partkey, ['DOC', 'xls', 'md', 'rtf', 'txt'][p_partkey % 5 + 1] AS p_type FROM part)) WHERE k IN ('doc', 'xls', 'rtf')")
def s02_unsupported_files(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("doc", "xls", "md", "rtf", "txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return files.unsupported(table(s, d, "part").select(F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."), kind).alias("path")))


_EXTRACTIONS = "SELECT conv_id * 1000 + turn AS id, '/c/' || conv_id AS document_path, role AS class, role AS value, text AS evidence_text, CASE WHEN turn % 3 <> 0 THEN CAST(1000 - turn * 7 AS INTEGER) END AS span_start, conv_id % 7 AS created_at FROM conversations"


def _extractions(s, d):
    start = F.when(F.col("turn") % 3 != 0, (1000 - F.col("turn") * 7).cast("int"))
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("/c/"), F.col("conv_id").cast("string")).alias("document_path"), F.col("role").alias("class"), F.col("role").alias("value"), F.col("text").alias("evidence_text"), start.alias("span_start"), (F.col("conv_id") % 7).alias("created_at"))


@query(f"SELECT id, span_start FROM ({_EXTRACTIONS}) WHERE document_path = '/c/3' ORDER BY span_start NULLS LAST, id")
def s09_extractions_of(s, d):
    return store.extractions_of(_extractions(s, d), "/c/3").select("id", "span_start")


@query(f"SELECT id, created_at FROM ({_EXTRACTIONS}) WHERE class = 'user' ORDER BY created_at DESC, id DESC LIMIT 50")
def s09_extractions_by_class(s, d):
    return store.extractions_by_class(_extractions(s, d), "user").select("id", "created_at")


@query(f"SELECT e.vec_id, round({_COS} / ({_NORM.format('b')} * CAST({_NORM.format('a')} AS FLOAT)), 5) AS score FROM (SELECT x.vec_id, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q WHERE q.vec_id = 25) e")
def v02_cosine_stored_norm(s, d):
    own = vectors(s, d).withColumn("norm", V.norm(F.col("embedding")).cast("float"))
    return own.select("vec_id", V.rounded(V.cosine(V.literal(probe(s, d)), F.col("embedding"), F.col("norm")), 5).alias("score"))


_IVF_SEEDS = "SELECT vec_id AS c, embedding AS b FROM embeddings WHERE vec_id < 8"


@query(f"SELECT vec_id, CAST(arg_max(c, round(s, 9) * 1000 - c * 1e-9) AS INTEGER) AS bucket FROM (SELECT vec_id, c, {_COSINE} AS s FROM (SELECT x.vec_id, x.embedding AS a, k.c, k.b FROM embeddings x, ({_IVF_SEEDS}) k)) GROUP BY vec_id")
def v13_ivf_assign(s, d):
    centroids = [list(map(float, r[0])) for r in table(s, d, "embeddings").where("vec_id < 8").orderBy("vec_id").select("embedding").collect()]
    return ivf.nearest(vectors(s, d), np.asarray(centroids)).select("vec_id", "bucket")


@query("SELECT CAST(vec_id AS VARCHAR) AS uuid, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS bucket FROM embeddings WHERE vec_id % 3 <> 0")
def v15_ivf_update(s, d):
    own = vectors(s, d)
    lists = own.where("vec_id % 4 <> 0").select("uuid", F.lit(0).alias("bucket"))
    fresh = own.where("vec_id % 4 = 0").select("uuid", F.lit(1).alias("bucket"))
    return ivf.update(lists, own.where("vec_id % 3 = 0"), fresh.join(own.where("vec_id % 3 <> 0"), "uuid", "left_semi"))


@query(ORACLES["v04_vector_topk"].replace("LIMIT 20", "LIMIT 10"))
def v18_quantized_search(s, d):
    """With exact re-ranking of the shortlist: the rows of the exact search."""
    return quant.quantized_search(quant.with_sidecar(vectors(s, d)), probe(s, d), 10).select("uuid", "vector_rank", "cosine_score")


@query("SELECT vec_id % 2 = 0 AS quantized, count(*) AS n, CAST(max(CASE WHEN vec_id % 2 = 0 THEN 36 END) AS INTEGER) AS bytes FROM embeddings GROUP BY 1")
def v19_sidecar_listing(s, d):
    half = quant.with_sidecar(vectors(s, d)).withColumn("quant", F.when(F.col("vec_id") % 2 == 0, F.col("quant")))
    return half.groupBy(F.col("quant").isNotNull().alias("quantized")).agg(F.count("*").alias("n"), F.max(F.octet_length("quant")).alias("bytes"))


@query("SELECT CAST(64 AS INTEGER) AS dimension, CAST(4 AS INTEGER) AS bit_width, count(*) AS n FROM embeddings")
def v20_backfill(s, d):
    some = quant.with_sidecar(vectors(s, d).where("vec_id % 2 = 0")).unionByName(quant.clear_sidecars(vectors(s, d).where("vec_id % 2 = 1")))
    return quant.backfill(some).groupBy("quant_meta.dimension", "quant_meta.bit_width").agg(F.count("quant").alias("n"))


def _grammar_sql() -> str:
    """user AND ("in the" OR hav*) NOT evidence_text : with, as SQL."""
    w = {c: r"regexp_replace(' ' || lower(" + c + r") || ' ', '[^\p{L}\p{N}]+', '  ', 'g')" for c in ("value", "evidence_text")}
    plain = lambda c, p: f"(length({c}) - length(replace({c}, '{p}', ''))) / {len(p)}"
    prefix = lambda c: f"len(regexp_extract_all({c}, ' hav[^ ]* '))"
    leaves = [plain("v", " user ") + " + " + plain("e", " user "), plain("v", " in  the ") + " + " + plain("e", " in  the "), prefix("v") + " + " + prefix("e"), plain("e", " with ")]
    tf = ", ".join(f"CAST({x} AS INTEGER) AS tf{i}" for i, x in enumerate(leaves))
    n = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS n{i}" for i in range(4))
    score = " + ".join(f"greatest(ln((N - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl))" for i in range(4))
    return f"""WITH w AS (SELECT id, {w['value']} AS v, {w['evidence_text']} AS e FROM ({_EXTRACTIONS})),
c AS (SELECT id, CAST((length(v) - length(replace(v, ' ', '')) + length(e) - length(replace(e, ' ', ''))) / 2 - 2 AS INTEGER) AS len, {tf} FROM w),
st AS (SELECT count(*) AS N, avg(len) AS avgdl, {n} FROM c),
b AS (SELECT id, round({score}, 9) AS bm25 FROM c, st WHERE tf0 > 0 AND (tf1 > 0 OR tf2 > 0) AND NOT tf3 > 0)
SELECT id, CAST(row_number() OVER (ORDER BY bm25 DESC, id) AS INTEGER) AS rank, round(bm25, 6) AS bm25 FROM b ORDER BY 2 LIMIT 30"""


@query(_grammar_sql())
def t05_search_extractions(s, d):
    found = extractions.search_extractions(_extractions(s, d), 'user ("in the" OR hav*) NOT evidence_text:with', 30)
    return found.select("id", "rank", F.round("bm25", 6).alias("bm25"))


_TERMS = r"SELECT uuid, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT uuid, unnest(string_split_regex(trim({0}), ' +')) AS term FROM ({1})) WHERE term <> '' GROUP BY uuid, term"


@query("SELECT term, count(*) AS docs, sum(tf)::BIGINT AS hits FROM (" + _TERMS.format(_WORDS, f"SELECT uuid, CASE WHEN doc_id % 3 = 0 THEN 'changed text' ELSE content END AS content FROM ({_DOCS})") + ") GROUP BY term")
def t06_update_postings(s, d):
    own = docs(s, d)
    index, _ = search.postings(own)
    again = own.where("doc_id % 3 = 0").withColumn("content", F.lit("changed text"))
    return search.update_postings(index, again, search.postings(again)[0]).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("hits"))


@query(f"SELECT '/x/' || hash || '.jsonl' AS sidecar, min(path) AS path FROM ({_DOCS}) WHERE hash IN (SELECT hash FROM ({_DOCS}) WHERE doc_id % 10 = 0) GROUP BY hash")
def j10_infer_documents(s, d):
    own = docs(s, d)
    return extractions.infer_documents(own.where("doc_id % 10 = 0").select(F.concat(F.lit("/x/"), F.col("hash"), F.lit(".jsonl")).alias("path")).distinct(), own)


@query(f"""SELECT path, CASE WHEN doc_id % 2 = 0 THEN '/' || source || '/' || lang ELSE '/' || source END || '/.extractions/' || hash || '.jsonl' AS sidecar FROM ({_DOCS}) d
WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.content AND o.doc_id <> d.doc_id)""")
def j12_find_sidecars(s, d):
    own = docs(s, d)
    single = own.join(own.groupBy("hash").agg(F.count("*").alias("n")).where("n = 1"), "hash", "left_semi")
    up = lambda *parts: F.concat(*[x for p in parts for x in (F.lit("/"), F.col(p))], F.lit("/.extractions/"), F.col("hash"), F.lit(".jsonl")).alias("path")
    there = own.where("doc_id % 3 = 0").select(up("source")).unionByName(own.where("doc_id % 6 = 0").select(up("source", "lang")))
    return extractions.find_sidecars(single, there)


_BATCH = ((QUERY, 25), ("the and", 3), ("de la", 77), ("zzzz qqqq", 4))


def _batch_sql() -> str:
    parts = []
    for q, v in _BATCH:
        leg = _VLEG.replace("q.vec_id = 25", f"q.vec_id = {v}")
        parts.append(f"""(WITH bl AS ({_bm25_sql(50, query=q)}), vl AS ({leg}) SELECT * FROM (SELECT '{q}' AS query, coalesce(bl.uuid, vl.uuid) AS uuid,
coalesce(bm25_rank, 0) AS bm25_rank, CAST(coalesce(vr, 0) AS INTEGER) AS vector_rank, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vr), 0), 9) AS rrf_score
FROM bl FULL JOIN vl ON bl.uuid = vl.uuid) ORDER BY rrf_score DESC, uuid LIMIT 10)""")
    return " UNION ALL ".join(parts)


def _batch(s, d):
    return [(q, probe(s, d, v)) for q, v in _BATCH]


@query(_batch_sql())
def a08_hybrid_batch(s, d):
    return evaluate.batch_hybrid(docs(s, d), vectors(s, d), _batch(s, d), 10).select("query", "uuid", "bm25_rank", "vector_rank", "rrf_score")


def _evaluation_sql() -> str:
    """The batch's results against the labels of its vectors, as means by mode."""
    near = " UNION ALL ".join(f"SELECT '{q}' AS query, uuid, CAST(vr AS INTEGER) AS rank FROM (SELECT * FROM ({_VLEG.replace('q.vec_id = 25', f'q.vec_id = {v}')}) WHERE vr <= 10)" for q, v in _BATCH)
    judged = " UNION ALL ".join(f"SELECT '{q}' AS query, CAST(e.vec_id AS VARCHAR) AS doc FROM embeddings e JOIN embeddings p ON p.vec_id = {v} AND p.label = e.label" for q, v in _BATCH)
    gain = "(CASE WHEN rank <= 2 THEN 1.0 ELSE 1 / log2(rank - 1) END)"
    asked = ", ".join(f"('{q}')" for q, _ in _BATCH)
    return f"""WITH r AS (SELECT 'hybrid' AS mode, query, uuid AS doc, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, uuid) AS INTEGER) AS rank FROM ({_batch_sql()})
UNION ALL SELECT 'vector', query, uuid, rank FROM ({near})), j AS ({judged}),
x AS (SELECT r.*, CASE WHEN j.doc IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN j USING (query, doc)), m AS (SELECT query, count(*) AS judged FROM j GROUP BY query),
o AS (SELECT mode, query, {", ".join(f"max(CASE WHEN rank <= {k} AND rel = 1 THEN 1.0 ELSE 0.0 END) AS hr{k}" for k in (1, 3, 5, 10))},
coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0) AS mrr, sum(rel * {gain}) AS dcg, count(*) AS n FROM x GROUP BY mode, query),
i AS (SELECT mode, o.query, sum({gain}) AS idcg FROM o JOIN m USING (query), (SELECT unnest(range(1, 11)) AS rank) WHERE rank <= n AND rank <= judged GROUP BY mode, o.query),
e AS (SELECT modes.mode, a.query, coalesce(hr1, 0) AS hr1, coalesce(hr3, 0) AS hr3, coalesce(hr5, 0) AS hr5, coalesce(hr10, 0) AS hr10, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
FROM (VALUES ('hybrid'), ('vector')) modes(mode) CROSS JOIN (VALUES {asked}) a(query) LEFT JOIN o ON o.mode = modes.mode AND o.query = a.query LEFT JOIN i ON i.mode = modes.mode AND i.query = a.query)
SELECT mode, count(*) AS queries, CAST(0 AS BIGINT) AS errors, {", ".join(f"printf('%.4f', round(avg({m}), 6)) AS {m}" for m in evaluate.METRICS)} FROM e GROUP BY mode"""


@query(_evaluation_sql())
def a18_evaluation(s, d):
    same = vectors(s, d).select("label", F.col("uuid").alias("doc"))
    label = {q: v for q, v in _BATCH}
    judged = None
    for q, v in label.items():
        own = same.join(table(s, d, "embeddings").where(F.col("vec_id") == v).select("label"), "label", "left_semi").select(F.lit(q).alias("query"), "doc")
        judged = own if judged is None else judged.unionByName(own)
    return evaluate.report(evaluate.evaluate(docs(s, d), vectors(s, d), _batch(s, d), judged))


@query("SELECT count(*) FILTER (WHERE NOT bad) AS queries, count(*) FILTER (WHERE bad) AS errors, " + ", ".join(f"round(avg(v / {i + 1}) FILTER (WHERE NOT bad), 6) AS {m}" for i, m in enumerate(evaluate.METRICS)) + " FROM (SELECT value AS v, event_type = 'error' AS bad FROM events)")
def a17_summary(s, d):
    e = table(s, d, "events")
    return evaluate.summary(e.select("event_type", *[(F.col("value") / (i + 1)).alias(m) for i, m in enumerate(evaluate.METRICS)]), F.when(F.col("event_type") == "error", F.lit("x")))


@query("SELECT vec_id AS query, " + ", ".join(f"printf('%.4f', label * {i + 1} / 7.0) AS {m}" for i, m in enumerate(evaluate.METRICS)) + " FROM embeddings")
def a19_report(s, d):
    return evaluate.report(table(s, d, "embeddings").select(F.col("vec_id").alias("query"), *[(F.col("label") * (i + 1) / 7.0).alias(m) for i, m in enumerate(evaluate.METRICS)]))


@query(f"SELECT path, uuid, rrf_score, CASE WHEN length(content) <= 300 THEN content ELSE substring(content, greatest(1, least(greatest(1, instr(lower(content), 'licensed') - 150), length(content) - 299)), 300) END AS snippet, 'exact' AS mode FROM (SELECT d.*, round(1.0 / (61 + doc_id), 6) AS rrf_score FROM ({_DOCS}) d WHERE instr(lower(content), 'licensed') > 0 AND (instr(lower(content), 'under') = 0 OR instr(lower(content), 'under') > instr(lower(content), 'licensed')))")
def a20_structured_hits(s, d):
    low = F.lower("content")
    first = (F.locate("licensed", low) > 0) & ((F.locate("under", low) == 0) | (F.locate("under", low) > F.locate("licensed", low)))
    hits = docs(s, d).where(first).withColumn("rrf_score", F.round(1 / (61 + F.col("doc_id")), 6))
    return search.structured(hits, QUERY, "exact").select("path", "uuid", "rrf_score", "snippet", "mode")


@query("SELECT path_prefix, context_text FROM (VALUES ('/', 'all'), ('/src1', 'new'), ('/src1/en', 'english one'), ('/src12/', 'twelve'), ('/z', 'last')) t(path_prefix, context_text) ORDER BY path_prefix")
def n09_contexts(s, d):
    schema = "path_prefix string, context_text string"
    own = s.createDataFrame(_CONTEXTS, schema)
    return store.upsert(own, s.createDataFrame([("/src1", "new"), ("/z", "last")], schema), "path_prefix").orderBy("path_prefix")


@query("""WITH x AS (SELECT conv_id * 1000 + turn AS id, '/c/' || conv_id AS document_path, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE role END AS class FROM conversations)
SELECT id, document_path, class, CASE WHEN class = 'new' THEN '/c/' || (id // 1000) || '#' || (id % 1000) END AS chunk_uuid FROM x""")
def w06_import_extractions(s, d):
    own = _extractions(s, d).withColumns({"created_at": F.timestamp_seconds("created_at"), "span_end": F.col("span_start"), "matched": F.lit(True), "chunk_uuid": F.lit(None).cast("string")})
    turn = F.col("id") % 1000
    span = {"class": F.lit("new"), "span_start": (turn * 10).cast("int"), "span_end": (turn * 10 + 4).cast("int")}
    fresh = own.where("(id div 1000) % 2 = 0").withColumns(span)
    chunks = fresh.select("document_path", F.concat("document_path", F.lit("#"), turn.cast("string")).alias("uuid"), turn.alias("chunk_index"), "span_start").withColumnsRenamed({"span_start": "char_start"}).withColumn("char_end", F.col("char_start") + 10)
    return extractions.import_extractions(own, fresh.drop("chunk_uuid", "created_at"), chunks).select("id", "document_path", "class", "chunk_uuid")


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id % 5 <> 0")
def w08_delete_extractions(s, d):
    own = _extractions(s, d)
    return extractions.delete_extractions(own, own.where("(id div 1000) % 5 = 0").select(F.col("document_path").alias("path"))).select("id")


@query(f"SELECT path FROM ({_DOCS}) WHERE path = '/src1' OR starts_with(path, '/src1/')")
def w11_in_directory(s, d):
    return docs(s, d).where(T.in_directory(F.col("path"), "/src1")).select("path")


_FOLDERS = "['a', '.git', 'node_modules', 'b/target', 'target.d', 'b/.x/c']"
_KINDS = "['md', 'TXT', 'exe', 'pdf', 'go', 'bin', 'xlsx']"


@query(f"""SELECT path FROM (SELECT f, '/root/dist/' || f || '/' || l_orderkey || '_' || l_linenumber || '.' || k AS path, lower(k) AS k, n FROM (
SELECT *, {_FOLDERS}[l_partkey % 6 + 1] AS f, {_KINDS}[l_suppkey % 7 + 1] AS k, CAST(l_extendedprice * 300 AS BIGINT) AS n FROM lineitem))
WHERE f IN ('a', 'target.d') AND k NOT IN ('exe', 'bin') AND n <= 10485760""")
def s01_crawl_filter(s, d):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), key.cast("int"))
    folder = pick(("a", ".git", "node_modules", "b/target", "target.d", "b/.x/c"), F.col("l_partkey") % 6 + 1)
    kind = pick(("md", "TXT", "exe", "pdf", "go", "bin", "xlsx"), F.col("l_suppkey") % 7 + 1)
    path = F.concat(F.lit("/root/dist/"), folder, F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("."), kind)
    listed = table(s, d, "lineitem").select(path.alias("path"), F.round(F.col("l_extendedprice") * 300).cast("long").alias("length"))
    return files.indexable(listed, "/root/dist").select("path")


@query("""SELECT CASE WHEN turn % 2 = 0 THEN role ELSE 'turn' END AS class, text AS value, CASE WHEN turn % 3 > 0 THEN role END AS evidence_text,
CASE WHEN turn % 3 > 0 THEN CAST(turn AS INTEGER) END AS span_start, CASE WHEN turn % 3 > 0 THEN CAST(turn + 5 AS INTEGER) END AS span_end, coalesce(turn % 2 = 1, false) AS matched FROM conversations""")
def s06_sidecar(s, d):
    span = F.when(F.col("turn") % 3 > 0, F.struct(F.col("turn").alias("start"), (F.col("turn") + 5).alias("end"), F.col("role").alias("snippet")))
    kind = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(""))
    matched = F.when(F.col("turn") % 2 == 1, F.lit(True))
    line = F.to_json(F.struct(kind.alias("field"), F.lit("turn").alias("type"), F.col("text").alias("value"), matched.alias("matched"), span.alias("span")))
    return files.sidecar_rows(table(s, d, "conversations").select(line.alias("value")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'id' || chr(9) || 'name' || chr(10) || c_custkey || chr(9) || c_name || ', \"x\"' || chr(9) || c_mktsegment AS content FROM customer")
def p08_csv(s, d):
    body = F.concat(F.lit("id,name\r\n"), F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', ""x""",'), F.col("c_mktsegment"), F.lit("\n"))
    made = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), body.cast("binary").alias("content"))
    return files.parse(made.withColumn("path", F.concat("path", F.lit(".csv")))).select(F.regexp_replace("path", "[.]csv$", "").alias("path"), "content")


def _halting(texts: list[str]) -> list[list[float] | None]:
    """A service that fails for some texts and answers others with a wrong length."""
    return [None if len(t) % 3 == 0 else [0.5] * (8 if len(t) % 3 == 1 else 7) for t in texts]


@query(f"SELECT doc_id, CASE WHEN length(text) % 3 = 1 THEN 'm' ELSE '{embedding.LOCAL_MODEL}' END AS embedding_model, CAST(8 AS INTEGER) AS embedding_dim FROM documents")
def e07_provenance(s, d):
    """E5 and E7: vectors that are missing or don't fit are replaced and labelled."""
    config = embedding.EmbedderConfig(dims=8, model="m", embed=_halting)
    return embedding.embed(docs(s, d).select("doc_id", "content"), config=config).select("doc_id", "embedding_model", "embedding_dim")


_TOP = f"""SELECT uuid, CAST(row_number() OVER (ORDER BY cosine_score DESC, uuid) AS INTEGER) AS vector_rank, cosine_score FROM (
SELECT CAST(vec_id AS VARCHAR) AS uuid, round({_COSINE}, 6) AS cosine_score FROM (SELECT x.vec_id, x.embedding AS a, q.embedding AS b FROM embeddings x, embeddings q WHERE q.vec_id = 25 AND {{0}})) ORDER BY 2 LIMIT 10"""


@query(_TOP.format("x.label = 3"))
def v07_router_prefix(s, d):
    return search.route(vectors(s, d), probe(s, d), 10, "/v/3/").select("uuid", "vector_rank", "cosine_score")


@query(_TOP.format("x.label IN (1, 2)"))
def j05_candidate_restriction(s, d):
    lists = vectors(s, d).select("uuid", F.col("label").alias("bucket"))
    near = vectors(s, d).join(lists.where(F.col("bucket").isin(1, 2)), "uuid", "left_semi")
    return search.vector_topk(near, probe(s, d), 10).select("uuid", "vector_rank", "cosine_score")


def _seeds(s, d) -> np.ndarray:
    return np.asarray([r[0] for r in table(s, d, "embeddings").where("vec_id < 8").orderBy("vec_id").select("embedding").collect()])


@query(f"SELECT bucket, list(x ORDER BY i) AS mean FROM (SELECT bucket, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings JOIN ({ORACLES['v13_ivf_assign']}) USING (vec_id), (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i) GROUP BY bucket, i) GROUP BY bucket")
def v11_lloyd_step(s, d):
    found = ivf.means(vectors(s, d), _seeds(s, d))
    return s.createDataFrame([(b, [float(x) for x in np.round(v, 6)]) for b, v in found.items()], "bucket int, mean array<double>")


@query(f"SELECT CAST(c AS INTEGER) AS bucket FROM (SELECT c, round({_COSINE}, 9) AS s FROM (SELECT k.c, k.b, q.embedding AS a FROM ({_IVF_SEEDS}) k, embeddings q WHERE q.vec_id = 25)) ORDER BY s DESC, c LIMIT 3")
def v13_ivf_probes(s, d):
    return s.createDataFrame([(b,) for b in ivf.probes(_seeds(s, d), probe(s, d))], "bucket int")


@query("SELECT vec_id, CAST(256 AS INTEGER) AS n_bytes, true AS same FROM embeddings")
def v22_codec(s, d):
    there = V.from_bytes(V.to_bytes(vectors(s, d)), name="back")
    return there.select("vec_id", F.octet_length("bytes").alias("n_bytes"), (F.col("back") == F.col("embedding")).alias("same"))


@query(f"SELECT vec_id, round(CAST({_NORM.format('embedding')} AS FLOAT), 5) AS norm, CAST(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END AS BIGINT) AS sig FROM (SELECT *, CAST({_BITS} AS HUGEINT) AS b FROM embeddings)")
def w04_saved_vectors(s, d):
    return V.saved(vectors(s, d), 64).select("vec_id", F.round(F.col("norm").cast("double"), 5).alias("norm"), F.element_at("signature", 1).alias("sig"))


@query("SELECT label, count(DISTINCT CASE WHEN vec_id % (label + 1) = 0 THEN 1 ELSE 2 END) > 1 AS mixed FROM embeddings GROUP BY label")
def a03_space_guard(s, d):
    out = []
    for label in sorted(r[0] for r in table(s, d, "embeddings").select("label").distinct().collect()):
        own = vectors(s, d).where(F.col("label") == label)
        own = own.select(F.size("embedding").alias("embedding_dim"), F.when(F.col("vec_id") % (label + 1) == 0, F.lit("a")).otherwise(F.lit("b")).alias("embedding_model"))
        try:
            search.check_one_space(own)
            out.append((label, False))
        except ValueError:
            out.append((label, True))
    return s.createDataFrame(out, "label int, mixed boolean")


@query("SELECT event_id, user_id % 3 = 1 AND value >= 0.85 AS plain FROM events")
def a10_rerank_skip(s, d):
    e = table(s, d, "events")
    return e.select("event_id", search.plain_first(F.col("user_id") % 3, F.col("value")).alias("plain"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) AS t FROM events WHERE user_id % 2 = 0 GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS path, coalesce(t, 'old') AS hash FROM u LEFT JOIN l USING (user_id) WHERE coalesce(t, '') <> 'error' AND user_id % 5 <> 0""")
def st03_changes_and_sweep(s, d):
    """The last change of each path applied, errors as deletes, then paths that a listing doesn't have swept out."""
    e = table(s, d, "events")
    current = e.select(F.col("user_id").alias("path"), F.lit("old").alias("hash")).distinct()
    op = F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert"))
    changes = e.where("user_id % 2 = 0").select(F.col("user_id").alias("path"), "ts", "event_id", F.col("event_type").alias("hash"), op.alias("op"))
    listing = e.where("user_id % 5 <> 0").select(F.col("user_id").alias("path")).distinct()
    return watch.apply_changes(current, changes).join(listing, "path", "left_semi").select("path", "hash")
