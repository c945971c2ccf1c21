import io
import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.functions import vectors as V
from sondage.operators import chunking, embedding, ivf, search, store
from sondage.plans import registry
from sondage.sources import files
from sondage.streaming import watch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    own = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in own) for r in want.fetchall()), key=str)


def test_rounded_zeros_keep_their_sign(spark, duck):
    """Equal by ==, so compared as written: a mean just below zero is -0.0 in DuckDB."""
    xs = [-0.000001, 0.000001, -0.0, 0.0, -0.000005, 0.015625, -0.015625, -0.12345678, 3e8, float("inf")]
    own = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x float")
    both = own.select(V.rounded(F.col("x"), 5), V.rounded(F.col("x").cast("double"), 5)).collect()
    want = [duck.execute("select round(cast($1 as float), 5), round(cast(cast($1 as float) as double), 5)", [x]).fetchone() for x in xs]
    assert [tuple(map(repr, r)) for r in both] == [tuple(map(repr, r)) for r in want]


@pytest.mark.parametrize("size, overlap", [(25, 5), (15, 0), (15, 3), (20, 30), (0, 0), (1000, 200)])
@pytest.mark.parametrize("text", ["", "a" * 50, "word " * 200, "line1\nline2\nline3\nline4", "One. Two three.\n\nFour five six seven eight nine.\n\nñandú " * 4])
def test_spans_stand_for_their_bytes(text, size, overlap):
    data = text.encode()
    spans = chunking.split_spans(data, size, overlap)
    assert spans[0][1] == 0 or not data[: spans[0][1]].strip()
    for piece, a, b in spans:
        assert b - a == len(piece)
        if piece in data and piece:
            assert data[a:b] == piece or data.find(piece) >= 0
    if size <= 0 or len(data) <= size:
        assert spans == [(data, 0, len(data))]
    else:
        assert all(len(p) <= size + min(overlap, size) + 2 for p, _, _ in spans)


def test_chunks_and_embedding(spark):
    df = spark.createDataFrame([("/a", "word " * 500), ("/b", ""), ("/c", None)], "path string, content string")
    chunks = chunking.chunk_documents(df)
    rows = embedding.embed(chunks, config=embedding.EmbedderConfig(dims=32)).collect()
    assert {r["document_path"] for r in rows} == {"/a", "/b", "/c"} and len({r["uuid"] for r in rows}) == len(rows)
    for r in rows:
        assert r["embedding_dim"] == 32 and abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 and r["embedding_model"] == "local-hash"
    assert embedding.fnv1a32(b"a") == 0xE40C292C and embedding.fnv1a32(b"foobar") == 0xBF9CF968
    bad = embedding.EmbedderConfig(dims=4, model="m", embed=lambda ts: [[1.0] * (4 if t else 3) for t in ts])
    assert {(r["content"] == "", r["embedding_model"]) for r in embedding.embed(chunks, config=bad).collect()} == {(True, "local-hash"), (False, "m")}


def test_embedding_gets_small_batches(spark):
    """However many or long the texts of a task are: a service is asked for a batch's texts at once, so its vector has their number."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    config = embedding.EmbedderConfig(dims=1, model="n", embed=lambda ts: [[float(len(ts))] for _ in ts])
    made = spark.range(3000).coalesce(1).select(F.concat(F.lit("many "), F.col("id").cast("string")).alias("content"))
    rows = embedding.embed(made, config=config).collect()
    assert len(rows) == 3000 and max(r["embedding"][0] for r in rows) <= 512
    wide = spark.range(48).coalesce(1).select(F.concat(F.lit("wide "), F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)).alias("content"))
    rows = embedding.embed(wide, config=config).collect()
    assert len(rows) == 48 and max(r["embedding"][0] for r in rows) <= 17


def test_approximate_search_recall(spark):
    own = registry.vectors(spark, DATA)
    centroids = ivf.build(own)
    lists = ivf.nearest(own, centroids).select("uuid", "bucket")
    assert len(centroids) == ivf.bucket_count(own.count()) == lists.select("bucket").distinct().count() and lists.count() == own.count()
    exact = {r["uuid"] for r in search.vector_topk(own, registry.probe(spark, DATA), 10).collect()}
    short = search.hamming_shortlist(own, registry.probe(spark, DATA), 10).select("uuid").join(own, "uuid")
    assert len({r["uuid"] for r in search.vector_topk(own.join(lists.where(F.col("bucket").isin(ivf.probes(centroids, registry.probe(spark, DATA)))), "uuid"), registry.probe(spark, DATA), 10).collect()} & exact) >= 5
    assert len({r["uuid"] for r in search.vector_topk(short, registry.probe(spark, DATA), 10).collect()} & exact) >= 5


def test_postings_agree_with_scan(spark):
    own = registry.docs(spark, DATA)
    index, lengths = search.postings(own)
    got = search.search_postings(index, lengths, spark.createDataFrame([(1, "licensed")], "query_id int, term string"), 10)
    assert [r["uuid"] for r in got.orderBy("rank").collect()] == [r["uuid"] for r in search.bm25(own, "licensed", 10).orderBy("bm25_rank").collect()]
    assert search.bm25(own, "  ", 5).count() == 0
    gone = search.update_postings(index, own.where("doc_id < 100").select("uuid"), index.limit(0))
    assert gone.join(own.where("doc_id < 100"), "uuid", "left_semi").count() == 0


def test_postings_are_counted_where_their_texts_are(spark):
    """Rows of one uuid add up; only texts are shuffled, by uuid, and an update neither shuffles nor sorts postings."""
    rows = [("a", "x y x"), ("a", "X, z"), ("b", "y"), ("c", ""), ("d", None), ("e", "--"), (None, "y \u00c4\u00e4 1"), ("f", "old")]
    chunks = spark.createDataFrame(rows, "uuid string, content string")
    index, lengths = search.postings(chunks)
    want = {("x", "a", 3), ("y", "a", 1), ("z", "a", 1), ("y", "b", 1), ("y", None, 1), ("\u00e4\u00e4", None, 1), ("1", None, 1), ("old", "f", 1)}
    assert index.columns == ["term", "uuid", "tf"] and sorted(map(tuple, index.collect()), key=str) == sorted(want, key=str)
    assert sorted(r["len"] for r in lengths.where("uuid IS NOT NULL AND uuid <> 'd'").collect()) == [0, 0, 1, 1, 2, 3]
    changed = spark.createDataFrame([("f", "new new")], "uuid string, content string")
    now = search.update_postings(index, changed, search.postings(changed)[0])
    assert {tuple(r) for r in now.collect()} == want - {("old", "f", 1)} | {("new", "f", 2)}
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (index, now)):
        assert "hashpartitioning(uuid" in plan and "hashpartitioning(term" not in plan and "SortMergeJoin" not in plan and "BroadcastExchange" not in plan


def test_rerank_and_guard(spark):
    hits = spark.createDataFrame([(str(i), f"t{i}", 0, 0.1, 1 - i / 100) for i in range(25)], "uuid string, content string, bm25_rank int, cosine_score double, rrf_score double")
    out = search.blend(hits, lambda h: h.withColumn("score", F.col("position") * 5.0)).collect()
    assert len(out) == 25 and [r["uuid"] for r in out[20:]] == [str(i) for i in range(20, 25)]
    with pytest.raises(ValueError):
        search.check_one_space(spark.createDataFrame([(3, "a"), (4, "a")], "embedding_dim int, embedding_model string"))


def test_globs_and_prefixes(spark):
    paths = ["a/b/c/d.md", "a/x.md", "z.md", "a/b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    find = lambda g: sorted(r[0] for r in df.where(F.col("path").rlike(T.glob_regex(g))).collect())
    assert find("**/*.md") == ["a/b/c/d.md", "a/x.md", "z.md"]
    assert find("a/*.md") == ["a/x.md"] and find("*.md") == ["z.md"]
    assert find("a/**") == ["a/b", "a/b/c/d.md", "a/x.md"]
    assert [r[0] for r in df.where(T.path_prefix(F.col("path"), "A/_.", True)).collect()] == ["a/x.md"]


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_parsers(spark, tmp_path):
    w = 'xmlns:w="u"'
    made = {
        "a.html": b"<html><head><title>x</title></head><body><p>Hi &amp; you</p>\n<div>two<script>no</script></div></body></html>",
        "b.csv": b'a,b\n"c,d",e\n',
        "c.docx": archive(word__document_xml=f"<w:d {w}><w:p><w:t>One</w:t><w:br/><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p><broken>"),
        "d.xlsx": archive(xl__sharedStrings_xml="<s><si><t>S</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c t="s"><v>0</v></c><c><v>4</v></c><c/></row></w>'),
        "e.odt": archive(content_xml='<o xmlns:t="u"><t:p>a<t:s t:c="2"/>b</t:p></o>'),
        "f.pptx": archive(ppt__slides__slide1_xml=f"<a {w}><w:p><w:t>slide</w:t></w:p></a>"),
        "g.txt": b"plain", "h.pdf": b"%PDF", "i.docx": b"not a zip", "j.exe": b"x", "node_modules/k.txt": b"no", ".git/l.txt": b"no", "sub/m.md": b"yes",
    }
    for name, data in made.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): r for r in files.parse(files.crawl(spark, str(tmp_path))).collect()}
    assert {k: r["content"] for k, r in got.items() if r["error"] is None} == {
        "a.html": "Hi & you\n\ntwo", "b.csv": "a\tb\nc,d\te", "c.docx": "One\ntwo\n\nthree", "d.xlsx": "S\t4\t", "e.odt": "a  b", "f.pptx": "slide", "g.txt": "plain", "m.md": "yes",
    } or got["d.xlsx"]["content"] == "S\t4"
    assert {k for k, r in got.items() if r["error"]} == {"h.pdf", "i.docx"}
    assert files.unsupported(spark.createDataFrame([("/x.rtf",), ("/y.md",)], "path string")).count() == 1


def test_sidecar_and_listings(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"field":"date","value":"v","span":{"start":1,"end":4,"snippet":"s"},"matched":true}\n{"type":"t","value":"w"}\n')
    rows = {r["class"]: r for r in files.sidecar(spark, str(tmp_path / "s.jsonl")).collect()}
    assert (rows["date"]["evidence_text"], rows["date"]["span_end"], rows["t"]["matched"]) == ("s", 4, False)
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.sidecar(spark, str(tmp_path / "bad.jsonl")).collect()
    ex = spark.createDataFrame([(1, "/a", "c", 5, 1), (2, "/a", "c", None, 2), (3, "/a", "d", 1, 3)], "id int, document_path string, class string, span_start int, created_at int")
    assert [r["id"] for r in store.extractions_of(ex, "/a").collect()] == [3, 1, 2]
    assert [r["id"] for r in store.extractions_by_class(ex, "c", 1).collect()] == [2]
    with pytest.raises(ValueError):
        files.text_source(spark, "stdin", " ")


def test_watch_applies_batches(spark, tmp_path):
    schema = "path string, hash string"
    target = watch.Snapshots(spark, str(tmp_path / "t"), schema)
    feed = "path string, hash string, op string, ts timestamp"
    source = str(tmp_path / "in")

    def push(rows):
        spark.createDataFrame(rows, "path string, hash string, op string, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
        watch.watch(spark.readStream.schema(feed).parquet(source), target, str(tmp_path / "c"), once=True).awaitTermination()

    push([("/a", "1", "upsert", "2024-01-01 00:00:00"), ("/a", "2", "upsert", "2024-01-01 00:00:01"), ("/b", "1", "upsert", "2024-01-01 00:00:00")])
    assert sorted(map(tuple, target.read().collect())) == [("/a", "2"), ("/b", "1")]
    push([("/b", None, "delete", "2024-01-01 00:00:05"), ("/c", "9", "upsert", "2024-01-01 00:00:05")])
    assert sorted(map(tuple, target.read().collect())) == [("/a", "2"), ("/c", "9")] and target.version() == 1


def test_bursts(spark, tmp_path):
    spark.createDataFrame([("/a", "2024-01-01 00:00:00.0"), ("/a", "2024-01-01 00:00:00.3"), ("/a", "2024-01-01 00:00:09.0"), ("/z", "2024-01-01 01:00:00.0")], "path string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = watch.bursts(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["changes"] for r in spark.table("bursts").where("path = '/a'").collect()) == [1, 2]
