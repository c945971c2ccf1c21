import json
import os
import threading
import tracemalloc
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import __main__, server
from sondage.catalog import Catalog
from sondage.errors import InvalidInput, StoreError
from sondage.operators import assist, embedding, search
from sondage.operators.embedding import EmbedderConfig
from sondage.sources import files
from sondage.streaming import watch

SMALL = EmbedderConfig(dims=16)


def test_prompts_and_answers():
    prompt = assist.rerank_prompt("what?", ["é" * 400, "two\nlines"])
    assert "what?" in prompt and "é" * 250 in prompt and "é" * 251 not in prompt and "[2] two lines" in prompt
    assert assist.scores("Sure: ```json\n[120, -4, 7]```", 3) == [100, 0, 7]
    for answer in ("none", "[1]", "[1, 2.5]", "[true, 1]", "[1, [2]]"):
        with pytest.raises(ValueError):
            assist.scores(answer, 2)
    assert assist.trim("word " * 200) == ("word " * 102).strip() and assist.trim("x" * 600) == "x" * 512 and assist.trim("a b") == "a b"
    assert assist.expander(lambda p: " a passage ")("q") == "a passage"

    def down(_):
        raise OSError

    assert assist.expander(down)("q") == ""


def test_rerank_by_model(spark):
    hits = spark.createDataFrame([(str(i), f"t{i}", 0, 0.1, 1 - i / 100) for i in range(25)], "uuid string, content string, bm25_rank int, cosine_score double, rrf_score double")
    asked = []

    def chat(prompt):
        asked.append(prompt)
        return json.dumps([5 * i for i in range(20)])

    order = [r["uuid"] for r in search.blend(hits, assist.reranker(chat, "q")).collect()]
    assert len(order) == 25 and order[20:] == [str(i) for i in range(20, 25)] and order[:2] != ["0", "1"] and len(asked) == 1
    assert [r["uuid"] for r in search.blend(hits, assist.reranker(lambda p: "no", "q")).orderBy(F.desc("rrf_score")).collect()] == [str(i) for i in range(25)]
    plain = hits.withColumn("bm25_rank", F.when(F.col("uuid") == "0", 1).otherwise(0)).withColumn("cosine_score", F.lit(0.9))
    assert search.blend(plain, assist.reranker(chat, "q")).count() == 25 and len(asked) == 1


def test_vectors_are_asked_for_once(spark):
    calls = []

    def service(texts):
        calls.append(list(texts))
        return [[float(len(t)), 1.0] if t != "odd" else [1.0] for t in texts]

    cache, config = embedding.VectorCache(3), EmbedderConfig(dims=2, model="m", embed=service)
    assert cache.ask(["a", "bb", "odd"], config) == [[1.0, 1.0], [2.0, 1.0], [1.0]] and cache.ask(["bb", "a"], config) == [[2.0, 1.0], [1.0, 1.0]]
    assert len(calls) == 1 and cache.ask(["odd"], config) == [[1.0]] and len(calls) == 2
    cache.ask(["c", "d"], config)
    assert len(cache.kept) == 3 and cache.ask(["a"], config) and calls[-1] == ["c", "d"]
    assert EmbedderConfig(dims=0, embed=service).resolved().dims == 2 and EmbedderConfig(dims=0).resolved().dims == 768 and EmbedderConfig(dims=5).resolved().dims == 5


def test_kept_vectors_are_small(spark):
    cache = embedding.VectorCache()
    config = EmbedderConfig(dims=768, model="m", embed=lambda ts: [[i / 768 for i in range(768)] for _ in ts])
    tracemalloc.start()
    cache.ask([str(i) for i in range(500)], config)
    held = tracemalloc.get_traced_memory()[0] / 500
    tracemalloc.stop()
    assert len(cache.kept) == 500 and held < 4096
    assert cache.ask(["7"], config) == [np.asarray([i / 768 for i in range(768)], np.float32).tolist()]


def test_single_file_and_home(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "a.md").write_text("Alpha words.")
    (tmp_path / "out.md").write_text("no")
    os.symlink(tmp_path / "out.md", home / "link.md")
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    assert own.index_file(str(home / "a.md"))[0] == 1 and own.index_file(str(home / "a.md"))[0] == 0
    assert files.restrict_to(str(home / "a.md"), str(home)) == str(home / "a.md")
    for bad in (home / "link.md", tmp_path / "out.md", home / ".." / "out.md", str(home) + "x/a.md"):
        with pytest.raises(InvalidInput):
            files.restrict_to(str(bad), str(home))


def test_older_stores_move(spark, tmp_path):
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    own.index_text("/a", "alpha beta")
    own.index_text("/b", "beta gamma")
    assert own.format() == 0 and own.migrate() == 2 and own.format() == 1 and own.migrate() == 0
    assert {r["path"] for r in own.search("beta", 5).collect()} == {"/a", "/b"} and own.postings().where("term = 'beta'").count() == 2
    assert own.documents().agg(F.sum("chunks"), F.sum("words")).first()[:] == (2, 4)
    spark.createDataFrame([("9",)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "store/format"))
    with pytest.raises(StoreError):
        own.migrate()


def test_watch_sweeps(spark, tmp_path):
    target = watch.Snapshots(spark, str(tmp_path / "t"), "path string, hash string")
    target.write(spark.createDataFrame([("/gone", "1"), ("/kept", "1")], "path string, hash string"))
    source = str(tmp_path / "in")
    spark.createDataFrame([("/new", "2", "upsert", "2024-01-01 00:00:00")], "path string, hash string, op string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    listing = lambda: spark.createDataFrame([("/kept",), ("/new",)], "path string")
    feed = spark.readStream.schema("path string, hash string, op string, ts timestamp").parquet(source)
    watch.watch(feed, target, str(tmp_path / "c"), once=True, listing=listing).awaitTermination()
    assert sorted(r["path"] for r in target.read().collect()) == ["/kept", "/new"]


def test_endpoints(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "a.md").write_text("Slow turtles swim.")
    now = [0.0]
    guard = server.Guard("secret", 12, lambda: now[0])
    http = server.serve(server.Service(Catalog(spark, str(tmp_path / "s"), SMALL), str(home), guard), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    port = http.server_address[1]

    def ask(path, body=None, **headers):
        sent = {"Authorization": "Bearer secret"} | ({"Content-Type": "application/json"} if body is not None else {}) | {k.replace("_", "-"): v for k, v in headers.items()}
        request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", None if body is None else json.dumps(body).encode(), {k: v for k, v in sent.items() if v})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert ask("/health") == (200, '{"status": "ok"}')
        assert ask("/health", Authorization="")[0] == 401 and ask("/health", Host="evil.example")[0] == 403 and ask("/health", Origin="http://evil.example")[0] == 403
        assert ask("/index", {"path": "x"}, Content_Type="text/plain")[0] == 415
        assert json.loads(ask("/index", {"path": str(home / "a.md")})[1]) == {"indexed": 1, "removed": 0, "rejects": []}
        assert ask("/index", {"path": str(tmp_path)})[0] == 400 and ask("/nothing")[0] == 404 and ask("/search?q=")[0] == 400 and ask("/search?q=x&limit=z")[0] == 400
        assert json.loads(ask("/search", {"query": "turtles"})[1])["results"][0]["snippet"] == "Slow turtles swim."
        status, events = ask("/search/stream?q=turtles&limit=1")
        assert status == 200 and "event: result\n" in events and events.rstrip().endswith('event: done\ndata: {"count": 1}')
        assert json.loads(ask("/status")[1])["document_count"] == 1
        assert [ask("/health")[0] for _ in range(5)][-1] == 429
        now[0] = 61
        assert ask("/health")[0] == 200
    finally:
        http.shutdown()


def test_more_commands(spark, tmp_path, capsys):
    (tmp_path / "c.toml").write_text('ollama_url = "http://127.0.0.1:9/"\nretry_count = 0\nembedding_dim = 16\nrerank_query = true\nexpand_query = true\n')
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for name, text in {"d1": "apples are red", "d2": "bricks are heavy", "d3": "rivers are long"}.items():
        (corpus / f"{name}.txt").write_text(text)
    (tmp_path / "j.yaml").write_text("queries:\n - query: heavy bricks\n   relevant_ids: [d2]\n - query: long rivers\n   relevant_ids: [d3]\n")

    def run(*a):
        code = __main__.main(["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.toml"), *a], spark)
        return code, capsys.readouterr().out

    assert run("version")[1].strip() and run("index", str(corpus / "d1.txt"))[1].startswith("1 indexed") and run("migrate")[0] == 0
    assert "apples" in run("search", "apples")[1]
    rows = [json.loads(x) for x in run("bench", str(corpus), str(tmp_path / "j.yaml"), "--csv", str(tmp_path / "out"))[1].splitlines()]
    assert {r["mode"]: (r["queries"], r["hr1"]) for r in rows} == {"hybrid": (2, "1.0000"), "vector": (2, "1.0000")} and os.path.exists(tmp_path / "out/_SUCCESS")
