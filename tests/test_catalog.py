import io
import json
import os
import urllib.error
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import __main__, config
from sondage.catalog import Catalog
from sondage.errors import EmbedderUnavailable, InvalidInput, NotFound
from sondage.operators import extractions, ivf, quant, search
from sondage.operators.embedding import EmbedderConfig
from sondage.plans import registry
from sondage.sources import remote

DATA = "/root/testdata/sf0.001"
SMALL = EmbedderConfig(dims=32)


def test_catalog_follows_a_folder(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("The quick fox licensed under nothing. " * 60)
    (src / "sub/b.txt").write_text("Slow turtles swim at dawn.")
    (src / "c.docx").write_bytes(b"broken")
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    indexed, removed, rejects = own.index_directory(str(src))
    assert (indexed, removed) == (2, 0) and [os.path.basename(r["path"]) for r in rejects.collect()] == ["c.docx"]
    assert own.index_directory(str(src))[:2] == (0, 0)
    a, b = sorted(r["path"] for r in own.documents().collect())
    assert own.text_of(a).strip() == ("The quick fox licensed under nothing. " * 60).strip()
    hits = own.search("slow turtles", 3).collect()
    assert hits[0]["path"] == b and hits[0]["mode"] == "exact"
    own.set_context(os.path.dirname(b), "water")
    assert own.search("slow turtles", 1).first()["context_text"] == "water"
    assert "Slow turtles" in own.context("turtles") and own.status().first()["document_count"] == 2
    (src / "sub/b.txt").unlink()
    (src / "a.md").write_text("New words entirely.")
    assert own.index_directory(str(src))[:2] == (1, 1)
    assert [r["content"] for r in own.chunks().collect()] == ["New words entirely."]
    with pytest.raises(NotFound):
        own.text_of(b)


def test_catalog_sources_and_extractions(spark, tmp_path):
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    assert own.chunks().count() == 0 and own.extractions().count() == 0 and own.search("x").count() == 0
    assert own.index_text("stdin", "Alpha beta gamma.") == 1 and own.index_text("stdin", "Alpha beta gamma.") == 0
    assert own.index_url("http://x/", get=lambda u: ("text/html", "<p>Hello &amp; bye</p>")) == 1
    with pytest.raises(InvalidInput):
        own.index_url("http://x/", get=lambda u: ("text/html", "<p> </p>"))
    side = tmp_path / "s.jsonl"
    side.write_text('{"field":"greek","value":"alpha","span":{"start":0,"end":5,"snippet":"Alpha"},"matched":true}\n{"type":"t","value":"w"}\n')
    assert own.import_sidecar("stdin", str(side)) == 2 and own.import_sidecar("stdin", str(side)) == 2
    rows = {r["class"]: r for r in own.extractions().collect()}
    assert len(rows) == 2 and rows["greek"]["chunk_uuid"] == own.chunks().where("document_path = 'stdin'").first()["uuid"] and rows["t"]["chunk_uuid"] is None
    assert [r["value"] for r in own.search_extractions("alph*").collect()] == ["alpha"]
    assert quant.having_sidecar(own.chunks()).count() == 0 and own.backfill() == 2 and quant.having_sidecar(own.chunks()).count() == 2 and own.backfill() == 0
    moved = Catalog(spark, own.compact(), SMALL, quant.QuantConfig())
    assert moved.chunks().count() == 2 and moved.extractions().count() == 2 and moved.similar("alpha beta", 1).count() == 1
    assert own.delete("stdin") == 1 and own.delete("stdin") == 0 and own.extractions().count() == 0
    with pytest.raises(NotFound):
        own.import_sidecar("stdin", str(side))


@pytest.mark.parametrize("bits, least", [(2, 0.9), (3, 0.96), (4, 0.99)])
def test_codes_estimate_inner_products(bits, least):
    rng = np.random.default_rng(1)
    own = rng.standard_normal((400, 96))
    own[0] = 0
    codes, norms = quant.encode(own, quant.QuantConfig(bits))
    unit = own[1:] / norms[1:, None]
    q = unit[7]
    got = quant.inner_products(codes[1:], q, quant.QuantConfig(bits))
    assert norms[0] == 0 and got.argmax() == 7 and abs(np.mean(got - unit @ q)) < 0.02 and np.corrcoef(got, unit @ q)[0, 1] > least - 0.15
    assert {len(c) for c in codes} == {4 + 96 * (bits - 1) // 8 + 12}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quantized_search_equals_exact(spark):
    own = registry.vectors(spark, DATA)
    coded = quant.with_sidecar(own)
    probe = registry.probe(spark, DATA)
    exact = [r["uuid"] for r in search.vector_topk(own, probe, 10).orderBy("vector_rank").collect()]
    assert [r["uuid"] for r in quant.quantized_search(coded, probe, 10).orderBy("vector_rank").collect()] == exact
    near = {r["uuid"] for r in quant.quantized_search(coded, probe, 10, quant.QuantConfig(exact=False)).collect()}
    assert len(near & set(exact)) >= 6
    assert quant.quantized_search(coded, probe, 10, quant.QuantConfig(bits=2)).count() == 10 and quant.quantized_search(coded, probe, 0).count() == 0
    odd = quant.with_sidecar(spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0])], "uuid string, embedding array<float>"))
    assert {r["uuid"]: r["quant"] is None for r in odd.collect()} == {"a": False, "b": True, "c": True, "d": False}
    with pytest.raises(ValueError):
        quant.QuantConfig(5)


def test_inverted_file(spark, tmp_path):
    rows = [(f"u{i:03}", "/", [float(np.sin(0.1 * i + 0.1 * j)) for j in range(32)]) for i in range(150)]
    own = spark.createDataFrame(rows, "uuid string, path string, embedding array<float>")
    index = ivf.save(own, str(tmp_path / "i"), {"of": 1})
    again = ivf.load(spark, str(tmp_path / "i"))
    assert again.ready and again.rows == 150 and again.sizes == index.sizes and again.state == {"of": 1} and np.allclose(again.centroids, index.centroids)
    assert len(index.centroids) == 12 and all(index.sizes.values()) and len(index.sizes) == 12
    hits = 0
    for k in range(10, 140, 13):
        exact = [r["uuid"] for r in search.vector_topk(own, rows[k][2], 5).collect()]
        hits += len(set(exact) & {r["uuid"] for r in search.route(own, rows[k][2], 5, index=again).collect()})
    assert hits >= 45
    near = again.read(spark, rows[50][2])
    assert near is None or near.inputFiles() and "bucket" in near._jdf.queryExecution().optimizedPlan().toString()
    assert search.route(own.where("uuid < 'u010'"), rows[50][2], 5, index=again).count() == 5 and search.route(own, rows[50][2], 0, index=again).count() == 0
    assert ivf.load(spark, str(tmp_path / "none")) is None and len(ivf.build(own.limit(0))) == 0 and ivf.probes(np.zeros((0, 3)), [1.0, 0, 0]) == []
    same = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(40)] + [("x", [0.0, 1.0])], "uuid string, embedding array<float>")
    placed = ivf.nearest(same, ivf.build(same))
    assert placed.select("bucket").distinct().count() == 2  # equal rows can't be split
    assert ivf.needs_rebuild(11, 100) and not ivf.needs_rebuild(10, 100) and ivf.bucket_count(10**12) == ivf.MOST_BUCKETS and ivf.probes(np.eye(4), [1, 0, 0, 0], {0: 9, 1: 1, 2: 1, 3: 1}) is None


def test_catalog_indexes(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    text = lambda i: f"{words[i % 10]} {words[i // 10 % 10]} number{i} licensed under-the {words[i % 7]}"
    fresh = spark.createDataFrame([(f"/d/{i}", str(i), text(i)) for i in range(150)], "path string, hash string, content string")
    assert own._put(fresh) == 150 and own.vector_index(False) is None
    scan = lambda q, p=None: [tuple(r) for r in search.bm25(own.chunks().withColumnRenamed("document_path", "path"), q, 20, p).orderBy("bm25_rank").collect()]
    stored = lambda q, p=None: [tuple(r) for r in own._legs(q, p)[0](20).orderBy("bm25_rank").collect()]
    for q in ("alpha", "beta number11", "under-the licensed", "nothing", "number149", "  "):
        assert stored(q) == scan(q), q
    assert stored("alpha", "/d/1") == scan("alpha", "/d/1") != []
    index = own.vector_index()
    assert index.rows == 150 and own.vector_index().folder == index.folder
    exact = lambda q: [r["uuid"] for r in search.vector_topk(own.chunks(), own._vectors([q])[0][0], 3).orderBy("vector_rank").collect()]
    assert own.similar(text(42), 3).orderBy("vector_rank").first()["uuid"] == exact(text(42))[0]
    assert own._put(fresh.where("hash < 5 and length(hash) = 1").withColumn("content", F.concat(F.lit("brandnew "), "content")).withColumn("hash", F.lit("n"))) == 5
    assert own.vector_index().folder == index.folder  # few changes: the index stays, new batches are read beside it
    assert own.similar("brandnew " + text(3), 1).first()["uuid"] == exact("brandnew " + text(3))[0]
    assert own.similar(text(3), 3).count() == 3 and stored("brandnew") == scan("brandnew") and len(stored("brandnew")) == 5
    assert own.delete(fresh.where("length(hash) = 2")) == 90 and own.vector_index(False) is None
    assert all(c is not None for c in own.chunks().select("norm", "signature").first())


def test_texts_come_back_as_they_were(spark, tmp_path):
    own = Catalog(spark, str(tmp_path / "store"), SMALL)
    texts = {"latin": "Größe und Übermaß, naïve façade. " * 90, "cyrillic": "Съешь ещё этих мягких французских булок " * 80, "mixed": "äé日本語🙂" * 400, "lines": "αβγ δεζ\n" * 300}
    for path, text in texts.items():
        own.index_text(path, text)
    for path, text in texts.items():
        assert own.text_of(path).split() == text.split(), path
    assert own.text_of("mixed") == texts["mixed"] and own.text_of("lines", 3, 1) == "αβγ δεζ"


def test_query_grammar(spark):
    rows = spark.createDataFrame([(1, "red apple", "sweet fruit"), (2, "green apple", None), (3, "red brick", "fruitless wall")], "id long, value string, evidence_text string")
    find = lambda q: sorted(r["id"] for r in extractions.search_extractions(rows, q).collect())
    assert find("apple") == [1, 2] and find("red apple") == [1] and find("green OR brick") == [2, 3] and find("red NOT apple") == [3]
    assert find('"red apple"') == [1] and find('"apple sweet"') == [] and find("fruit*") == [1, 3] and find("value:fruit*") == []
    assert find("red (sweet OR wall)") == [1, 3] and find("red AND sweet OR green") == [1, 2] and find(" ") == [] and find('"!!" red') == [1, 3]
    for bad in ("red AND", "(red", "red)", "no:red", "OR", '"open'):
        with pytest.raises(ValueError):
            find(bad)


def test_config(tmp_path):
    path = str(tmp_path / "c.toml")
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "unknown": 1, "retry_count": 0}))
    own = config.load(path)
    assert (own.model, own.retry_count) == ("m", 0) and not (tmp_path / "c.json").exists() and own.quant() is None
    own.set("vector_quantization", "turbo-prod")
    own.set("vector_quant_bits", "3")
    config.save(path, own)
    assert config.load(path).quant() == quant.QuantConfig(bits=3)
    for key, value in (("retry_count", "-1"), ("vector_quant_bits", "5"), ("rerank_query", "maybe"), ("model", ""), ("nope", "1"), ("timeout_seconds", "0")):
        with pytest.raises(InvalidInput):
            own.set(key, value)


def test_addresses_and_retries():
    at = lambda ip: lambda *a, **k: [(0, 0, 0, "", (ip, 80))]
    assert remote.public_address("http://a/", resolve=at("93.184.216.34")) == "93.184.216.34"
    for ip in ("127.0.0.1", "10.0.0.1", "169.254.1.1", "::1", "fe80::1%eth0", "0.0.0.0", "224.0.0.1", "::ffff:10.0.0.1"):
        with pytest.raises(InvalidInput):
            remote.public_address("http://a/", resolve=at(ip))
        assert remote.public_address("http://a/", True, at(ip)) == ip
    for url in ("ftp://a/", "file:///etc/passwd", "nothing"):
        with pytest.raises(InvalidInput):
            remote.public_address(url, resolve=at("93.184.216.34"))
    waits: list[float] = []

    def failing(code):
        raise urllib.error.HTTPError("u", code, "m", {}, io.BytesIO())

    with pytest.raises(EmbedderUnavailable):
        remote.with_retries(lambda: failing(503), 6, sleep=waits.append)
    assert len(waits) == 6 and waits[0] == 0.5 and waits[-1] == 8.0 and all(b in (2 * a, 8.0) for a, b in pairwise(waits))
    with pytest.raises(EmbedderUnavailable):
        remote.with_retries(lambda: failing(404), 6, sleep=waits.append)
    assert len(waits) == 6 and remote.endpoint("http://h:1/api/embeddings", "chat") == "http://h:1/api/chat"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.toml").write_text('ollama_url = "http://127.0.0.1:9/"\nretry_count = 0\nembedding_dim = 16\n')
    (tmp_path / "a.md").write_text("Plain words here.")
    run = lambda *a: (__main__.main(["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.toml"), *a], spark), capsys.readouterr())[0]
    assert run("index", str(tmp_path / "a.md")) == 0
    assert __main__.main(["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.toml"), "search", "plain"], spark) == 0
    assert "Plain words here." in capsys.readouterr().out
    assert run("status") == 0 and run("config", "--set-key", "nope") == 1 and run("extract", "list", "date") == 0
