"""Command line: python -m sondage --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from sondage import __version__
from sondage import config as configuration
from sondage.errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sondage")
    p.add_argument("--store", required=True)
    p.add_argument("--config", default="sondage.toml")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *arguments: [sub.choices[name].add_argument(*a, **k) for a, k in arguments] if sub.add_parser(name) else None
    arg = lambda *a, **k: (a, k)
    add("search", arg("query"), arg("--limit", type=int, default=5), arg("--prefix"))
    add("index", arg("source", help="folder, file, URL or - for standard input"), arg("--name", default="stdin"), arg("--allow-private", action="store_true"))
    add("delete", arg("path"))
    add("context", arg("topic"), arg("--max-chars", type=int, default=4000))
    add("extract", arg("action", choices=["search", "list", "import"]), arg("values", nargs="+"))
    add("set-context", arg("prefix"), arg("text"))
    add("status")
    add("quantize", arg("--bits", type=int, default=4))
    add("migrate")
    add("version")
    add("bench", arg("corpus", help="folder of .txt files"), arg("judgments", help="YAML file of queries and relevant ids"), arg("--csv"))
    add("serve", arg("--port", type=int, default=8420), arg("--home", default="~"), arg("--per-minute", type=int, default=120))
    add("config", arg("--set-key"), arg("--set-value", default=""))
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    options = parser().parse_args(arguments)
    try:
        if options.command == "version":
            print(__version__)
            return 0
        own = configuration.load(options.config)
        if options.command == "config":
            if options.set_key:
                own.set(options.set_key, options.set_value)
                configuration.save(options.config, own)
            print(json.dumps(vars(own), indent=1))
            return 0
        return run(options, own, spark)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(options: argparse.Namespace, own: configuration.Config, spark=None) -> int:
    from sondage.catalog import Catalog
    from sondage.operators import assist, store
    from pyspark.sql import functions as F

    from sondage.operators.embedding import EmbedderConfig, embed
    from sondage.operators.quant import QuantConfig
    from sondage.session import local_session
    from sondage.sources.remote import RemoteEmbedder, chat

    remote = RemoteEmbedder(own.ollama_url, own.model, own.embedding_dim, own.timeout_seconds, own.retry_count, own.retry_backoff_ms / 1000)
    catalog = Catalog(spark or local_session(), options.store, EmbedderConfig(own.embedding_dim, own.model, own.retry_count, remote), own.quant())
    show = lambda df: [print(json.dumps(r.asDict(True), default=str, ensure_ascii=False)) for r in df.toLocalIterator()]
    match options.command:
        case "search":
            ask = lambda model, timeout: lambda prompt: chat(own.ollama_url, model or own.model, prompt, timeout)
            expand = assist.expander(ask(own.expand_model, own.expand_timeout_seconds)) if own.expand_query else None
            rerank = assist.reranker(ask(own.rerank_model, own.rerank_timeout_seconds), options.query) if own.rerank_query else None
            show(catalog.search(options.query, options.limit, options.prefix, expand, rerank))
        case "index":
            if options.source == "-":
                print(catalog.index_text(options.name, sys.stdin.read()), "indexed")
            elif options.source.startswith(("http://", "https://")):
                print(catalog.index_url(options.source, options.allow_private), "indexed")
            elif os.path.isfile(options.source):
                indexed, rejects = catalog.index_file(options.source)
                print(indexed, "indexed")
                show(rejects)
            else:
                indexed, removed, rejects = catalog.index_directory(options.source)
                print(indexed, "indexed,", removed, "removed")
                show(rejects)
        case "delete":
            print(catalog.delete(options.path), "deleted")
        case "context":
            print(catalog.context(options.topic, options.max_chars))
        case "extract":
            first = options.values[0]
            if options.action == "import":
                print(catalog.import_sidecar(first, options.values[1]), "imported")
            else:
                show(catalog.search_extractions(first) if options.action == "search" else store.extractions_by_class(catalog.extractions(), first))
        case "set-context":
            catalog.set_context(options.prefix, options.text)
        case "status":
            show(catalog.status())
        case "quantize":
            print(catalog.backfill(QuantConfig(options.bits)), "documents")
        case "migrate":
            print(catalog.migrate(), "documents")
        case "bench":
            from sondage.operators import evaluate
            from sondage.sources import files

            corpus = files.labelled_corpus(catalog.spark, options.corpus).select(F.col("doc").alias("uuid"), F.col("doc").alias("path"), "content")
            judged = evaluate.judgments(catalog.spark, options.judgments)
            asked = [r["query"] for r in judged.select("query").distinct().orderBy("query").collect()]
            vectors = embed(corpus, config=catalog.embedder)
            found = evaluate.evaluate(corpus, vectors, list(zip(asked, catalog._vectors(asked)[0])), judged)
            show(evaluate.report(found))
            if options.csv:
                evaluate.report(found).coalesce(1).write.mode("overwrite").option("header", True).csv(options.csv)
        case "serve":
            from sondage.server import Guard, Service, serve

            service = Service(catalog, os.path.expanduser(options.home), Guard(os.environ.get("SONDAGE_TOKEN", ""), options.per_minute))
            print(f"listening on 127.0.0.1:{options.port}")
            serve(service, options.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
