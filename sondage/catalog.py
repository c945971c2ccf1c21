"""A store of indexed documents: batches of chunks as Parquet, live rows named by a versioned document manifest.

A commit appends the new chunks (with norm and sign bits of their vectors) and their postings, then writes one new version
of the manifest, which readers see only when it is complete; so a replaced document never has a gap, and an unchanged one
is never rewritten. Deletes touch the manifest alone. Postings lie in a folder for each bucket of terms, so a text
search reads its terms' folders; the manifest has the corpus totals. From ``ivf.THRESHOLD`` chunks on, vector searches
without a prefix use a stored inverted file, built from an unfiltered search, and read its probed buckets and the batches
that came after it; when over a tenth of the rows changed it is built again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.errors import InvalidInput, NotFound, StoreError
from sondage.functions import text as T
from sondage.functions import vectors as V
from sondage.operators import chunking, embedding, extractions, ivf, quant, search, store
from sondage.operators.embedding import EmbedderConfig
from sondage.sources import files, remote
from sondage.streaming.watch import Snapshots

DOCUMENTS = "path string, hash string, updated_at timestamp, batch string, extraction_batch string, chunks int, words bigint"
CHUNKS = "document_path string, chunk_index int, content string, hash string, char_start int, char_end int, raw binary, uuid string, embedding array<float>, embedding_model string, embedding_dim int, norm float, signature array<bigint>, quant binary, quant_meta " + quant.META
POSTINGS = "term string, uuid string, path string, at array<int>, tf int, batch string, bucket int"
LENGTHS = "uuid string, path string, len int, batch string"
EXTRACTIONS = "id bigint, document_path string, chunk_uuid string, class string, value string, evidence_text string, span_start int, span_end int, matched boolean, producer string, source_ref string, created_at timestamp"
CONTEXTS = "path_prefix string, context_text string"
CONTEXT_HITS, CONTEXT_CHARS = 10, 4000
FORMAT = 1


class IndexVersions(Snapshots):
    """Versions of the vector index: complete ones have their state written."""

    marker = "state/_SUCCESS"


class Catalog:
    """One writer at a time; any number of readers. ``path`` is a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str, embedder: EmbedderConfig = EmbedderConfig(), quantized: quant.QuantConfig | None = None):
        self.spark, self.path, self.embedder, self.quantized = spark, path.rstrip("/"), embedder.resolved(), quantized
        self._documents = Snapshots(spark, f"{self.path}/documents", DOCUMENTS)
        self._contexts = Snapshots(spark, f"{self.path}/contexts", CONTEXTS)
        self._indexes = IndexVersions(spark, f"{self.path}/ivf", "")

    # Relations.

    def documents(self) -> DataFrame:
        return self._documents.read()

    def _live(self, name: str, schema: str, by: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        keys = self.documents().select(F.col("path").alias("document_path"), F.col(by).alias("batch"))
        return rows.join(keys, ["document_path", "batch"], "left_semi").drop("batch")

    def chunks(self) -> DataFrame:
        return self._live("chunks", CHUNKS, "batch")

    def extractions(self) -> DataFrame:
        return self._live("extractions", EXTRACTIONS, "extraction_batch")

    def contexts(self) -> DataFrame:
        return self._contexts.read().orderBy("path_prefix")

    def _indexed(self, name: str, schema: str) -> DataFrame:
        """Live rows of the text index."""
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows.join(self.documents().select("path", "batch"), ["path", "batch"], "left_semi")

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def postings(self) -> DataFrame:
        return self._indexed("postings", POSTINGS)

    def lengths(self) -> DataFrame:
        return self._indexed("lengths", LENGTHS)

    # Writes.

    def _put(self, fresh: DataFrame) -> int:
        """Index (path, hash, content) rows that are new or changed; the number of them."""
        todo = store.changed(fresh, self.documents())
        batch = uuid.uuid4().hex
        done = embedding.embed(chunking.chunk_documents(todo), config=self.embedder)
        done = quant.with_sidecar(done, self.quantized) if self.quantized else quant.clear_sidecars(done)
        done = V.saved(done, self.embedder.dims)
        self._append(done, batch)
        # The manifest takes its documents from what was written, so a file that changes meanwhile is not mixed in.
        written = self._written(batch)
        rows = todo.select("path", "hash").join(written, "path").select(
            "path", "hash", F.current_timestamp().alias("updated_at"), F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("extraction_batch"), "chunks", "words"
        )
        count = written.count()
        if count:
            self._documents.write(store.upsert(self.documents(), rows))
        return count

    def _append(self, chunks: DataFrame, batch: str, folder: str | None = None) -> None:
        """Chunks of a batch and, from what was written, their postings."""
        folder = folder or self.path
        columns = [c.strip().split()[0] for c in CHUNKS.split(", quant_meta")[0].split(", ")] + ["quant_meta"]
        chunks.select(*columns).withColumn("batch", F.lit(batch)).write.partitionBy("batch").mode("append").parquet(f"{folder}/chunks")
        own = self.spark.read.schema(f"{CHUNKS}, batch string").parquet(f"{folder}/chunks").where(F.col("batch") == batch)
        index, lengths = search.positions(own.withColumnRenamed("document_path", "path"))
        index = index.withColumn("bucket", search.bucket_of(F.col("term"))).select(*[c.split()[0] for c in POSTINGS.split(", ")])
        index.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("append").parquet(f"{folder}/postings")
        lengths.select(*[c.split()[0] for c in LENGTHS.split(", ")]).write.partitionBy("batch").mode("append").parquet(f"{folder}/lengths")

    def _written(self, batch: str) -> DataFrame:
        """path, chunks, words of a batch's documents; partition pruning reads its folder alone, which isn't there for an empty batch."""
        rows = self.spark.read.schema(LENGTHS).parquet(f"{self.path}/lengths").where(F.col("batch") == batch)
        return rows.groupBy("path").agg(F.count("*").cast("int").alias("chunks"), F.sum("len").alias("words"))

    def index_directory(self, directory: str) -> tuple[int, int, DataFrame]:
        """(indexed, removed, rejects): changed files in, stored files that are gone out, bad files reported."""
        listing = files.crawl(self.spark, directory)
        parsed = files.parse(listing)
        rejects = parsed.where("error is not null").select("path", "error").unionByName(files.unsupported(self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")).withColumnRenamed("message", "error"))
        indexed = self._put(parsed.where("error is null").select("path", "hash", "content"))
        root = listing.select(F.regexp_extract("path", r"^([a-z]+:/*?)/[^/]", 1)).first()
        scheme = root[0] if root else "file:"
        gone = store.orphans(self.documents(), listing, f"{scheme}{directory.rstrip('/')}")
        return indexed, self.delete(gone), rejects

    def index_file(self, path: str) -> tuple[int, DataFrame]:
        """(1 if the file was new or changed, rejects)."""
        parsed = files.parse(files.one_file(self.spark, path))
        return self._put(parsed.where("error is null").select("path", "hash", "content")), parsed.where("error is not null").select("path", "error")

    def index_text(self, source: str, text: str) -> int:
        return self._put(files.text_source(self.spark, source, text))

    def index_url(self, url: str, allow_private: bool = False, get: Callable[[str], tuple[str, str]] | None = None) -> int:
        kind, body = get(url) if get else remote.fetch(url, allow_private)
        row = self.spark.createDataFrame([(url, body)], "path string, content string")
        if "html" in kind:
            row = row.withColumn("content", T.html_to_text(F.col("content")))
        if not row.where(F.trim("content") != "").count():
            raise InvalidInput(f"{url} has no text")
        return self._put(row.withColumn("hash", F.sha2("content", 256)))

    def delete(self, paths: DataFrame | str) -> int:
        """Documents with their chunks and extractions; how many there were."""
        gone = self.spark.createDataFrame([(paths,)], "path string") if isinstance(paths, str) else paths.select("path")
        kept = self.documents().join(gone, "path", "left_anti")
        removed = self.documents().count() - kept.count()
        if removed:
            self._documents.write(kept.select(self.documents().columns))
        return removed

    def import_sidecar(self, path: str, sidecar: str) -> int:
        """Replace a document's extractions by those of a JSON-lines file."""
        if not self.documents().where(F.col("path") == path).count():
            raise NotFound(f"{path} isn't indexed", "index it first")
        fresh = files.sidecar(self.spark, sidecar).withColumns({"id": F.monotonically_increasing_id(), "document_path": F.lit(path)})
        batch = uuid.uuid4().hex
        own = extractions.import_extractions(self.spark.createDataFrame([], EXTRACTIONS), fresh, self.chunks().where(F.col("document_path") == path), source=sidecar)
        own.withColumn("batch", F.lit(batch)).write.partitionBy("batch").mode("append").parquet(f"{self.path}/extractions")
        self._documents.write(self.documents().withColumn("extraction_batch", F.when(F.col("path") == path, F.lit(batch)).otherwise(F.col("extraction_batch"))))
        return own.count()

    def set_context(self, prefix: str, text: str) -> None:
        self._contexts.write(store.upsert(self._contexts.read(), self.spark.createDataFrame([(prefix, text)], CONTEXTS), "path_prefix"))

    def backfill(self, config: quant.QuantConfig = quant.QuantConfig()) -> int:
        """Give live chunks without a sidecar one, as a new batch of the documents that lack them."""
        lacking = quant.having_sidecar(self.chunks(), False).select("document_path").distinct()
        batch = uuid.uuid4().hex
        todo = self.chunks().join(lacking, "document_path", "left_semi")
        self._append(quant.backfill(todo, config), batch)
        written = self._written(batch).select("path", F.lit(batch).alias("b"))
        count = written.count()
        if count:
            self._documents.write(self.documents().join(written, "path", "left").withColumn("batch", F.coalesce("b", "batch")).drop("b"))
        return count

    # Vector index.

    def vector_index(self, build: bool = True) -> ivf.VectorIndex | None:
        """The stored index if it fits the live rows; else, if there are enough of them and ``build``, a new one."""
        total = self.documents().agg(F.sum("chunks")).first()[0] or 0
        version = self._indexes.version()
        index = ivf.load(self.spark, f"{self._indexes.path}/v{version}") if version >= 0 else None
        if index is not None:
            known = self.chunks_of(index.state["batches"]).count()
            if index.state["dims"] == self.embedder.dims and not ivf.needs_rebuild(index.rows - known + total - known, max(1, index.rows)):
                return index
        if not build or total < ivf.THRESHOLD:
            return None
        own = self.spark.read.schema(f"{CHUNKS}, batch string").parquet(f"{self.path}/chunks").join(
            self.documents().select(F.col("path").alias("document_path"), "batch"), ["document_path", "batch"], "left_semi"
        )
        rows = own.where(F.size("embedding") == self.embedder.dims).select("uuid", "document_path", "batch", "embedding")
        state = {"batches": sorted(r["batch"] for r in self.documents().select("batch").distinct().collect()), "dims": self.embedder.dims}
        return ivf.save(rows, f"{self._indexes.path}/v{version + 1}", state)

    def chunks_of(self, batches: list[str], others: bool = False) -> DataFrame:
        """Live chunks of these batches, or of all others; folders of the rest are not read."""
        inside = F.col("batch").isin(batches)
        rows = self.documents().where(~inside if others else inside).select(F.col("path").alias("document_path"), "batch")
        if not self._exists("chunks"):
            return self.spark.createDataFrame([], f"{CHUNKS}, batch string")
        return self.spark.read.schema(f"{CHUNKS}, batch string").parquet(f"{self.path}/chunks").where(~inside if others else inside).join(rows, ["document_path", "batch"], "left_semi")

    def _nearest(self, vector: list[float], limit: int, prefix: str | None = None) -> DataFrame:
        """The router over the store's vectors: inverted file, or all live rows with their stored norms."""
        index = self.vector_index() if limit > 0 and not prefix else None
        live = self.documents().select(F.col("path").alias("document_path"), "batch")
        if index is not None:
            near = index.read(self.spark, vector)
            if near is not None:
                rows = near.join(live, ["document_path", "batch"], "left_semi").select("uuid", "embedding")
                return search.vector_topk(rows.unionByName(self.chunks_of(index.state["batches"], True).select("uuid", "embedding")), vector, limit)
        return search.vector_topk(self.chunks().withColumnRenamed("document_path", "path"), vector, limit, prefix)

    # Queries.

    def status(self) -> DataFrame:
        return store.stats(self.documents(), self.chunks())

    def search(self, query: str, limit: int = 5, prefix: str | None = None, expand: Callable[[str], str] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """path, uuid, spans, rrf_score, snippet, mode and context_text of the hits, best first."""
        if not query:
            raise InvalidInput("the query is empty")
        own = self.chunks()
        search.check_one_space(own)
        texts, models = self._vectors([query, *([passage] if expand and (passage := expand(query)) else [])])
        stored = own.select("embedding_model").first()
        mode = "fallback" if stored and stored[0] != models[0] else "exact"
        chunks = own.withColumnRenamed("document_path", "path")
        options = search.SearchOptions(prefix=prefix, rerank=rerank, expanded=texts[1] if len(texts) > 1 else None)
        hits = search.hybrid(chunks, chunks, query, texts[0], limit, options, self._legs(query, prefix)).join(own.select("uuid", "char_start", "char_end"), "uuid")
        found = search.structured(hits, query, mode)
        return found.join(store.longest_context(found.select("path").distinct(), self.contexts()), "path", "left").orderBy(F.desc("rrf_score"), "uuid")

    def _legs(self, query: str, prefix: str | None) -> tuple[Callable[[int], DataFrame], Callable[[list[float], int], DataFrame]]:
        totals = self.documents().agg(F.sum("chunks"), F.sum("words")).first()
        words = lambda depth: search.bm25_indexed(self.postings(), self.lengths(), query, depth, prefix, (totals[0] or 0, totals[1] or 0))
        return words, lambda vector, depth: self._nearest(vector, depth, prefix)

    def similar(self, query: str, limit: int = 10, prefix: str | None = None) -> DataFrame:
        """Vector search alone, by sidecars where the catalog has them, else by the inverted file or a scan."""
        vector = self._vectors([query])[0][0]
        if self.quantized:
            return quant.quantized_search(self.chunks(), vector, limit, self.quantized)
        return self._nearest(vector, limit, prefix)

    def _vectors(self, texts: list[str]) -> tuple[list[list[float]], list[str]]:
        """Vectors of query texts, on the driver and without retries."""
        call = self.embedder.embed
        if isinstance(call, remote.RemoteEmbedder):
            call = replace(call, retries=0)
        found = call(texts) if call else [None] * len(texts)
        fits = [v is not None and len(v) == self.embedder.dims for v in found]
        own = [list(map(float, v if ok else embedding.hash_vector(t, self.embedder.dims))) for t, v, ok in zip(texts, found, fits)]
        return own, [self.embedder.model if ok else embedding.LOCAL_MODEL for ok in fits]

    def context(self, topic: str, max_chars: int = CONTEXT_CHARS) -> str:
        """Chunks about a topic with their sources, in rank order within the budget."""
        vector = self._vectors([topic])[0][0]
        chunks = self.chunks().withColumnRenamed("document_path", "path")
        hits = search.hybrid(chunks, chunks, topic, vector, CONTEXT_HITS, legs=self._legs(topic, None))
        rows = search.pack_context(store.ranks(hits, [F.desc("rrf_score"), F.col("uuid")]), max_chars).orderBy("rank").collect()
        return f"# Context: {topic}\n\n" + "\n\n---\n\n".join(f"Source: {r['path']}\n\n{r['content']}" for r in rows)

    def search_extractions(self, query: str, limit: int = 10) -> DataFrame:
        return extractions.search_extractions(self.extractions(), query, limit)

    def text_of(self, path: str, start: int = 1, most: int = 0) -> str:
        """Lines of a document as stored: its chunks joined at their byte spans."""
        rows = self.chunks().where(F.col("document_path") == path).select("char_start", "content", "raw").orderBy("char_start").collect()
        if not rows:
            raise NotFound(f"{path} isn't indexed")
        out, at = b"", 0
        for r in rows:
            piece = r["content"].encode() if r["raw"] is None else bytes(r["raw"])
            if r["char_start"] > at:
                out += b"\n" * (r["char_start"] - at)
                at = r["char_start"]
            out += piece[max(0, at - r["char_start"]) :]
            at = max(at, r["char_start"] + len(piece))
        lines = out.decode("utf-8", "replace").split("\n")
        start = max(1, start)
        return "\n".join(lines[start - 1 : start - 1 + most] if most > 0 else lines[start - 1 :])

    def format(self) -> int:
        """The layout's version; 0 for a store from before there were any."""
        return int(self.spark.read.text(f"{self.path}/format").first()[0]) if self._exists("format") else 0 if self._exists("documents") else FORMAT

    def migrate(self) -> int:
        """Bring an older store to the present layout; how many documents were rewritten. Chunks are kept, with norm, sign bits and postings added."""
        was = self.format()
        if was > FORMAT:
            raise StoreError(f"the store has layout {was}", f"this version knows {FORMAT}")
        count = 0
        if was < 1 and self.documents().limit(1).count():
            own = V.saved(self._live("chunks", CHUNKS, "batch"), self.embedder.dims)
            batch = uuid.uuid4().hex
            self._append(own, batch)
            written = self._written(batch).withColumnsRenamed({"chunks": "c", "words": "w"})
            count = written.count()
            self._documents.write(self.documents().join(written, "path").withColumns({"batch": F.lit(batch), "chunks": F.col("c"), "words": F.col("w")}).drop("c", "w"))
        self.spark.createDataFrame([(str(FORMAT),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/format")
        return count

    def compact(self) -> str:
        """Write the live rows to a new folder of the same layout with one batch; the caller swaps the folders."""
        target = f"{self.path}-{uuid.uuid4().hex[:8]}"
        self._append(self.chunks(), "0", target)
        self.extractions().withColumn("batch", F.lit("0")).write.partitionBy("batch").parquet(f"{target}/extractions")
        has: Column = F.when(F.col("extraction_batch").isNotNull(), F.lit("0"))
        Snapshots(self.spark, f"{target}/documents", DOCUMENTS).write(self.documents().withColumns({"batch": F.lit("0"), "extraction_batch": has}))
        Snapshots(self.spark, f"{target}/contexts", CONTEXTS).write(self._contexts.read())
        return target
