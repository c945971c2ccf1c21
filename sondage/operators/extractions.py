"""Grounded extractions: full-text search with a query grammar, sidecar lookup, import."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.operators.search import B, K1, ranked
from sondage.operators.store import span_chunks

COLUMNS = ("value", "evidence_text")
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|([()])|([^\s"()*:]+)(\*)?(?:\s*(:))?)')

Node = tuple


def parse_query(query: str) -> tuple[Node | None, list[tuple[str, bool, tuple[str, ...]]]]:
    """Tree of and/or/not/leaf nodes and the leaves (phrase, prefix, columns).

    Bare terms, "phrases", term*, AND, OR, NOT (binding in the order NOT, AND, OR), parentheses and ``column :`` before
    a phrase; terms side by side are joined by AND. Leaves without a word are left out. Raises ValueError on bad syntax.
    """
    tokens: list[tuple] = []
    at, query = 0, query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"bad query near {query[at:at + 20]!r}")
        at = m.end()
        quoted, star, paren, word, tail, colon = m.groups()
        if paren:
            tokens.append((paren,))
        elif quoted is not None:
            tokens.append(("leaf", quoted.replace('""', '"'), bool(star)))
        elif colon:
            if word not in COLUMNS:
                raise ValueError(f"no column {word}")
            tokens.append(("column", word))
        elif word in ("AND", "OR", "NOT") and not tail:
            tokens.append((word,))
        else:
            tokens.append(("leaf", word, bool(tail)))
    leaves: list[tuple[str, bool, tuple[str, ...]]] = []
    here = [0]

    def peek() -> str:
        return tokens[here[0]][0] if here[0] < len(tokens) else ""

    def take() -> tuple:
        if here[0] >= len(tokens):
            raise ValueError("the query ends too early")
        here[0] += 1
        return tokens[here[0] - 1]

    def unit(columns: tuple[str, ...] = COLUMNS) -> Node | None:
        token = take()
        if token[0] == "column":
            return unit((token[1],))
        if token[0] == "(":
            inner = either()
            if take()[0] != ")":
                raise ValueError("a parenthesis is open")
            return inner
        if token[0] != "leaf":
            raise ValueError(f"unexpected {token[0]}")
        words = T.phrase(token[1])
        if not words:
            return None
        leaves.append((words, token[2], columns))
        return ("leaf", len(leaves) - 1)

    def chain(kind: str, part, more) -> Node | None:
        node = part()
        while more():
            if peek() == kind:
                take()
            right = part()
            node = node if right is None else right if node is None and kind != "NOT" else (kind, node, right)
        return node

    def without() -> Node | None:
        return chain("NOT", unit, lambda: peek() == "NOT")

    def both() -> Node | None:
        return chain("AND", without, lambda: peek() in ("AND", "leaf", "column", "("))

    def either() -> Node | None:
        return chain("OR", both, lambda: peek() == "OR")

    tree = either() if tokens else None
    if here[0] < len(tokens):
        raise ValueError(f"unexpected {peek()}")
    return tree, leaves


def search_extractions(extractions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Rows of extractions with bm25 and rank: statistics over all rows, a row's length is that of both columns."""
    tree, leaves = parse_query(query)
    limit = limit if limit > 0 else 10
    if tree is None:
        return extractions.where("false").withColumns({"bm25": F.lit(0.0), "rank": F.lit(0)})
    words = extractions.select("id", *[T.word_string(F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS])
    spaces: Column = sum((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) for c in COLUMNS), F.lit(0))

    def count(words: str, prefix: bool, columns: tuple[str, ...]) -> Column:
        own = [F.regexp_count(c, F.lit(words.rstrip() + "[^ ]* ")) if prefix else T.occurrences(F.col(c), words) for c in columns]
        return sum(own[1:], own[0])

    counts = words.select("id", (spaces / 2 - len(COLUMNS)).cast("int").alias("len"), *[count(*leaf).alias(f"tf{i}") for i, leaf in enumerate(leaves)])
    stats = counts.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(leaves))])

    def keep(node: Node) -> Column:
        if node[0] == "leaf":
            return F.col(f"tf{node[1]}") > 0
        if node[1] is None:  # nothing to subtract from
            return F.lit(False)
        a, b = keep(node[1]), keep(node[2])
        return a & b if node[0] == "AND" else a | b if node[0] == "OR" else a & ~b

    score: Column = F.lit(0.0)
    for i in range(len(leaves)):
        tf, n = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("N") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    top = counts.where(keep(tree)).crossJoin(F.broadcast(stats)).select(F.col("id").alias("uuid"), F.round(score, 9).alias("bm25"))
    top = ranked(top.orderBy(F.desc("bm25"), "uuid").limit(limit), "rank", "bm25").withColumnRenamed("uuid", "id")
    return extractions.join(F.broadcast(top), "id")


def find_sidecars(documents: DataFrame, listing: DataFrame, folder: str = ".extractions") -> DataFrame:
    """path, sidecar: ``<ancestor>/<folder>/<hash>.jsonl`` of the deepest ancestor that has one.

    ``documents``: path, hash (or the frontmatter's hash); ``listing``: path of every file. One equi-join on the
    candidate's name; a document has as many candidates as its path has parts.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = documents.select("path", F.posexplode(above).alias("depth", "up"), "hash").select("path", "depth", F.concat("up", F.lit(f"/{folder}/"), "hash", F.lit(".jsonl")).alias("sidecar"))
    there = listing.where(F.col("path").endswith(".jsonl")).select(F.col("path").alias("sidecar")).distinct()
    return tried.join(there, "sidecar").groupBy("path").agg(F.max_by("sidecar", "depth").alias("sidecar"))


def infer_documents(sidecars: DataFrame, documents: DataFrame) -> DataFrame:
    """sidecar, path of the first document whose hash is the sidecar's file stem."""
    stem = sidecars.select(F.col("path").alias("sidecar"), F.regexp_extract("path", r"([0-9a-f]{64})\.jsonl$", 1).alias("hash"))
    return stem.where(F.col("hash") != "").join(documents.select("path", "hash"), "hash").groupBy("sidecar").agg(F.min("path").alias("path"))


def delete_extractions(extractions: DataFrame, paths: DataFrame) -> DataFrame:
    return extractions.join(paths.select(F.col("path").alias("document_path")).distinct(), "document_path", "left_anti").select(extractions.columns)


def import_extractions(stored: DataFrame, fresh: DataFrame, chunks: DataFrame, producer: str = "sidecar", source: str = "") -> DataFrame:
    """``stored`` with the rows of every document in ``fresh`` (id, document_path, class, value, evidence_text,
    span_start, span_end, matched) replaced; each row with a span gets the chunk that holds its middle."""
    placed = span_chunks(fresh.where("span_start is not null and span_end is not null"), chunks)
    rows = fresh.join(placed, "id", "left").withColumns({"producer": F.lit(producer), "source_ref": F.lit(source), "created_at": F.current_timestamp()})
    own = [c for c in stored.columns if c in rows.columns]
    kept = delete_extractions(stored, fresh.select(F.col("document_path").alias("path")))
    return kept.unionByName(rows.select(own), allowMissingColumns=True)
