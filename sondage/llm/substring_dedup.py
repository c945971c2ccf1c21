"""Substring dedup (8): collinear chaining of shared k-mer seeds, then alignment.

Seeds are all word k-mers. One that occurs more than once links each later occurrence, by (doc_id, position), to its
first and to its previous one: two links at most, whatever the number of occurrences. K-mers and links travel packed,
in buckets by hash and by document, whose number follows the size of the texts. The links of a document are chained per reference: co-linear seeds with a linear gap
cost, best predecessors from a Fenwick tree of prefix maxima. Chains of any length over all references are merged where
they touch; those of stretches of ``LEAST_WORDS`` words or more are aligned on the texts of both documents: banded edit
distance between seeds, and extension at both ends while words agree. So a run of words of which one earlier document
has the whole is found wherever its parts came first; a changed stretch is bridged where the seeds at both its sides have
their first or their previous occurrence in one document.

The passages of a document, over all partners, are merged where they touch; merged passages of ``LEAST_WORDS`` words
or more are the result: doc_id, start_word, end_word, start_char, end_char, words, edits (of its longest alignment),
refs (documents that have it, or ``LEAST_CHAIN`` words of it, earlier). ``cut`` removes them from the texts.

Words are runs without white space, lower-cased. Null and empty texts have no passage. Null ids come last in order.
Rows with equal id and text are one document. A passage that repeats inside one document is found as well (the
document is then its own reference). Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, small_batches, spool, text_or_empty
from sondage.llm.packed import LEAST_BITS, bits_for, packed, unpacked

K = 6
WINDOW = 15
LEAST_CHAIN = 20
LEAST_WORDS = 50
GAP_COST = 0.1
MAX_GAP = 40
BAND = 16
CHUNK = 1 << 20
_WORD = re.compile(r"\S+")
_C = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """64-bit hashes of the words of texts, cached up to a bound."""

    def __init__(self, most: int = 400_000):
        self.cache: dict[str, bytes] = {}
        self.most = most

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.lower().split() if text else []
        found = list(map(self.cache.get, words))
        if None in found:
            fresh = {w: xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass")) for w, f in zip(words, found) if f is None}
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            if len(self.cache) + len(fresh) > self.most:
                self.cache.clear()
            if len(fresh) <= self.most:
                self.cache.update(fresh)
        return np.frombuffer(b"".join(found), ">u8").astype(np.uint64)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(31))) * _C[0] + words[i : i + n] * _C[1]
    h = (h ^ (h >> np.uint64(32))) * _C[2]
    return h ^ (h >> np.uint64(29))


def minimizers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash (leftmost) of each window; of the whole if there are fewer."""
    if len(h) <= window:
        return np.asarray([int(h.argmin())]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + views.argmin(axis=1))


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def top(self, end: int) -> tuple[float, int]:
        """Of places before ``end``."""
        found = (float("-inf"), -1)
        while end > 0:
            found = max(found, self.best[end])
            end -= end & -end
        return found


def chain(seeds: list[tuple[int, int]], k: int = K, cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int]]]:
    """Best disjoint chains of seeds (own position, reference position), best first.

    A chain scores ``k`` for each seed less ``cost`` for each word of both gaps; one with a gap over ``max_gap`` is cut there.
    """
    seeds = sorted(set(seeds))
    if len({a - b for a, b in seeds}) == 1:
        found = [seeds]
    else:
        refs = sorted({b for _, b in seeds})
        tree, score, back = Fenwick(len(refs)), [0.0] * len(seeds), [-1] * len(seeds)
        at = 0
        while at < len(seeds):
            end = at
            while end < len(seeds) and seeds[end][0] == seeds[at][0]:
                a, b = seeds[end]
                value, item = tree.top(bisect_left(refs, b))
                gain = value - cost * (a + b)
                score[end] = k + max(0.0, gain)
                back[end] = item if gain > 0 else -1
                end += 1
            for i in range(at, end):
                a, b = seeds[i]
                tree.put(bisect_left(refs, b), score[i] + cost * (a + b), i)
            at = end
        used, found = [False] * len(seeds), []
        for i in sorted(range(len(seeds)), key=lambda i: (-score[i], seeds[i])):
            own: list[tuple[int, int]] = []
            while i >= 0 and not used[i]:
                used[i] = True
                own.append(seeds[i])
                i = back[i]
            if own:
                found.append(own[::-1])
    out = []
    for own in found:
        cut = [0, *(i for i in range(1, len(own)) if max(own[i][0] - own[i - 1][0], own[i][1] - own[i - 1][1]) > max_gap), len(own)]
        out += [own[a:b] for a, b in zip(cut, cut[1:])]
    return out


def _distance(a: np.ndarray, b: np.ndarray, band: int = BAND) -> int:
    """Banded word edit distance (the longer length if the lengths differ by more than the band)."""
    if len(a) == len(b) and (a == b).all():
        return 0
    if not len(a) or not len(b) or abs(len(a) - len(b)) > band:
        return max(len(a), len(b))
    big = 1 << 20
    row = {j: j for j in range(min(len(b), band) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            best = row.get(j, big) + 1
            if j:
                best = min(best, new.get(j - 1, big) + 1, row.get(j - 1, big) + int(a[i - 1] != b[j - 1]))
            new[j] = best
        row = new
    return row.get(len(b), max(len(a), len(b)))


def align(own: np.ndarray, ref: np.ndarray, seeds: list[tuple[int, int]], k: int = K) -> tuple[int, int, int]:
    """(start, end, edits) of the passage in ``own``."""
    edits, (a, b) = 0, seeds[0]
    end, ref_end = a + k, b + k
    for x, y in seeds[1:]:
        if x - end == y - ref_end or (x >= end and y >= ref_end):
            if x > end:
                edits += _distance(own[end:x], ref[ref_end:y])
        else:
            edits += abs((x - end) - (y - ref_end))
        end, ref_end = max(end, x + k), max(ref_end, y + k)
    n = min(a, b)
    same = np.flatnonzero(own[a - n : a][::-1] != ref[b - n : b][::-1])
    start = a - (int(same[0]) if len(same) else n)
    n = min(len(own) - end, len(ref) - ref_end)
    same = np.flatnonzero(own[end : end + n] != ref[ref_end : ref_end + n])
    return start, end + (int(same[0]) if len(same) else n), edits


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("doc_id", "text", F.isnull("doc_id")))


def ordered(docs: DataFrame) -> DataFrame:
    """``keyed`` with rank: the id where ids are distinct, else a number in order of (id, key), nulls last."""
    found = keyed(docs)
    ids = found.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return found.withColumn("rank", F.col("doc_id"))
    spark = docs.sparkSession
    order = found.select("doc_id", "key").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "key")
    numbers = spool(spark.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (x[0]["key"], x[1])), "key long, rank long"))
    return found.join(numbers, "key").select("doc_id", "text", "key", "rank")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def scan(batches: Iterator[pa.RecordBatch], bits: int = LEAST_BITS) -> Iterator[pa.RecordBatch]:
    """All k-mers of text, rank: bucket, hashes, ranks, positions."""
    words, hashes, ranks, size = Words(), [], [], 0

    def out() -> pa.RecordBatch:
        h = np.concatenate(hashes)
        at = np.concatenate([np.arange(len(x), dtype=np.uint32) for x in hashes])
        return packed((h >> np.uint64(64 - bits)).astype(np.int32), [h, np.repeat(np.asarray(ranks, np.int64), [len(x) for x in hashes]), at])

    for batch in batches:
        for text, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = kmers(words.of(text))
            if len(h):
                hashes.append(h)
                ranks.append(rank)
                size += len(h)
            if size >= CHUNK:
                yield out()
                hashes, ranks, size = [], [], 0
    if hashes:
        yield out()


def star(h: np.ndarray, rank: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """rank, at, ref_rank, ref_at: of a bucket's k-mers, every later place with the first and with the previous place of the k-mer."""
    least = np.sort(h)
    twice = least[1:][least[1:] == least[:-1]]
    if len(twice):
        use = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        h, rank, at = h[use], rank[use], at[use]
    else:
        h, rank, at = h[:0], rank[:0], at[:0]
    order = np.lexsort((at, rank, h))
    h, rank, at = h[order], rank[order], at[order]
    place = _starts(h, rank, at)  # repeated rows
    h, rank, at = h[place], rank[place], at[place]
    new, i = _starts(h), np.arange(len(h))
    first = np.maximum.accumulate(np.where(new, i, 0)) if len(h) else i
    later = i[~new]
    other = later[later - 1 != first[later]]
    own, ref = np.concatenate([later, other]), np.concatenate([first[later], other - 1])
    return [rank[own], at[own], rank[ref], at[ref]]


def link(batches: Iterator[pa.RecordBatch], bits: int = LEAST_BITS) -> Iterator[pa.RecordBatch]:
    """``star`` of every bucket, packed by document."""
    held: list[list[np.ndarray]] = []

    def out() -> pa.RecordBatch:
        rank, at, ref, ref_at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, rank))
        mixed = (rank[order].astype(np.uint64) * _C[0]) >> np.uint64(64 - bits)
        return packed(mixed.astype(np.int32), [rank[order], at[order], ref[order], ref_at[order]])

    for columns in unpacked(batches, [np.uint64, np.int64, np.uint32]):
        held.append(star(*columns))
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield out()
            held = []
    if held:
        yield out()


def seed_links(docs: DataFrame) -> DataFrame:
    """bucket of a document, and packed links of its seeds: rank, at, ref_rank, ref_at."""
    bits = bits_for(docs)
    found = docs.select("text", "rank").mapInArrow(lambda batches: scan(batches, bits), "bucket int, c0 binary, c1 binary, c2 binary")
    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: link(batches, bits), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")


def covering(rank: np.ndarray, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, least: int) -> list[tuple[int, int, list[list[int]]]]:
    """(rank, ref_rank, chains) of links: the chains that make up repeated stretches of ``least`` words or more.

    Stretches are merged over all references before they are measured; a chain inside another one's words is left out.
    """
    at, ref_at = at.astype(np.int64), ref_at.astype(np.int64)
    # Passages lie inside runs of links with gaps of up to MAX_GAP; shorter ones go unseen by Python.
    order = np.lexsort((at, rank))
    rank, at, ref, ref_at = rank[order], at[order], ref[order], ref_at[order]
    new = _starts(rank)
    new[1:] |= at[1:] - at[:-1] > MAX_GAP
    first = np.flatnonzero(new)
    sizes = np.diff([*first, len(at)])
    use = np.repeat(at[first + sizes - 1] + K - at[first] >= least, sizes) if len(first) else new
    rank, at, ref, ref_at = rank[use], at[use], ref[use], ref_at[use]
    if not len(rank):
        return []
    order = np.lexsort((at, ref_at - at, ref, rank))
    rank, at, ref, ref_at = rank[order], at[order], ref[order], ref_at[order]
    new = _starts(rank, ref, ref_at - at)
    new[1:] |= at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    sizes = np.diff([*first, len(at)])
    # Seeds of a run of equal words that share no word stand for it, and its end goes with each.
    keep = (np.arange(len(at)) - np.repeat(first, sizes)) % K == 0
    ends = np.repeat(at[first + sizes - 1] + K, sizes)[keep]
    rank, at, ref, ref_at = rank[keep], at[keep], ref[keep], ref_at[keep]
    pair = np.flatnonzero(_starts(rank, ref))
    stops = [*pair[1:].tolist(), len(at)]
    diagonal = ref_at - at
    flat = np.maximum.reduceat(diagonal, pair) == np.minimum.reduceat(diagonal, pair)
    heads = _starts(rank, ref)
    heads[1:] |= at[1:] - at[:-1] > MAX_GAP
    chains: list[tuple[int, int, int, int, list[int]]] = []
    a_list, r_list, e_list = at.tolist(), ref_at.tolist(), ends.tolist()
    for a, b, own, other, even in zip(pair.tolist(), stops, rank[pair].tolist(), ref[pair].tolist(), flat.tolist()):
        if b - a == 1:
            chains.append((own, other, a_list[a], e_list[a], [a_list[a], r_list[a]]))
        elif even:
            cuts = [*(a + np.flatnonzero(heads[a:b])).tolist(), b]
            for x, y in zip(cuts, cuts[1:]):
                chains.append((own, other, a_list[x], e_list[y - 1], [v for z in range(x, y) for v in (a_list[z], r_list[z])]))
        else:
            end_of = dict(zip(zip(a_list[a:b], r_list[a:b]), e_list[a:b]))
            for c in chain(list(end_of)):
                chains.append((own, other, c[0][0], max(end_of[x] for x in c), [v for x in c for v in x]))
    doc, start, end = (np.asarray([c[i] for c in chains], np.int64) for i in (0, 2, 3))
    order = np.lexsort(([c[1] for c in chains], -end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = (np.cumsum(_starts(doc)) - 1) * (int(end.max()) + 2)
    start, end = start + shift, end + shift
    reach = np.maximum.accumulate(end)
    before = np.concatenate(([-1], reach[:-1]))
    group = np.flatnonzero(start > before)
    sizes = np.diff([*group, len(start)])
    good = np.repeat(reach[group + sizes - 1] - start[group] >= least, sizes) & (end > before)
    out: dict[tuple[int, int], list[list[int]]] = {}
    for i in order[good].tolist():
        out.setdefault(chains[i][:2], []).append(chains[i][4])
    return [(own, other, c) for (own, other), c in out.items()]


def passages(docs: DataFrame, least_chain: int = LEAST_CHAIN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Merged repeated passages with the document's key; see the module for the columns."""
    small_batches(docs.sparkSession)
    docs = ordered(docs)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in unpacked(batches, [np.int64, np.uint32, np.int64, np.uint32]):
            rows = covering(*links, max(least_chain, least_words))
            columns = list(zip(*rows)) if rows else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rank", "ref_rank", "chains"])

    links = seed_links(docs).repartition("bucket").sortWithinPartitions("bucket")
    pairs = spool(links.mapInArrow(chains, "rank long, ref_rank long, chains array<array<int>>"))
    needed = pairs.select("rank").unionByName(pairs.select(F.col("ref_rank").alias("rank"))).distinct()
    texts = spool(docs.join(needed, "rank", "left_semi").dropDuplicates(["rank"]))
    refs = texts.select(F.col("rank").alias("ref_rank"), F.col("doc_id").alias("ref_id"), F.col("text").alias("ref_text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for key, ref_id, found, own, ref in zip(*(batch.column(i).to_pylist() for i in range(5))):
                x, y = words.of(own), words.of(ref)
                for c in found:
                    s, e, edits = align(x, y, list(zip(c[::2], c[1::2])))
                    rows.append((key, ref_id, s, e, edits))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "ref_id", "s", "e", "edits"])

    both = pairs.join(texts.select("rank", "key", "text"), "rank").join(refs, "ref_rank").select("key", "ref_id", "chains", "text", "ref_text")
    spans = both.mapInArrow(aligned, "key long, ref_id long, s int, e int, edits int").groupBy("key").agg(F.collect_set(F.struct("s", "e", "edits", "ref_id")).alias("spans"))

    def wide(own: list) -> list:
        return [x for x in own if x["e"] - x["s"] >= least_chain] or own

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                groups: list[list] = []
                for x in sorted(spans, key=lambda x: (x["s"], x["e"])):
                    if groups and x["s"] <= groups[-1][1]:
                        groups[-1][1] = max(groups[-1][1], x["e"])
                        groups[-1][2].append(x)
                    else:
                        groups.append([x["s"], x["e"], [x]])
                at = None
                for s, e, own in groups:
                    if e - s >= least_words:
                        at = at or [m.span() for m in _WORD.finditer(text)]
                        rows.append((key, doc_id, s, e, at[s][0], at[e - 1][1], e - s, min((x["s"] - x["e"], x["edits"]) for x in own)[1], sorted({x["ref_id"] for x in wide(own) if x["ref_id"] is not None})))
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int64()))
            names = ["key", "doc_id", "start_word", "end_word", "start_char", "end_char", "words", "edits", "refs"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "key long, doc_id long, start_word int, end_word int, start_char int, end_char int, words int, edits int, refs array<long>"
    return texts.join(spans, "key").select("key", "doc_id", "text", "spans").mapInArrow(merged, schema)


def cut(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without their repeated passages."""
    spans = passages(docs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("__spans"))
    key = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty(), F.isnull("doc_id"))
    joined = docs.withColumn("__key", key).join(spans.withColumnRenamed("key", "__key"), "__key", "left")
    text = F.aggregate(
        "__spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start_char"] - s["at"])).alias("out"), x["end_char"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir)).drop("key")
