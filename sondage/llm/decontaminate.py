"""Benchmark decontamination (5): q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

A document holds an item if some region of it is within ``k = floor(rate * length)`` edits of the whole item. Texts
are lower-cased and ASCII punctuation and white space count as one symbol, byte for byte. By the q-gram lemma such a
region shares at least ``length - q + 1 - k * q`` of the item's q-grams, all on diagonals that lie at most ``k`` apart.
Diagonals are cut into bands of ``k + 1`` that overlap by as many, so one band holds them all: bands with enough
distinct shared q-grams are kept, all others are dropped without loss, and a banded alignment confirms the rest.

A benchmark of up to ``BLOCK_BYTES`` is one q-gram index, broadcast (its size is bounded by that) and scanned map-side
over whole texts. A larger one is cut into such blocks, one broadcast at a time: a first scan of all documents writes
those that have a q-gram of any item (a bit table of 16 bits a byte of the benchmark, 128 MB at most), and only these are
scanned for each block. Documents are never shuffled for the search nor broadcast. Long texts are read in windows that overlap by the
longest item and its edits. q-grams that thousands of items share (common question stems) cost memory only in
proportion to the index: items are counted per text before their positions are expanded.

Items with null or blank texts are skipped; items shorter than ``q`` or whose budget leaves no q-gram are held to the
largest budget that the lemma still covers (at least an exact match). Null texts hold nothing. Repeated rows and null
ids give rows of their own. Result: doc_id, item_id, start, length (code points of the document), edits, the best
region per document row and item. Other columns are ignored; ``clean`` drops the documents found and keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, small_batches, spool, text_or_empty, unspool

Q = 12
RATE = 0.05
BLOCK_BYTES = 4 << 20
BITS = 21
WINDOW_BYTES = 1 << 16
GROUP_BYTES = 1 << 20
EXPAND = 1 << 21
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(text: str) -> bytes:
    """As many code points as ``text``; equal bytes for what counts as equal."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "replace").translate(_FOLD)


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the 12-grams that start at each byte."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        eight[k::8] = part[: len(eight[k::8])]
    low = eight[8 : 8 + n] & np.uint64(0xFFFFFFFF)
    h = eight[:n] * _M1
    h ^= h >> np.uint64(29)
    h += low
    h *= _M2
    return h


def budgets(lengths: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Edits that items of these lengths may have, and q-grams that then are shared at least."""
    k = np.minimum((rate * lengths).astype(np.int64), np.maximum((lengths - Q) // Q, 0))
    return k, lengths - Q + 1 - k * Q


class Index:
    """q-grams of a block of items: each once, with the (item, position) entries that have it, and each item's own entries."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.items = items
        lengths = np.asarray([len(b) for _, b in items], np.int64)
        self.k, self.need = budgets(lengths, rate)
        self.longest = int((lengths + self.k).max()) if len(items) else 0
        hashes = [grams(np.frombuffer(b, np.uint8)) for _, b in items]
        self.short = [i for i, b in enumerate(lengths) if b < Q]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        sizes = [len(x) for x in hashes]
        item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if hashes else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.item, h = item[order], h[order]
        self.h, self.first, self.n = np.unique(h, return_index=True, return_counts=True)
        gram = np.repeat(np.arange(len(self.h), dtype=np.int32), self.n)
        own = np.argsort(self.item, kind="stable")  # by item, then gram
        self.own_gram, self.own_at = gram[own], at[order][own]
        self.own_first = np.concatenate(([0], np.cumsum(sizes))) if sizes else np.zeros(1, np.int64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.h >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def windows(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(text, offset, bytes) in groups of about ``GROUP_BYTES``; each region of an item's length lies inside one window."""
        step = max(WINDOW_BYTES, 4 * self.longest)
        group, size = [], 0
        for d, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.longest), step):
                group.append((d, at, text if len(text) <= step else text[at : at + step + self.longest]))
                size += len(group[-1][2])
                if size >= GROUP_BYTES:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lowest and highest diagonal) of the bands that pass the lemma.

        Memory is bounded by the texts, the index and ``EXPAND``, whatever the number of items that share q-grams: first
        each item's positions whose q-gram occurs anywhere in a text are counted, a text at a time; bands are counted
        only for the items that have enough of them.
        """
        for i in self.short:
            for d, t in enumerate(texts):
                p = t.find(self.items[i][1])
                if p >= 0:
                    yield d, i, p, p
        if not len(self.h):
            return
        sizes = np.asarray([len(t) + 1 for t in texts], np.int64)
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # folded text holds no \n, so no q-gram crosses texts
        h = grams(data)
        hit = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).view(np.int64)])
        where = np.searchsorted(self.h, h[hit])
        where[where == len(self.h)] = 0
        same = self.h[where] == h[hit]
        hit, where = hit[same], where[same]
        if not len(hit):
            return
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, hit, "right")
        pos = hit - (ends[doc] - sizes[doc])
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d, i in self._sharing(doc, where):
            a, b = first[d], first[d + 1]
            for band in self._bands(i, where[a:b], pos[a:b]):
                w = int(self.k[i]) + 1
                yield d, i, band * w, (band + 2) * w - 1

    def _sharing(self, doc: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) where enough of the item's positions have a q-gram that the text has."""
        key = np.unique(doc * len(self.h) + where)
        doc, gram = key // len(self.h), key % len(self.h)
        ends = np.cumsum(self.n[gram])
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        a = 0
        while a < len(starts):
            base = ends[starts[a]] - self.n[gram[starts[a]]]
            b = a + 1  # whole texts: one text has no more entries than the index
            while b < len(starts) and ends[(starts[b + 1] if b + 1 < len(starts) else len(doc)) - 1] - base <= EXPAND:
                b += 1
            x, y = starts[a], starts[b] if b < len(starts) else len(doc)
            n = self.n[gram[x:y]]
            slot = np.repeat(self.first[gram[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item = self.item[slot]
            pair, count = np.unique(np.repeat(doc[x:y], n) * len(self.items) + item, return_counts=True)
            pair = pair[count >= self.need[pair % len(self.items)]]
            yield from zip((pair // len(self.items)).tolist(), (pair % len(self.items)).tolist())
            a = b

    def _bands(self, i: int, where: np.ndarray, pos: np.ndarray) -> list[int]:
        """Bands of item ``i`` in which enough of its positions have a hit."""
        a, b = self.own_first[i], self.own_first[i + 1]
        gram, at = self.own_gram[a:b], self.own_at[a:b].astype(np.int64)
        low, high = np.searchsorted(gram, where, "left"), np.searchsorted(gram, where, "right")
        n = high - low
        use = np.flatnonzero(n)
        low, n, pos = low[use], n[use], pos[use]
        width, length = int(self.k[i]) + 1, int(b - a)
        found = np.zeros(0, np.int64)  # band * length + position, distinct
        step, ends = 0, np.cumsum(n)
        while step < len(n):
            stop = max(step + 1, int(np.searchsorted(ends, ends[step] - n[step] + EXPAND, "right")))
            m = n[step:stop]
            slot = np.repeat(low[step:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            own = at[slot]
            band = np.floor_divide(np.repeat(pos[step:stop], m) - own, width)
            # Band b has the diagonals [b * width, (b + 2) * width).
            found = np.unique(np.concatenate([found, (band + length) * length + own, (band - 1 + length) * length + own]))
            step = stop
        bands, count = np.unique(found // length, return_counts=True)
        return (bands[count >= self.need[i]] - length).tolist()


def align(item: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of ``text`` on the diagonals [low, high], None above ``k`` edits."""
    p = text.find(item, max(0, low), max(0, high + len(item)))
    if p >= 0:
        return 0, p, p + len(item)
    if k == 0:
        return None
    low, high = low - k, high + k
    a, width = np.frombuffer(item, np.uint8), high - low + 1
    base = np.zeros(len(item) + width + 1, np.int16)  # text[low + x]; -1 outside
    base -= 1
    s, e = max(0, low), min(len(text), low + len(base))
    if s < e:
        base[s - low : e - low] = np.frombuffer(text[s:e], np.uint8)
    big, steps = 1 << 14, np.arange(width)
    # Cell x of row i: item[:i] against a region that ends before text[i + low + x].
    ends = low + steps
    row = np.where((ends >= 0) & (ends <= len(text)), 0, big)
    start = ends.copy()
    for i in range(1, len(a) + 1):
        cost = row + (base[i - 1 : i - 1 + width] != a[i - 1])
        up = np.append(row[1:], big) + 1
        take = up < cost
        cost = np.where(take, up, cost)
        start = np.where(take, np.append(start[1:], 0), start)
        cost = np.where((i + ends >= 0) & (i + ends <= len(text)), cost, big)
        slack = cost - steps
        best = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == best, steps, 0))
        row, start = best + steps, start[source]
        if row.min() > k:
            return None
    x = int(row.argmin())
    return (int(row[x]), int(start[x]), len(a) + low + x) if row[x] <= k else None


def folded_items(benchmark: DataFrame) -> Iterator[tuple[int, bytes]]:
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        data = fold(row["text"]).strip()
        if data:
            yield row["item_id"], data


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    block: list[tuple[int, bytes]] = []
    size = 0
    for item in folded_items(benchmark):
        block.append(item)
        size += len(item[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


class Sieve:
    """Bits of all items' q-grams: a text that holds an item has at least ``need`` q-grams with a set bit (exact for short items)."""

    def __init__(self, items: Iterator[tuple[int, bytes]], size: int, rate: float):
        self.shift = np.uint64(64 - max(BITS, min(30, (16 * size).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)) - 3, np.uint8)
        self.need, self.short = 1 << 62, False
        for _, data in items:
            if len(data) < Q:
                self.short = True
                continue
            h = grams(np.frombuffer(data, np.uint8)) >> self.shift
            np.bitwise_or.at(self.bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
            self.need = min(self.need, int(budgets(np.asarray([len(data)]), rate)[1][0]))

    def passes(self, text: bytes) -> bool:
        if self.short:
            return True
        h = grams(np.frombuffer(text, np.uint8)) >> self.shift
        hit = h[(self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        # An item may repeat a q-gram: its positions count, so occurrences do.
        return len(hit) >= min(self.need, 1)


def row_key(doc_id: str = "doc_id") -> Column:
    """128 bits of id and text; rows that are equal in both share it."""
    return F.md5(F.concat_ws("\n", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), text_or_empty()))


def sieved(docs: DataFrame, benchmark: DataFrame, size: int, rate: float) -> DataFrame:
    """doc_id, text, key of the rows that may hold an item of any block, written to the shared folder: one scan of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(Sieve(folded_items(benchmark), size, rate))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.passes(fold(t)) for t in batch.column(1).to_pylist()], pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), row_key().alias("key"))
    out = spool(own.mapInArrow(keep, own.schema))
    shared.unpersist()
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return _find(docs, benchmark, rate, block_bytes, False).select("doc_id", "item_id", "start", "length", "edits")


def _find(docs: DataFrame, benchmark: DataFrame, rate: float, block_bytes: int, keyed: bool) -> DataFrame:
    """Hits; with ``keyed`` or more than one block they have the row key too."""
    spark = docs.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        items = list(folded_items(benchmark))
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (row_key() if keyed else F.lit("")).alias("key"))
        return _scan(own, spark.sparkContext.broadcast(Index(items, rate)))
    left = sieved(docs, benchmark, size, rate)
    found = []
    for block in item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Index(block, rate))
        found.append(spool(_scan(left, shared)))
        shared.unpersist()
    unspool(left)
    out = spark.createDataFrame([], HITS)
    for part in found:
        out = out.unionByName(part)
    return out


HITS = "key string, doc_id long, item_id long, start int, length int, edits int"


def _regions(index: Index, folded: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(edits, start, end) of the best region by (text, item)."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for group in index.windows(folded):
        for w, i, low, high in index.candidates([x[2] for x in group]):
            d, offset, text = group[w]
            if best.get((d, i), (1,))[0] == 0:
                continue
            region = align(index.items[i][1], text, low, high, int(index.k[i]))
            if region:
                region = (region[0], region[1] + offset, region[2] + offset)
                if region < best.get((d, i), (1 << 30,)):
                    best[d, i] = region
    return best


def _scan(docs: DataFrame, shared) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            ids, texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            folded = [fold(t) for t in texts]
            rows = []
            for (d, i), (edits, s, e) in sorted(_regions(index, folded).items()):
                chars = [len(folded[d][x:y].decode("utf-8", "ignore")) for x, y in ((0, s), (s, e))]
                rows.append((keys[d], ids[d], index.items[i][0], *chars, edits))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["key", "doc_id", "item_id", "start", "length", "edits"],
            )

    return docs.mapInArrow(scan, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that hold no item, with their columns passed through.

    One block: decided map-side. More blocks: the hits of all blocks are written first, then their rows are left out by key.
    """
    small_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        bad = _find(docs, benchmark, rate, block_bytes, True).select(F.col("key").alias("__key")).distinct()
        return docs.withColumn("__key", row_key()).join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(Index(list(folded_items(benchmark)), rate))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            folded = [fold(t or "") for t in batch.column(at).to_pylist()]
            bad: set[int] = set()
            for group in index.windows(folded):
                for w, i, low, high in index.candidates([x[2] for x in group]):
                    d, _, text = group[w]
                    if d not in bad and align(index.items[i][1], text, low, high, int(index.k[i])):
                        bad.add(d)
            yield batch.filter(pa.array([d not in bad for d in range(len(folded))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
