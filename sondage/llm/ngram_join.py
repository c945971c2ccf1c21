"""N-gram Jaccard join (2): token-combination prefixes, then exact verification.

A document's set is its distinct word n-grams (64-bit hashes); equal sets are one class (64-bit hash of the set).
Classes link when ``DEN * intersection >= NUM * union``.

Prefix filter: under one global token order, sets of n tokens that link share a token among their first
``p = n - ceil(t * n) + 1``. The order puts frequent tokens last: those that ``HOT_COUNT`` or more sets have among their
first tokens by hash, counted over all sets. They are broadcast as a table of bits by hash (32 MB at most), in which up to
one rare token in four may look frequent: where it holds ``HOT_TOKENS``, the count that makes a token frequent doubles.
Rare tokens of a prefix are indexed alone. A prefix that reaches frequent tokens is extended by ``e`` of them, and its frequent tokens are indexed as pairs: they are dealt into e groups, two
linked sets that share no rare token share at least 1 + e frequent ones there, so two fall into one group and their
combination is shared. ``e`` depends on a band of set sizes; a set is indexed for its own band and the next one, which
covers every pair that can link. Which tokens count as frequent changes the cost only, never the result.

Index lists are read once, sorted by (signature, class), in bounded memory. A list of up to ``LIST`` classes gives all
its pairs; a longer one gives only a star to its first class. Pairs are verified on whole texts. The long lists with
one first class are a cluster, so lists that merely share some class stay apart. Classes that verification hasn't put into
their cluster's largest component are then searched, in blocks, against all classes of the cluster: first by size and
sketch, and those that have a near class in another component on whole texts. So no link between components is lost and
no group emits all its pairs. Components come from distributed label propagation.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. Fewer words than ``ngram``: the whole sequence is one token. Null and blank
texts have an empty set and link with nothing, not even each other. Repeated rows and ids keep their rows; a null id
never names a component if another id does. Empty tables give an empty result; other columns are ignored
(``keep_one`` passes them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, shuffle_parts, small_batches, spool, text_or_empty
from sondage.llm.graph import components
from sondage.llm.packed import bits_for, packed, unpacked

NGRAM, NUM, DEN = 5, 80, 100
LIST = 32
HOT_BITS = 28
HOT_TOKENS = 1 << (HOT_BITS - 2)
HOT_SLICES = 10
HOT_COUNT = 4
EARLY = 1.5
BLOCK_TOKENS = 200_000
BLOCK_SKETCHES = 4096
EXPAND = 1 << 21
CACHE_TOKENS = 1 << 21
BROADCAST_COMPONENTS = 200_000
BUCKET_BITS = 10
SKETCH_BITS = 1024
_C = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[5]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct n-gram hashes of texts; word hashes are cached, up to a bound."""

    def __init__(self, ngram: int, cache_words: int = 500_000):
        self.ngram, self.limit = ngram, cache_words
        self.cache: dict[bytes, bytes] = {}

    def words(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        found = list(map(self.cache.get, words))
        if None in found:
            fresh = {w: xxhash.xxh3_64_digest(w) for w, f in zip(words, found) if f is None}
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            if len(self.cache) + len(fresh) > self.limit:
                self.cache.clear()
            if len(fresh) <= self.limit:
                self.cache.update(fresh)
        return np.frombuffer(b"".join(found), ">u8").astype(np.uint64)

    def tokens(self, text: str | None) -> np.ndarray:
        w = self.words(text) if text else np.zeros(0, np.uint64)
        k = min(self.ngram, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k if k < self.ngram else 0, np.uint64)
        for i in range(k):
            h = (h ^ (h >> np.uint64(31))) * _C[1] + _mix(w[i : i + len(h)] + _C[i % 8])
        return np.unique(_mix(h))


def class_of(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of ``SKETCH_BITS`` groups of tokens: two sets differ in at least as many tokens as these bits differ."""
    return np.packbits(np.bincount((tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table_bits(tokens: int) -> int:
    """Bits of the number of bits in a table for so many frequent tokens: 16 for each token, as far as ``HOT_BITS`` go."""
    return min(HOT_BITS, max(16, (16 * tokens).bit_length()))


def bit_table(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of 2 ** ``bits`` bits; those that the tokens' first ``bits`` bits name are set."""
    table = np.zeros(1 << bits, bool)
    table[(tokens >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


class Prefixes:
    """Signatures of a set under the order (rare tokens, frequent tokens), each by hash.

    ``hot``: a bit table of the frequent tokens, or the tokens themselves.
    """

    def __init__(self, hot: np.ndarray, num: int, den: int):
        self.hot, self.num, self.den = hot if hot.dtype == np.uint8 else bit_table(hot, table_bits(len(hot))), num, den
        self.shift = np.uint64(64 - (8 * len(self.hot)).bit_length() + 1)
        self.base = math.log(den / num * 1.0001)

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        at = (tokens >> self.shift).astype(np.int64)
        return (self.hot[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def band(self, n: int) -> int:
        return int(math.log(n) / self.base)

    def extension(self, band: int) -> int:
        """Equal for all sets of the band; 0 where a set is too small to be extended."""
        least, most = math.exp(self.base * (band - 1)), math.exp(self.base * (band + 1))
        return max(0, min(int(least * self.num / self.den) - 2, int((1 - self.num / self.den) * most / 3)))

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        p = self.prefix(n)
        hot = self.frequent(tokens)
        rare = tokens[~hot]
        if len(rare) >= p:
            return rare[:p]
        often, out = tokens[hot], [rare]
        for band in (self.band(n), self.band(n) + 1):
            e = self.extension(band)
            own = often[: p + e - len(rare)]
            if e < 1:
                out.append(_mix(own + np.uint64(band + 1)))
                continue
            group = _mix(own ^ _C[2]) % np.uint64(e)
            order = np.argsort(group, kind="stable")
            own, group = own[order], group[order]
            step = 1
            while step < len(own):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                a, b = own[:-step][same], own[step:][same]
                out.append(_mix(_mix(a + np.uint64(band + 1)) * _C[6] + b))
                step += 1
        return np.unique(np.concatenate(out))


def _table(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def row_keys() -> list[Column]:
    """key and key2: 128 bits that tell rows apart by id and text."""
    own = [F.col("doc_id").cast("long"), text_or_empty(), F.isnull("doc_id")]
    return [F.xxhash64(*own).alias("key"), F.xxhash64(F.lit("second"), *own).alias("key2")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, key2."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *row_keys())


def classes(docs: DataFrame, ngram: int, num: int, den: int, bits: int = BUCKET_BITS) -> DataFrame:
    """Rows (0, key, key2, doc_id, class, n) of documents, and rows (1, bucket) of the tasks' early tokens and their counts, packed.

    Early are the first ``EARLY`` x p tokens of a set by hash; only they can be in a prefix, but for what frequent
    tokens make room for.
    """
    prefixes = Prefixes(np.zeros(0, np.uint64), num, den)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["kind", "key", "key2", "doc_id", "class", "n", "tokens", "counts", "sketch"], [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 3]
        shingler, seen = Shingler(ngram), set()
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            dealt = packed((tokens >> np.uint64(64 - bits)).astype(np.int64), [tokens, n.astype(np.uint32)])
            none = pa.nulls(dealt.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * dealt.num_rows, pa.int32()), dealt.column(0).cast(pa.int64()), none, none, none, none, dealt.column(1), dealt.column(2), pa.nulls(dealt.num_rows, pa.binary())], names=names)

        for batch in batches:
            out: list[list] = [[], []]
            sketches: list[bytes | None] = []
            for text in batch.column(1).to_pylist():
                own = shingler.tokens(text)
                c = class_of(own)
                out[0].append(c)
                out[1].append(len(own))
                sketches.append(None)
                if len(own) and c not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
                    sketches[-1] = sketch(own)
                    held.append(own[: int(EARLY * prefixes.prefix(len(own)))])
                    size += len(held[-1])
            yield _table(names, [[0] * len(out[0]), batch.column(2), batch.column(3), batch.column(0), *out, [None] * len(out[0]), [None] * len(out[0]), sketches], kinds)
            if size > 2_000_000:
                yield counts()
                held, size = [], 0
        yield counts()

    return keyed(docs).select("doc_id", "text", "key", "key2").mapInArrow(scan, "kind int, key long, key2 long, doc_id long, class long, n long, tokens binary, counts binary, sketch binary")


def frequent_tokens(early: DataFrame, least: int, most: int) -> np.ndarray:
    """Bit table of the tokens that ``least`` or more sets have among their early ones; ``least`` doubles until ``most`` hold them.

    Tasks make slices of the table, so the driver gets no more than its bytes.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n in unpacked(batches, [np.uint64, np.uint32]):
            found, at = np.unique(tokens, return_inverse=True)
            total = np.bincount(at, n).astype(np.int64)
            use = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(_signed(found[use])), pa.array(total[use])], names=["token", "n"])

    dealt = early.select("key", "tokens", "counts").repartition("key").sortWithinPartitions("key")
    counts = spool(dealt.mapInArrow(add, "token long, n long"))
    while (size := counts.where(F.col("n") >= least).count()) > most:
        least *= 2
    bits = table_bits(size)
    piece = 1 << (bits - HOT_SLICES - 3)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            where = at >> (bits - HOT_SLICES)
            for k in np.unique(where).tolist():
                own = at[where == k] & (8 * piece - 1)
                np.bitwise_or.at(made.setdefault(k, np.zeros(piece, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["slice", "bytes"])

    frequent = counts.where(F.col("n") >= least).select("token", F.shiftrightunsigned("token", 64 - HOT_SLICES).alias("slice"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in frequent.repartition("slice").select("token").mapInArrow(slices, "slice int, bytes binary").collect():
        table[row["slice"] * piece : (row["slice"] + 1) * piece] = np.frombuffer(row["bytes"], np.uint8)
    return table


def candidates(docs: DataFrame, hot: np.ndarray, ngram: int, num: int, den: int) -> DataFrame:
    """a, b (classes), long: pairs of short index lists, and stars of long ones (long = 1)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, prefixes, seen = Shingler(ngram), Prefixes(shared.value, num, den), set()
        for batch in batches:
            sigs, cls, sizes, lens = [], [], [], []
            for text in batch.column(0).to_pylist():
                own = shingler.tokens(text)
                if len(own) and (c := class_of(own)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
                    sigs.append(prefixes.signatures(own))
                    cls.append(c)
                    sizes.append(len(own))
                    lens.append(len(sigs[-1]))
            if sigs:
                yield _table(
                    ["sig", "class", "n"],
                    [_signed(np.concatenate(sigs)), np.repeat(np.asarray(cls, np.int64), lens), np.repeat(np.asarray(sizes, np.int32), lens)],
                    [pa.int64(), pa.int64(), pa.int32()],
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        carry, star = empty, False  # rows of the last list; whether it is known to be long

        def lists(sig, cls, n, last: bool):
            nonlocal carry, star
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sig, cls, n = sig[fresh], cls[fresh], n[fresh]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(sig)))
            long = sizes > LIST
            if star and len(long):
                long[0] = True
            star = False
            if not last and len(first):
                at = first[-1]
                if sizes[-1] > LIST or long[-1]:
                    star = True
                    carry = (sig[at : at + 1], cls[at : at + 1], n[at : at + 1])
                else:
                    carry = (sig[at:], cls[at:], n[at:])
                    first, sizes, long = first[:-1], sizes[:-1], long[:-1]
            left, right = [], []
            for size in np.unique(sizes[~long]):
                if size > 1:
                    rows = first[~long & (sizes == size)]
                    i, j = np.triu_indices(size, 1)
                    left.append((rows[:, None] + i).ravel())
                    right.append((rows[:, None] + j).ravel())
            n_short = sum(map(len, left))
            for at, size in zip(first[long].tolist(), sizes[long].tolist()):
                left.append(np.full(size - 1, at))
                right.append(np.arange(at + 1, at + size))
            if not left:
                return None
            a, b = np.concatenate(left), np.concatenate(right)
            big = np.arange(len(a)) >= n_short
            fits = den * np.minimum(n[a], n[b]).astype(np.int64) >= num * np.maximum(n[a], n[b]).astype(np.int64)
            use = fits | big
            a, b, big, fits = a[use], b[use], big[use], fits[use]
            x = np.stack([cls[a], cls[b], big.astype(np.int64), fits.astype(np.int64)], axis=1)
            return np.unique(x, axis=0) if len(x) < 2_000_000 else x

        def emit(x):
            for at in range(0, len(x), 50_000):
                y = x[at : at + 50_000]
                yield _table(["a", "b", "long", "fits"], list(y.T), [pa.int64()] * 4)

        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            rows += batch.num_rows
            if rows > 200_000:
                x = lists(*(np.concatenate([c, *(h[i] for h in held)]) for i, c in enumerate(carry)), False)
                held, rows = [], 0
                if x is not None:
                    yield from emit(x)
        x = lists(*(np.concatenate([c, *(h[i] for h in held)]) for i, c in enumerate(carry)), True)
        if x is not None:
            yield from emit(x)

    lists = keyed(docs).select("text").mapInArrow(index, "sig long, class long, n int").repartition(4 * shuffle_parts(spark), "sig").sortWithinPartitions("sig", "class")
    found = lists.mapInArrow(pairs, "a long, b long, long long, fits long")
    return found.groupBy("a", "b").agg(F.max("long").alias("long"), F.max("fits").alias("fits"))


def verified(pairs: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, on whole texts. Pairs whose sketches differ in more bits than linked sets can in tokens go first."""
    side = lambda x: texts.select(F.col("class").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            # Linked: den * same >= num * (n - same); the sets differ in n - 2 * same tokens.
            yield batch.select([0, 1]).filter(pa.array((num + den) * apart <= (den - num) * n))

    close = spool(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long"))
    both = close.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cache, held = Shingler(ngram), {}, 0

        def tokens(c: int, text: str) -> np.ndarray:
            nonlocal held
            if c not in cache:
                if len(cache) >= 256 or held > CACHE_TOKENS:
                    cache.clear()
                    held = 0
                cache[c] = shingler.tokens(text)
                held += len(cache[c])
            return cache[c]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for x, y, s, t in zip(a, b, ta, tb):
                u, v = tokens(x, s), tokens(y, t)
                same = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * same >= num * (len(u) + len(v) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components; a class without a label is its own."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def shared_pairs(queries: list[np.ndarray], rest: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Index pairs of linked sets: overlaps are counted over an inverted index of ``rest``, ``EXPAND`` entries at a time."""
    if not queries or not rest:
        return
    sizes, own_sizes = np.asarray([len(x) for x in rest]), np.asarray([len(x) for x in queries])
    flat = np.concatenate(rest)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(rest)), sizes)[order]
    vocabulary, first, n = np.unique(flat[order], return_index=True, return_counts=True)
    tokens, q = np.concatenate(queries), np.repeat(np.arange(len(queries)), own_sizes)
    at = np.searchsorted(vocabulary, tokens)
    at[at == len(vocabulary)] = 0
    use = np.flatnonzero(vocabulary[at] == tokens)
    at, q = at[use], q[use]
    ends, starts = np.cumsum(n[at]), np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else [], len(q)).astype(np.int64)
    a = 0
    while a + 1 < len(starts):
        base = ends[starts[a]] - n[at[starts[a]]]
        b = max(a + 1, int(np.searchsorted(ends[starts[1:] - 1], base + EXPAND, "right")))
        x, y = starts[a], starts[b]
        m = n[at[x:y]]
        slot = np.repeat(first[at[x:y]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        pair, same = np.unique(np.repeat(q[x:y], m) * len(rest) + owner[slot], return_counts=True)
        left, right = pair // len(rest), pair % len(rest)
        good = den * same >= num * (own_sizes[left] + sizes[right] - same)
        yield from zip(left[good].tolist(), right[good].tolist())
        a = b


def sketch_pairs(n: np.ndarray, sketches: np.ndarray, queries: np.ndarray, group: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets may link with one of another ``group``, of pairs with one of ``queries`` (places) at least: by size and sketch.

    Linked: den * same >= num * (n - same), n the sum of both sizes; the sets differ in n - 2 * same tokens.
    """
    order = np.argsort(n, kind="stable")
    size, rows, own = n[order], np.ascontiguousarray(sketches[order]).view(np.uint64), group[order]
    out = np.zeros(len(n), bool)
    for q in queries.tolist():
        a, b = np.searchsorted(size, -(-num * n[q] // den)), np.searchsorted(size, den * n[q] // num, "right")
        apart = np.bitwise_count(rows[a:b] ^ sketches[q].view(np.uint64)).sum(axis=1, dtype=np.int64)
        near = ((num + den) * apart <= (den - num) * (size[a:b] + n[q])) & (own[a:b] != group[q])
        if near.any():
            out[order[a:b][near]] = True
            out[q] = True
    return out


def _blocks(member: DataFrame, q: Column, m: Column, most: int) -> DataFrame:
    """at (is_query, q, m) of each member's copies, for all pairs of a block of queries and a block of members of a cluster; q and m: sums that ``most`` bounds in a block."""
    blocks = member.groupBy("cluster").agg(q.alias("q"), m.alias("all")).where(F.col("q") > 0)
    blocks = blocks.select("cluster", F.ceil(F.col("q") / most).cast("int").alias("q_blocks"), F.ceil(F.col("all") / most).cast("int").alias("m_blocks"))
    h = F.xxhash64("class", F.lit(1))
    own_q, own_m = F.pmod(h, F.col("q_blocks")).cast("int"), F.pmod(h, F.col("m_blocks")).cast("int")
    as_query = F.transform(F.sequence(F.lit(0), F.col("m_blocks") - 1), lambda m: F.struct(F.lit(True).alias("is_query"), own_q.alias("q"), m.alias("m")))
    as_member = F.transform(F.sequence(F.lit(0), F.col("q_blocks") - 1), lambda q: F.struct(F.lit(False).alias("is_query"), q.alias("q"), own_m.alias("m")))
    return member.join(blocks, "cluster").withColumn("at", F.explode(F.when(F.col("query"), F.concat(as_query, as_member)).otherwise(as_member)))


def near_members(member: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of ``member`` (cluster, class, component, n, sketch, query) that may link with one of another component of their cluster."""

    def near(group: pa.Table) -> pa.Table:
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        found = sketch_pairs(group.column("n").to_numpy(), sketches, np.flatnonzero(group.column("is_query").to_numpy()), group.column("component").to_numpy(), num, den)
        return group.select(["cluster", "class"]).filter(pa.array(found))

    rows = _blocks(member, F.sum(F.col("query").cast("long")), F.count("*"), BLOCK_SKETCHES)
    found = rows.select("cluster", "class", "component", "n", "sketch", "at.is_query", "at.q", "at.m").groupBy("cluster", "q", "m").applyInArrow(near, "cluster long, class long")
    return member.join(found.distinct(), ["cluster", "class"], "left_semi")


def cluster_links(long: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame | None:
    """Links between components inside clusters, the long lists of one first class; None if no classes of different components are near.

    ``sizes``: class, n, sketch.
    """
    cluster = long.select(F.col("a").alias("cluster"), F.col("b").alias("class")).unionByName(long.select(F.col("a").alias("cluster"), F.col("a").alias("class"))).distinct()
    member = spool(
        cluster.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class")).join(sizes, "class")
    )
    main = (
        member.groupBy("cluster", "component").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    )
    member = spool(member.join(main, "cluster").withColumn("query", F.col("component") != F.col("main")).drop("main"))
    member = spool(near_members(member, num, den).drop("sketch"))
    if not member.limit(1).count():
        return None
    rows = _blocks(member, F.sum(F.when(F.col("query"), F.col("n"))), F.sum("n"), BLOCK_TOKENS)
    rows = rows.join(texts, "class").select("cluster", "class", "component", "text", "at.is_query", "at.q", "at.m")

    def search(group: pa.Table) -> pa.Table:
        shingler = Shingler(ngram)
        is_query = group.column("is_query").to_numpy()
        cls, comp = group.column("class").to_numpy(), group.column("component").to_numpy()
        sets = [shingler.tokens(t) for t in group.column("text").to_pylist()]
        queries, rest = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links: tuple[list, list] = ([], [])
        for q, r in shared_pairs([sets[i] for i in queries], [sets[i] for i in rest], num, den):
            i, j = queries[q], rest[r]
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[x] = y
                links[0].append(int(cls[i]))
                links[1].append(int(cls[j]))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return rows.groupBy("cluster", "q", "m").applyInArrow(search, "a long, b long")


def join_components(docs: DataFrame, ngram: int = NGRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """key, key2, doc_id, n (set size), class, component_id (least doc_id reachable) of every row."""
    small_batches(docs.sparkSession)
    scanned = spool(classes(docs, ngram, num, den, bits_for(docs)))
    rows = scanned.where("kind = 0").select("key", "key2", "doc_id", "class", "n", "sketch")
    hot = frequent_tokens(scanned.where("kind = 1"), HOT_COUNT, HOT_TOKENS)
    pairs = spool(candidates(docs, hot, ngram, num, den))
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    # Combined before the join: a class of many copies is a row a task by then.
    stands = rows.groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch")).join(needed, "class", "left_semi")
    texts = spool(keyed(docs).select("key", "text").join(stands, "key").select("class", "n", "sketch", "text").dropDuplicates(["class"]))
    fitting = pairs.where("fits = 1").select("a", "b")
    # First one partner for each class; then only the pairs that these links leave in different components.
    links = spool(verified(fitting.groupBy("b").agg(F.min("a").alias("a")), texts, ngram, num, den))
    apart = spool(across(fitting, components(links)))
    if apart.limit(1).count():
        links = links.unionByName(spool(verified(apart, texts, ngram, num, den)))
    labels = components(links)
    more = cluster_links(pairs.where("long = 1"), labels.select(F.col("node").alias("class"), "component"), texts.select("class", "n", "sketch"), texts.select("class", "text"), ngram, num, den)
    if more is not None:
        labels = components(links.unionByName(spool(more)))
    own = rows.drop("sketch").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "class")))
    own = spool(own)
    # A component of one row needs no look-up, which keeps this table to those of several rows.
    least = own.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "key", "key2")).alias("first"), F.count("*").alias("rows"))
    least = spool(least.where("rows > 1").drop("rows"))
    if least.count() <= BROADCAST_COMPONENTS:
        least = F.broadcast(least)
    return own.join(least, "component", "left").select(
        "key", "key2", "doc_id", "n", "class", F.when(F.col("first").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.coalesce(F.col("first.key"), F.col("key")) == F.col("key")) & (F.coalesce(F.col("first.key2"), F.col("key2")) == F.col("key2"))).alias("is_first"),
    )


def keep_one(docs: DataFrame, ngram: int = NGRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, the least doc_id (null last), with its columns; equal rows count once."""
    firsts = join_components(docs, ngram, num, den).where("is_first").select(F.col("key").alias("__key"), F.col("key2").alias("__key2")).distinct()
    names = docs.columns
    first, second = row_keys()
    kept = docs.withColumns({"__key": first, "__key2": second}).join(firsts, ["__key", "__key2"], "left_semi")
    return kept.dropDuplicates(["__key", "__key2"]).select(*[F.col(f"`{c}`") for c in names])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir), 3, 90, 100).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
