"""Token-ID / binary output (1): best-fit-decreasing packing with a segment tree over capacities, in binary rows.

Each task packs its own documents in blocks of about ``block_tokens`` tokens: no shuffle, bounded memory, and a task
that runs again writes the same block. In a block, documents come longest first; a segment tree over free
capacities finds the smallest open sequence that holds the next one in O(log capacity). Documents over ``capacity``
are cut without loss into full pieces and a rest. A row of the result is a row of the block's id matrix:

block_id, row: the matrix and its row; ids: ``capacity`` little-endian unsigned 32-bit ids, padded with ``pad_id``;
cu_seqlens: 0 and the end of every segment; positions: as many 32-bit positions, 0 at each segment's start and in
the padding; doc_ids, starts: the document of each segment and the ids of it that lie before the segment.

Null texts are empty documents (only the end token); null and repeated ids are kept; an empty table gives no row;
other columns are ignored. Read back with ``decode``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import documents, small_batches, text_or_empty
from sondage.llm.tokens import BYTE_BPE, byte_bpe, tokenizer_path

CAPACITY = 2048
BLOCK_TOKENS = 1 << 21
END_ID = 2
PAD_ID = 50_256
SCHEMA = "block_id long, row int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


class CapacityTree:
    """Segment tree over capacities: how many open sequences have each; smallest capacity that is at least ``x``."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the best fit."""
        node = least + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``lengths`` in each sequence, longest first, ties in the given order."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, s = tree.take(lengths[i]) or (capacity, len(sequences))
        if s == len(sequences):
            sequences.append([])
        sequences[s].append(i)
        if free > lengths[i]:
            tree.put(free - lengths[i], s)
    return sequences


def pack_token_ids(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID, pad_id: int = PAD_ID, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    small_batches(docs.sparkSession)
    path, end = tokenizer_path(tokenizer), end_id.to_bytes(4, "little")

    def block(block_id: int, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sequences = best_fit_decreasing([len(p[2]) // 4 for p in pieces], capacity)
        for at in range(0, len(sequences), 256):
            rows = []
            for row, members in enumerate(sequences[at : at + 256], at):
                lengths = [len(pieces[i][2]) // 4 for i in members]
                ends = [0, *np.cumsum(lengths).tolist()]
                ids = b"".join(pieces[i][2] for i in members)
                positions = np.zeros(capacity, "<u4")
                for a, n in zip(ends, lengths):
                    positions[a : a + n] = np.arange(n)
                rows.append((block_id, row, ids + pad_id.to_bytes(4, "little") * (capacity - ends[-1]), ends, positions.tobytes(), [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block_id", "row", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, pieces, tokens = byte_bpe(path), [], 0
        context = TaskContext.get()
        block_id = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text) + end
                for start in range(0, len(ids), 4 * capacity):
                    pieces.append((doc_id, start // 4, ids[start : start + 4 * capacity]))
                    tokens += len(pieces[-1][2]) // 4
                    if tokens >= block_tokens:
                        yield from block(block_id, pieces)
                        block_id, pieces, tokens = block_id + 1, [], 0
        if pieces:
            yield from block(block_id, pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(packed, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Binary rows as Parquet, one file group per task; readable without this package. Positions repeat and compress well."""
    packed.write.option("compression", "zstd").parquet(path)


def decode(row) -> list[tuple[int, int, list[int]]]:
    """(doc_id, start, ids) of each segment of a row."""
    import numpy as np

    ids, cu = np.frombuffer(row["ids"], "<u4"), row["cu_seqlens"]
    return [(d, s, ids[a:b].tolist()) for d, s, a, b in zip(row["doc_ids"], row["starts"], cu, cu[1:])]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packed rows with their ids, segment ends and positions, and the tokens in each."""
    return pack_token_ids(documents(spark, sf_dir)).withColumn("n_tokens", F.element_at("cu_seqlens", -1).cast("long"))
