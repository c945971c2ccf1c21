"""Best-fit packing (3): bulk-synchronous best fit over range-sorted documents and gaps.

Documents (pieces of at most ``capacity`` tokens) over half a sequence open sequences of their own. The others go in bands of
lengths, longest first, each band in sweeps. A sweep range-sorts the band's documents together with the gaps of open
sequences over the cluster, longest first, a gap ahead of documents of its size. A gap takes part with as many slots as
it holds documents of the band's longest length. Read in this order, each document takes the slot seen last: its
successor, the smallest one that holds it and is not taken by a longer document. A task matches what lies in its range with
a stack. What is left of a range, by count only (documents without a slot, then slots without a document), goes to the driver: it matches the
counts of later ranges with those of earlier ones, last slots first, and so resolves conflicts by rank; the rows
themselves meet in a join on (range, rank). Then gaps are updated and the sweep is repeated until it places nothing. What
then is left opens as many empty sequences as its tokens fill, at least one, and the sweeps go on.

Once a band, or all that still waits, has ``TASK_ROWS`` documents and gaps or fewer, one task runs the rest of its sweeps.
The driver holds a few numbers for each range of a sweep. A band takes some sweeps (gaps at least halve in each), so their
number depends on the capacity, not on the documents. In tests the result has as many sequences as best-fit decreasing,
document by document.

Null texts are empty documents of one token (the end token). Null and repeated ids are packed as rows of their own.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.llm.common import documents, shuffle_parts, small_batches, spool, text_or_empty, unspool
from sondage.llm.tokens import BYTE_BPE, byte_bpe, tokenizer_path

CAPACITY = 1024
END_ID = 2
RATIO = 0.5
TINY = 64
TASK_ROWS = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only more than ``capacity`` are cut, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with the checksum of its ids; map-side, texts are not shuffled."""
    small_batches(docs.sparkSession)
    path, end = tokenizer_path(tokenizer), end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, PIECES)


def sorted_once(pieces: DataFrame) -> DataFrame:
    """``pieces`` range-sorted by length, longest first, with ``at``: (range << 33) + place in it."""
    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece")]
    ranged = pieces.repartitionByRange(shuffle_parts(pieces.sparkSession), *order).sortWithinPartitions(*order)
    return spool(ranged.withColumn("at", F.monotonically_increasing_id()))


PLACED, GAP, LEFT, TALLY = range(4)


def match(items: DataFrame) -> DataFrame:
    """One sweep inside each range. ``items``: is_doc, size, seq, gap, slots, row; longest first, gaps before documents.

    Rows by ``what``: PLACED (seq, gap before it, row), GAP (seq, gap, slots left, ord: rank of the first of them in the
    range), LEFT (row, ord: rank in the range) and one TALLY a range (ord: documents left, slots: slots left, seq: gaps).
    """
    kind = items.schema["row"].dataType

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        stack: list[list[int]] = []
        left = full = 0

        def table(out: list[tuple], rows: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 4])]
            own = rows.take(pa.array(columns[5], pa.int64()))
            return pa.RecordBatch.from_arrays([arrays[0], pa.array([place] * len(out), pa.int32()), *arrays[1:], own], names=["what", "place", "seq", "gap", "slots", "ord", "row"])

        rows = None
        for batch in batches:
            out: list[tuple] = []
            rows = batch.column(5)
            for i, (is_doc, size, seq, gap, slots) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                if not is_doc:
                    stack.append([seq, gap, slots])
                elif stack:
                    top = stack[-1]
                    out.append((PLACED, top[0], top[1], 0, 0, i))
                    top[1] -= size
                    top[2] -= 1
                    if not top[2]:
                        out.append((GAP, top[0], top[1], 0, 0, None))
                        full += 1
                        stack.pop()
                else:
                    out.append((LEFT, None, 0, 0, left, i))
                    left += 1
            yield table(out, rows)
        total, live = 0, len(stack)
        for a in range(0, len(stack), 10_000):
            out = []
            for seq, gap, slots in stack[a : a + 10_000]:
                out.append((GAP, seq, gap, slots, total, None))
                total += slots
            yield table(out, rows)
        if left or total or full:
            yield table([(TALLY, live + full, 0, total, left, None)], rows)

    return items.mapInArrow(sweep, f"what int, place int, seq long, gap long, slots long, ord long, row {kind.simpleString()}")


def conflicts(tallies: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(place, rank of the first document, how many, place of their slots, rank of the last slot) of ranges in order.

    ``tallies``: place, documents left, slots left. Documents take the slots of the nearest earlier range, last ones first.
    """
    open_slots: list[list[int]] = []
    out = []
    for place, docs, slots in sorted(tallies):
        first = 0
        while docs > first and open_slots:
            near = open_slots[-1]
            took = min(docs - first, near[1])
            out.append((place, first, took, near[0], near[1] - 1))
            near[1] -= took
            first += took
            if not near[1]:
                open_slots.pop()
        if slots:
            open_slots.append([place, slots])
    return out


def across(swept: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents placed in ranges and over their borders (seq, gap before it, row), gaps after that, documents still left."""
    spark = swept.sparkSession
    local = swept.where(F.col("what") == PLACED).select("seq", "gap", "row")
    if not plan:
        return local, swept.where(F.col("what") == GAP).select("seq", "gap"), swept.where(F.col("what") == LEFT).select("row")
    shared = spark.createDataFrame(plan, "place int, first long, n long, slot_place int, slot long")
    by_place = F.broadcast(shared.groupBy("place").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "n", "slot_place", "slot"))).alias("plan")))
    low = F.broadcast(shared.groupBy(F.col("slot_place").alias("place")).agg(F.min(F.col("slot") - F.col("n") + 1).alias("low")))
    left = swept.where(F.col("what") == LEFT).select("place", "ord", "row").join(by_place, "place", "left")
    own = F.element_at(F.filter("plan", lambda x: x["first"] <= F.col("ord")), -1)
    docs = left.where(F.col("ord") < F.col("taken")).withColumn("x", own).select(
        F.col("x.slot_place").alias("place"), (F.col("x.slot") - (F.col("ord") - F.col("x.first"))).alias("slot"), "row"
    )
    gaps = swept.where(F.col("what") == GAP).join(low, "place", "left")
    touched = (F.col("slots") > 0) & (F.col("ord") + F.col("slots") > F.col("low"))
    slots = gaps.where(touched).select("place", "seq", "gap", F.explode(F.sequence(F.greatest("ord", "low"), F.col("ord") + F.col("slots") - 1)).alias("slot"))
    joined = spool(slots.join(docs, ["place", "slot"]).select("seq", "gap", "slot", "row"))
    # A sequence has a number of slots bounded by the capacity.
    before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.select("seq", (F.col("gap") - F.coalesce(F.sum("row.length").over(before), F.lit(0))).alias("gap"), "row")
    rest = gaps.where(~F.coalesce(touched, F.lit(False))).select("seq", "gap").unionByName(
        joined.groupBy("seq").agg((F.first("gap") - F.sum("row.length")).alias("gap"))
    )
    return local.unionByName(placed), rest, left.where(F.col("ord") >= F.coalesce("taken", F.lit(0))).select("row")


def bands(lengths: list[int], ratio: float, tiny: int) -> Iterator[list[int]]:
    """``lengths``, longest first, in bands."""
    while lengths:
        least = 0 if lengths[0] <= tiny else int(lengths[0] * ratio)
        band = [n for n in lengths if n > least]
        lengths = lengths[len(band) :]
        yield band


def in_one_task(docs: list[int], gaps: list[tuple[int, int]], capacity: int, ratio: float, tiny: int, opened: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """The same bands and sweeps in memory: (seq, gap before it) of ``docs`` (lengths, longest first), and the gaps after; ``gaps``: (seq, gap)."""
    free = dict(gaps)
    out: list[tuple[int, int]] = [(-1, -1)] * len(docs)
    first = 0
    for band in bands(sorted(set(docs), reverse=True), ratio, tiny):
        end = first
        while end < len(docs) and docs[end] >= band[-1]:
            end += 1
        left = list(range(first, end))
        first, fresh = end, 0
        while left:
            free.update((opened + i, capacity) for i in range(fresh))
            opened, fresh = opened + fresh, 0
            usable = [(g // (m := max(1, g // band[0])), s, m) for s, g in free.items() if g >= band[-1]]
            usable.sort(key=lambda x: (-x[0], x[1]))
            stack, missed, at = [], [], 0
            for i in left:
                while at < len(usable) and usable[at][0] >= docs[i]:
                    stack.append([usable[at][1], usable[at][2]])
                    at += 1
                if not stack:
                    missed.append(i)
                    continue
                top = stack[-1]
                out[i] = (top[0], free[top[0]])
                free[top[0]] -= docs[i]
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            if len(missed) == len(left):
                fresh = max(1, sum(docs[i] for i in left) // capacity)
            left = missed
    return out, free


def finish(left: DataFrame, gaps: DataFrame, capacity: int, ratio: float, tiny: int, opened: int) -> DataFrame:
    """Packs a bounded number of documents and gaps in one task: PLACED and GAP rows as of ``match``."""
    kind = left.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        rows, free = [], []
        for batch in batches:
            for seq, gap, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if row is None:
                    free.append((seq, gap))
                else:
                    rows.append(row)
        none = lambda x: (x is None, x or 0)
        rows.sort(key=lambda r: (-r["length"], none(r["doc_id"]), none(r["piece"])))
        placed, free = in_one_task([r["length"] for r in rows], sorted(free), capacity, ratio, tiny, opened)
        out = [*((PLACED, s, g, r) for (s, g), r in zip(placed, rows)), *((GAP, s, g, None) for s, g in sorted(free.items()))]
        for at in range(0, len(out), 10_000):
            columns = list(zip(*out[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), arrow))], names=["what", "seq", "gap", "row"])

    both = gaps.select("seq", "gap", F.lit(None).cast(kind).alias("row")).unionByName(left.select(F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("gap"), "row"))
    return spool(both.coalesce(1).mapInArrow(run, f"what int, seq long, gap long, row {kind.simpleString()}"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, ratio: float = RATIO, tiny: int = TINY, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows that have ``length`` (1 to ``capacity``), doc_id and piece."""
    spark = pieces.sparkSession
    kept = spool(pieces)  # sorting by range reads its input twice
    ordered = sorted_once(kept)
    unspool(kept)
    names = [c for c in ordered.columns if c != "at"]
    length = F.col("row.length").cast("long")
    counts = {r["length"]: r["n"] for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    rows = ordered.select(F.struct(*names).alias("row"), "at")
    kind = rows.schema["row"].dataType
    # Two pieces of over half a sequence never share one: the id of their sequence is their place in the sorted table.
    large = rows.where(length > capacity // 2)
    done = [large.select("row", F.col("at").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = large.select(F.col("at").alias("seq"), (F.lit(capacity) - length).alias("gap"))
    opened = 1 << 62  # ids of sequences opened later
    into = lambda df: df.where(F.col("what") == PLACED).select("row", F.col("seq").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).alias("offset"))
    small = sorted((n for n in counts if n <= capacity // 2), reverse=True)
    waiting = sum(counts[n] for n in small)
    for band in bands(small, ratio, tiny):
        top, low = band[0], band[-1]
        gaps = spool(gaps.where(F.col("gap") >= small[-1]))
        if waiting + gaps.count() <= task_rows:
            ended = finish(rows.where(length <= top).select("row"), gaps, capacity, ratio, tiny, opened)
            done.append(into(ended))
            break
        n_left = sum(counts[n] for n in band)
        waiting -= n_left
        left = rows.where(length.between(low, top)).select("row")
        fresh = 0
        idle, live = gaps.where(F.col("gap") < low), gaps.where(F.col("gap") >= low)
        rows_left = gaps.count() + n_left
        while n_left:
            if rows_left <= task_rows:
                ended = finish(left, live, capacity, ratio, tiny, opened)
                done.append(into(ended))
                live = ended.where(F.col("what") == GAP).select("seq", "gap")
                opened += n_left
                break
            if fresh:
                live = live.unionByName(spark.range(opened, opened + fresh).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
                opened, fresh = opened + fresh, 0
            slots = F.greatest(F.lit(1), F.floor(F.col("gap") / top)).cast("long")
            zero = F.lit(0).cast("long")
            items = live.select(F.lit(False).alias("is_doc"), F.floor(F.col("gap") / slots).cast("long").alias("size"), "seq", "gap", slots.alias("slots"), F.lit(None).cast(kind).alias("row")).unionByName(
                left.select(F.lit(True).alias("is_doc"), length.alias("size"), zero.alias("seq"), zero.alias("gap"), zero.alias("slots"), "row")
            )
            order = [F.desc("size"), F.asc("is_doc"), F.asc("seq"), F.asc("row.doc_id"), F.asc("row.piece")]
            swept = spool(match(items.repartitionByRange(*order).sortWithinPartitions(*order)))
            found = swept.where(F.col("what") == TALLY).select("place", "ord", "slots", "seq").collect()
            tallies = [tuple(r)[:3] for r in found]
            plan = conflicts(tallies)
            placed, rest, left = across(swept, plan)
            was, n_left = n_left, sum(t[1] for t in tallies) - sum(x[2] for x in plan)
            rows_left = n_left + sum(r["seq"] for r in found)
            if n_left < was:
                done.append(into(placed.select(F.lit(PLACED).alias("what"), "seq", "gap", "row")))
            elif n_left:
                fresh = max(1, left.agg(F.sum(length)).first()[0] // capacity)
            idle, live = idle.unionByName(rest.where(F.col("gap") < low)), rest.where(F.col("gap") >= low)
        gaps = idle.unionByName(live)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, capacity), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
