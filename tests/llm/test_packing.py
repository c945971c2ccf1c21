import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sondage.llm import best_fit, token_counts, token_output
from sondage.llm.tokens import BYTE_BPE, PIECE_BPE, ByteBpe, tokenizer_path

from .cases import frame, hazards, nasty


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path(BYTE_BPE))


def test_ids_equal_the_library(plain):
    bpe = ByteBpe(tokenizer_path(BYTE_BPE), cache_parts=50)
    latin = [re.sub("[^\x00-\u024f]", "", t or "") for t in nasty()]
    assert bpe.fast
    for text in nasty() + latin:
        assert np.frombuffer(bpe.encode(text or ""), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    texts = nasty()
    for table_parts in (0, 20, 10_000):
        got = token_counts.count_tokens(frame(spark, texts), limit=100, table_parts=table_parts).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {
            i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in enumerate(texts)
        }


def test_pieces_checksums_and_layout(spark, plain):
    texts = nasty()
    got = best_fit.pack_documents(frame(spark, texts), 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, n) for k, (s, n) in enumerate(best_fit.cut(len(ids), 64))]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    lengths = [r["length"] for r in got]
    assert len(by_seq) == len(token_output.best_fit_decreasing(lengths, 64)) == brute_bfd(lengths, 64)


def brute_bfd(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def spread(rnd, kind, n):
    return {
        "even": rnd.integers(1, 65, n), "short": rnd.integers(1, 20, n), "tiny": rnd.integers(1, 4, n),
        "long": np.minimum(64, 1 + rnd.exponential(30, n)).astype(int), "one": np.full(n, 7), "half": rnd.choice([32, 33, 31, 1], n),
    }[kind].tolist()


def check_layout(placed, capacity):
    """Sequences have no hole and no overlap; returns their number."""
    parts = defaultdict(list)
    for length, seq, offset in placed:
        parts[seq].append((offset, length))
    for own in parts.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(parts)


@pytest.mark.parametrize("kind", ["even", "short", "tiny", "long", "one", "half"])
def test_sweeps_are_as_good_as_best_fit_decreasing(kind):
    lengths = sorted(spread(np.random.default_rng(5), kind, 3000), reverse=True)
    large = [(i, 64 - n) for i, n in enumerate(lengths) if n > 32]
    small = [n for n in lengths if n <= 32]
    placed, free = best_fit.in_one_task(small, large, 64, best_fit.RATIO, 4, 10**6)
    n = check_layout([*((n, i, 0) for i, n in enumerate(lengths) if n > 32), *((n, s, 64 - g) for n, (s, g) in zip(small, placed))], 64)
    assert sum(lengths) + sum(free.values()) == 64 * n
    assert n <= 1.002 * len(token_output.best_fit_decreasing(lengths, 64))


@pytest.mark.parametrize("kind,task_rows", [("even", 0), ("half", 0), ("even", 120), ("even", 700)])
def test_distributed_sweeps(spark, kind, task_rows):
    lengths = spread(np.random.default_rng(6), kind, 900)
    df = spark.createDataFrame([(i if i % 9 else None, i % 3, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, row string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = best_fit.pack(df, 64, tiny=16, task_rows=task_rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r["doc_id"], r["piece"], r["length"], r["row"]) for r in got) == Counter((i if i % 9 else None, i % 3, n, "x") for i, n in enumerate(lengths))
    n = check_layout([(r["length"], r["sequence_id"], r["offset"]) for r in got], 64)
    assert n <= 1.01 * len(token_output.best_fit_decreasing(lengths, 64))


def test_conflicts_by_rank():
    assert best_fit.conflicts([(0, 2, 3), (1, 1, 0), (2, 4, 5), (4, 1, 0)]) == [(1, 0, 1, 0, 2), (2, 0, 2, 0, 1), (4, 0, 1, 2, 4)]


def test_binary_rows_round_trip(spark, plain):
    texts = nasty()
    back = defaultdict(dict)
    for r in token_output.pack_token_ids(frame(spark, texts), 32, block_tokens=500).collect():
        assert len(r["ids"]) == len(r["positions"]) == 4 * 32
        positions = np.frombuffer(r["positions"], "<u4")
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        for doc_id, start, ids in token_output.decode(r):
            back[doc_id][start] = ids
    for i, t in enumerate(texts):
        assert [x for _, ids in sorted(back[i].items()) for x in ids] == [*plain.encode(t or "", add_special_tokens=False).ids, 2]


def test_hazards(spark):
    df = frame(spark, data=hazards())
    assert best_fit.pack_documents(df).count() == len(hazards())
    assert token_counts.count_tokens(df).count() == len(hazards())
    assert sum(len(r["doc_ids"]) for r in token_output.pack_token_ids(df).collect()) == len(hazards())
    none = df.limit(0)
    assert best_fit.pack_documents(none).count() == token_counts.count_tokens(none).count() == token_output.pack_token_ids(none).count() == 0
