import random
import re

import numpy as np
import pytest

from sondage.llm import ngram_join as nj
from sondage.llm.graph import components

from .cases import EXTRA, frame, hazards


def shingles(text, k):
    w = re.findall("[^\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(data, k, num, den):
    sets = [shingles(t, k) for _, t, *_ in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * same >= num * (len(sets[i]) + len(sets[j]) - same):
                parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(data):
        ids = least.setdefault(root(i), [])
        ids += [row[0]] if row[0] is not None else []
    return sorted(((r[0], len(sets[i]), (min(least[root(i)]) if least[root(i)] else None) if sets[i] else r[0]) for i, r in enumerate(data)), key=str)


def corpus(seed, n=260):
    """Groups of near copies around the threshold, and passages that unlike documents share."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts = []
    base = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or not base:
            base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 9, 30, 80, 150]))]
            words = list(base)
        elif kind == 3:
            words = passage + [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 30]))]
        else:
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "\n", "  "]).join(words).replace("w1", rnd.choice(["w1", "W1"])))
    big = [rnd.choice(vocabulary) for _ in range(120)]
    for _ in range(90):  # one group that its first member doesn't hold together
        words = list(big)
        for _ in range(rnd.randint(0, 7)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    rnd.shuffle(texts)
    return [(i, t, "en", "s", 0, *EXTRA) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k, num, hot", [(3, 90, 4), (5, 80, 4), (3, 90, 48), (2, 60, 2)])
def test_against_brute_force(spark, monkeypatch, k, num, hot):
    monkeypatch.setattr(nj, "HOT_COUNT", hot)
    monkeypatch.setattr(nj, "LIST", 8)
    data = corpus(k * num + hot)
    got = nj.join_components(frame(spark, data=data), k, num, 100)
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got.collect()), key=str) == brute(data, k, num, 100)


@pytest.mark.parametrize("seed", range(4))
def test_signatures_lose_no_pair(seed):
    rnd = np.random.default_rng(seed)
    for num in (60, 80, 90):
        hot = np.unique(rnd.integers(0, 1 << 63, 500, dtype=np.uint64))
        rare = np.unique(rnd.integers(0, 1 << 63, 500, dtype=np.uint64))
        prefixes = nj.Prefixes(hot, num, 100)
        for _ in range(150):
            n = int(rnd.integers(1, 300))
            share = int(n * rnd.choice([0, 0, 0.05, 0.5, 1]))
            pool = np.concatenate([rnd.choice(rare, share, False), rnd.choice(hot, n - share, False)])
            a = np.unique(pool)
            b = np.unique(np.concatenate([rnd.choice(a, max(1, int(n * rnd.uniform(num / 100, 1))), False), rnd.choice(rare, int(n * rnd.uniform(0, 0.2)), False)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= num * (len(a) + len(b) - same):
                assert len(np.intersect1d(prefixes.signatures(a), prefixes.signatures(b)))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(50)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_hazards_and_keep_one(spark):
    data = hazards()
    df = frame(spark, data=data)
    got = sorted(((r["doc_id"], r["n"], r["component_id"]) for r in nj.join_components(df, 3, 90, 100).collect()), key=str)
    assert got == brute(data, 3, 90, 100)
    kept = nj.keep_one(df, 3, 90, 100)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "2", "3", "3", "4", "None"]
    assert nj.keep_one(df.limit(0)).count() == 0


def test_sketches_never_part_linked_sets():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 3000))
        a = rnd.integers(0, 1 << 62, n, dtype=np.uint64)
        b = np.concatenate([a[int(rnd.integers(0, n // 5 + 1)) :], rnd.integers(0, 1 << 62, int(rnd.integers(0, n // 8 + 2)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        x, y = (np.frombuffer(nj.sketch(s), np.uint8) for s in (a, b))
        same = len(np.intersect1d(a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * same
        for num, den in ((80, 100), (90, 100)):
            if den * same >= num * (len(a) + len(b) - same):
                assert (num + den) * int(np.bitwise_count(x ^ y).sum()) <= (den - num) * (len(a) + len(b))


def test_chained_lists_are_not_searched_as_one(spark):
    """Unlike texts of 40 long lists, each of which shares a class with the next: no two are near, so no text is read."""
    rnd = random.Random(6)
    data, stars = [], []
    for i in range(40):
        ids = range(30 * i, 30 * i + 31)
        stars += [(ids[0], x, 1, 0) for x in ids[1:]]
    data = [(i, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60)), "en", "s", 0, *EXTRA) for i in range(40 * 30 + 1)]
    shingler = nj.Shingler(3)
    sets = [shingler.tokens(d[1]) for d in data]
    long = spark.createDataFrame(stars, "a long, b long, long long, fits long")
    sizes = spark.createDataFrame([(i, len(x), bytearray(nj.sketch(x))) for i, x in enumerate(sets)], "class long, n long, sketch binary")
    texts = spark.createDataFrame([(d[0], d[1]) for d in data], "class long, text string")
    labels = spark.createDataFrame([], "class long, component long")
    assert nj.cluster_links(long, labels, sizes, texts, 3, 90, 100) is None
    # A near copy in the same list is found, one in another list is left to its own lists.
    texts = texts.replace({data[35][1]: data[40][1] + " more", data[95][1]: data[40][1] + " again"}, subset="text")
    sets[35], sets[95] = shingler.tokens(data[40][1] + " more"), shingler.tokens(data[40][1] + " again")
    sizes = spark.createDataFrame([(i, len(x), bytearray(nj.sketch(x))) for i, x in enumerate(sets)], "class long, n long, sketch binary")
    got = nj.cluster_links(long, labels, sizes, texts, 3, 90, 100).collect()
    assert {tuple(sorted(r)) for r in got} == {(35, 40)}


def test_frequent_tokens_stay_frequent_in_large_corpora(spark):
    """1.2 million tokens that 4 sets have, more than the table of tokens held before: all of them count as frequent."""
    from sondage.llm.packed import packed

    tokens = np.unique(np.random.default_rng(8).integers(0, 1 << 63, 1_200_000, dtype=np.uint64) * np.uint64(2))
    rows = packed((tokens >> np.uint64(54)).astype(np.int64), [tokens, np.full(len(tokens), nj.HOT_COUNT, np.uint32)])
    early = spark.createDataFrame(list(zip(*(c.to_pylist() for c in rows.columns))), "key long, tokens binary, counts binary")
    hot = nj.frequent_tokens(early, nj.HOT_COUNT, nj.HOT_TOKENS)
    prefixes = nj.Prefixes(hot, 90, 100)
    for at in range(0, len(tokens), 100_000):
        own = tokens[at : at + 200]
        assert not len(np.intersect1d(prefixes.signatures(own), own))
    other = np.random.default_rng(9).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert len(np.setdiff1d(prefixes.signatures(other), other)) == 0
