import itertools
import random

import numpy as np
import pytest

from sondage.llm import substring_dedup as sd

from .cases import EXTRA, frame, hazards


def brute_best(seeds, k, cost):
    best = 0.0
    for n in range(1, len(seeds) + 1):
        for own in itertools.combinations(sorted(seeds), n):
            if all(a < c and b < d for (a, b), (c, d) in zip(own, own[1:])):
                best = max(best, k * n - cost * (own[-1][0] - own[0][0] + own[-1][1] - own[0][1]))
    return best


@pytest.mark.parametrize("seed", range(15))
def test_chains_are_optimal(seed):
    rnd = random.Random(seed)
    seeds = list({(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(9)})
    best = sd.chain(seeds, 3, 0.2, 10**6)[0]
    assert all(a < c and b < d for (a, b), (c, d) in zip(best, best[1:]))
    got = 3 * len(best) - 0.2 * (best[-1][0] - best[0][0] + best[-1][1] - best[0][1])
    assert abs(got - brute_best(seeds, 3, 0.2)) < 1e-9


def test_minimizers_cover_equal_runs():
    rnd = np.random.default_rng(2)
    run = rnd.integers(0, 1 << 60, sd.K + sd.WINDOW - 1, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rnd.integers(0, 1 << 60, int(rnd.integers(0, 40)), dtype=np.uint64), run, rnd.integers(0, 1 << 60, int(rnd.integers(0, 40)), dtype=np.uint64)]) for _ in range(2))
        x, y = (h[sd.minimizers(h)] for h in map(sd.kmers, (a, b)))
        assert len(np.intersect1d(x, y))


def longest_equal_runs(words, earlier, least):
    """Word positions of ``words`` under equal runs of ``least`` or more words with an earlier text."""
    grams = {tuple(e[i : i + least]) for e in earlier for i in range(len(e) - least + 1)}
    return {j for i in range(len(words) - least + 1) if tuple(words[i : i + least]) in grams for j in range(i, i + least)}


def test_against_brute_force(spark):
    rnd = random.Random(8)
    new = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    stock = [new(rnd.randint(51, 120)) for _ in range(6)]
    texts = []
    for i in range(90):
        words = new(rnd.randint(0, 60))
        if i % 2:
            words += rnd.choice(stock) + new(rnd.randint(0, 30))
        if i % 9 == 0:
            words += rnd.choice(stock)[:30] + new(5)  # too short
        texts.append(words)
    got = {}
    for r in sd.passages(frame(spark, [rnd.choice([" ", "\n"]).join(w) for w in texts])).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    want = {i: x for i in range(90) if (x := longest_equal_runs(texts[i], texts[:i], sd.LEAST_WORDS))}
    assert len(want) > 30 and got == want


def test_fuzzy_passage_and_cut(spark):
    rnd = random.Random(9)
    new = lambda n: [f"v{rnd.randint(0, 10**6)}" for _ in range(n)]
    base = new(100)
    fuzzy = base[:40] + ["changed"] + base[41:70] + base[72:]
    df = frame(spark, [" ".join(base), " ".join(new(20) + fuzzy + new(20)), None, ""])
    (r,) = sd.passages(df).collect()
    assert (r["doc_id"], r["start_word"], r["end_word"], r["words"], r["edits"], r["refs"]) == (1, 20, 118, 98, 3, [0])
    out = {x["doc_id"]: x["text"] for x in sd.cut(df).collect()}
    assert len(out[1].split()) == 40 and out[0] == " ".join(base) and out[2] is None and out[3] == ""


def test_hazards(spark):
    df = frame(spark, data=hazards())
    assert sd.passages(df).count() == 0 and sd.passages(df.limit(0)).count() == 0
    assert sd.cut(df).columns == df.columns and sd.cut(df).count() == len(hazards())
    long = " ".join(f"u{i}" for i in range(70))
    twice = [(1, long, None, None, None, *EXTRA)] * 2 + [(None, long, None, None, None, *EXTRA), (5, long + " x " + long, None, None, None, *EXTRA)]
    got = sd.passages(frame(spark, data=twice)).collect()
    assert sorted((str(r["doc_id"]), r["start_word"], r["end_word"]) for r in got) == [("5", 0, 70), ("5", 71, 141), ("None", 0, 70)]


def test_passage_whose_parts_came_first_in_other_documents(spark):
    rnd = random.Random(11)
    new = lambda n: [f"s{rnd.randint(0, 10**6)}" for _ in range(n)]
    whole = new(60)
    texts = [new(5) + whole[i : i + 12] + new(5) for i in range(0, 60, 12)] + [new(9) + whole + new(9) for _ in range(2)]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in sd.passages(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert got == {(5, 9, 69), (6, 9, 69)}  # 5: the parts touch


@pytest.mark.parametrize("every", [10, 12, 15])
def test_fuzzy_passage_with_many_changes(spark, every):
    rnd = random.Random(12)
    new = lambda n: [f"f{rnd.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        base = new(60)
        changed = [f"x{rnd.randint(0, 10**6)}" if i % every == every - 1 else w for i, w in enumerate(base)]
        texts += [base, new(7) + changed + new(7)]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in sd.passages(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert sorted(got) == list(range(1, 40, 2)) and all(a == 7 and b >= 66 for a, b in got.values())
