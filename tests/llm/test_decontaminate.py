import random

from sondage.llm import decontaminate as dec

from .cases import frame, hazards


def sellers(item, text, low=None):
    """Least edits of the item against any region of the text."""
    row = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j - 1] + (item[i - 1] != text[j - 1]), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(rnd, s, n):
    s = list(s)
    for _ in range(n):
        p = rnd.randrange(len(s))
        op = rnd.randrange(3)
        if op == 0:
            s[p] = rnd.choice("abcxyz é")
        elif op == 1:
            del s[p]
        else:
            s.insert(p, rnd.choice("abcxyz "))
    return "".join(s)


def test_against_brute_force(spark):
    rnd = random.Random(11)
    words = ["the", "quick", "bröwn", "fox", "jumps", "over", "a", "lazy", "dog", "señor", "x"]
    say = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, say(rnd.randint(6, 16))) for i in range(12)] + [(50, "tiny"), (51, None), (52, "  "), (53, "Quick bröwn fox.")]
    texts = []
    for k in range(60):
        pick = rnd.choice(items[:12])[1]
        texts.append(say(rnd.randint(0, 25)) + " " + (edit(rnd, pick, rnd.randint(0, 9)) if k % 3 else "") + rnd.choice([" ", "\n"]) + say(rnd.randint(0, 10)))
    texts += [items[0][1].upper().replace(" ", "\n"), items[1][1], None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start"], r["length"]) for r in dec.find_items(frame(spark, texts), bench, 0.08, 300).collect()}
    want = {}
    for item_id, item in items:
        data = dec.fold(item or "").strip()
        if not data:
            continue
        k = max(0, min(int(0.08 * len(data)), (len(data) - dec.Q) // dec.Q))
        for d, t in enumerate(texts):
            n = sellers(data, dec.fold(t or ""))
            if n <= k:
                want[d, item_id] = n
    assert {x: v[0] for x, v in got.items()} == want and len(want) >= 15 and any(want.values())
    for (d, i), (edits, start, length) in got.items():
        item = dec.fold(dict(items)[i]).strip()
        assert sellers(item, dec.fold(texts[d][start : start + length])) <= edits
    for block in (300, 1 << 20):
        left = {r["doc_id"] for r in dec.clean(frame(spark, texts), bench, 0.08, block).collect()}
        assert left == set(range(len(texts))) - {d for d, _ in want}
    one = dec.find_items(frame(spark, texts), bench, 0.08).collect()
    assert {(r["doc_id"], r["item_id"]): (r["edits"], r["start"], r["length"]) for r in one} == got
    sieve = dec.Sieve(dec.folded_items(bench.where("item_id < 50")), 4000, 0.08)
    assert all(sieve.passes(dec.fold(texts[d] or "")) for d, i in want if i < 50) and not sieve.passes(b"zzz yyy www vvv uuu ttt")


def test_shared_stem_and_long_texts():
    """Thousands of items with one stem, and texts over many windows: bounded memory, nothing lost."""
    import tracemalloc

    rnd = random.Random(3)
    tail = lambda: "".join(rnd.choice("bcdfghjklmnp") for _ in range(100))
    stem = "which of the following statements is the best "
    items = [(i, dec.fold(stem + tail())) for i in range(2000)]
    index = dec.Index(items)
    texts = [dec.fold((stem + tail() + " ") * 4) for _ in range(127)] + [dec.fold(stem + "x ") + items[7][1]]
    tracemalloc.start()
    found = set(dec._regions(index, texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(127, 7)} and peak < 400 << 20
    small = dec.Index(items[:3])
    step = max(dec.WINDOW_BYTES, 4 * small.longest)
    for at in (0, step - 100, step - 1, step, step + 1, 2 * step + small.longest - 70, 3 * step):
        long = (" ".join("".join(rnd.choice("qrstuvwxyz") for _ in range(9)) for _ in range(at // 10 + 1)))[:at].ljust(at).encode()
        assert dec._regions(small, [b"", long + items[1][1] + b" end"])[1, 1] == (0, at, at + len(items[1][1]))
    runs = dec.Index([(0, b"a" * 300), (1, b"ab" * 150)])
    assert set(dec._regions(runs, [b"a" * 3000, b"ba" * 400, b"a" * 200])) == {(0, 0), (1, 1)}


def test_hazards(spark):
    df, bench = frame(spark, data=hazards()), spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dec.find_items(df, bench).collect()) == [4, 4, 5]
    assert dec.clean(df, bench).columns == df.columns and dec.clean(df, bench).count() == len(hazards()) - 3
    assert dec.find_items(df, bench.limit(0)).count() == 0 and dec.find_items(df.limit(0), bench).count() == 0
    assert dec.clean(df, bench.limit(0)).count() == len(hazards())
