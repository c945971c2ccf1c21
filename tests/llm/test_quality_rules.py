import random
import re
from collections import Counter

from sondage.llm import quality_rules as rules
from sondage.llm.quality_rules import quality_rules

from .cases import EXTRA, frame, hazards, rows

SPACE = "[\\x20\\x09-\\x0d]+"


def brute(data, max_docs, min_left):
    docs = []
    for d, t, _, host, *_ in data:
        t = t or ""
        words = re.findall("[^\\x20\\x09-\\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0d]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(windows)
        hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
        norm = [" ".join(re.findall("[^\\x20\\x09-\\x0d]+", x.lower())) for x in lines]
        docs.append((d, host, words, len(lines) - len(set(lines)), len(hit), norm, sum(c in "#*$%&|<>" for c in t)))
    seen = Counter((host, x) for _, host, _, _, _, norm, _ in docs for x in set(norm))
    out = []
    for d, host, words, dup, hit, norm, symbols in docs:
        chars = sum(map(len, words))
        lost = [x for x in norm if seen[host, x] > max_docs]
        bad = len(words) < 10 or 100 * hit > 20 * len(words)
        out.append((d, len(words), chars, symbols, dup, hit, bad, not bad and chars - sum(len(x.replace(" ", "")) for x in lost) >= min_left * chars, len(lost)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    common = ["All rights reserved here.", "ALL  rights reserved here.", "click me now please"]
    data = []
    for i in range(120):
        lines = [" ".join(rnd.choice("alpha beta gamma d# e| f".split()) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 6))]
        lines += rnd.choices(common, k=rnd.randint(0, 3)) + [f"own line {i} " + " ".join(f"w{rnd.randint(0, 999)}" for _ in range(9))]
        rnd.shuffle(lines)
        data.append((i, rnd.choice(["\n", "\n\n", "\t\n"]).join(lines), None, rnd.choice(["a", "b", None]), 0, *EXTRA))
    data += hazards()
    data.append((500, "once upon a time there " * 400, None, "a", 0, *EXTRA))
    got = sorted((tuple(r) for r in quality_rules(frame(spark, data=data), max_docs=10, min_left=0.5).collect()), key=str)
    assert got == brute(data, 10, 0.5)
    assert quality_rules(frame(spark, data=data).limit(0)).count() == 0


def test_common_lines_are_taken_out(spark):
    texts = [f"Buy  NOW\nown line {i}\n\nbuy now" if i < 5 else f"other {i}\nbuy now" if i == 5 else None if i == 6 else "" for i in range(8)]
    df = frame(spark, data=[*rows(texts[:5], source="a"), *[(i, t, "en", "b", 0, *EXTRA) for i, t in enumerate(texts[5:], 5)], (9, "Buy now", "en", None, 0, *EXTRA)])
    got = rules.without_common_lines(df, max_docs=3)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {**{i: f"own line {i}\n" for i in range(5)}, 5: "other 5\nbuy now", 6: None, 7: "", 9: "Buy now"}
    assert rules.without_common_lines(df.limit(0)).count() == 0
