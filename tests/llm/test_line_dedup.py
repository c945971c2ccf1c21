import random

from sondage.llm.line_dedup import line_dedup

from .cases import EXTRA, frame, hazards


def brute(data):
    """(id, text) -> text, by the definition."""
    docs = sorted({(d is None, d or 0, t or "", t is None) for d, t, *_ in data})
    seen, gone = set(), {}
    full = {}
    for key in docs:
        lines = key[2].split("\n") if key[2] else []
        nb = [i for i, x in enumerate(lines) if x.strip()]
        full[key] = (lines, nb)
    for key in docs:
        lines, nb = full[key]
        gone[key] = set()
        for p in range(len(nb) - 2):
            w = tuple(lines[i].strip() for i in nb[p : p + 3])
            if w in seen:
                gone[key] |= {p, p + 1, p + 2}
            seen.add(w)
    out = []
    for d, t, *_ in data:
        key = (d is None, d or 0, t or "", t is None)
        lines, nb = full[key]
        kept = [x for i, x in enumerate(lines) if sum(b <= i for b in nb) - 1 not in gone[key]]
        out.append((d, "\n".join(kept) if gone[key] else t, len(nb), len(gone[key])))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    lines = [f"line number {i} " for i in range(12)] + ["", "  ", "\t"]
    data = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14))), "en", "s", 0, *EXTRA) for i in range(200)]
    data += [(i + 300, "\n".join(f"own {i} {j}" for j in range(6)), "en", "s", 0, *EXTRA) for i in range(5)]
    df = frame(spark, data=data)
    got = line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == brute(data)


def test_hazards(spark):
    data = hazards()
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(frame(spark, data=data)).collect()), key=str)
    assert got == brute(data)
    assert line_dedup(frame(spark, data=data).limit(0)).count() == 0
    three = "a\nb\nc"
    twice = [(1, three, None, None, None, *EXTRA)] * 2 + [(None, three, None, None, None, *EXTRA)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup(frame(spark, data=twice)).collect()) == [("1", three), ("1", three), ("None", "")]
