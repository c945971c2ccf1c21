import random

import corpus_pipeline
from sondage.llm import best_fit, decontaminate
from sondage.llm.tokens import BYTE_BPE, ByteBpe, tokenizer_path

from .test_decontaminate import sellers
from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_join
from .test_packing import brute_bfd

WORDS = {"en": "the quick brown fox jumps over lazy dog and runs home".split(), "de": "der schnelle braune fuchs springt über faulen hund und rennt heim".split()}


def make(rnd, lang, n):
    return "\n".join(" ".join(rnd.choice(WORDS[lang]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(3, 9))) for _ in range(n))


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    items = [(i, make(rnd, "en", 3).replace("\n", " ")) for i in range(4)]
    data, stock = [], [make(rnd, "en", 4) for _ in range(3)]
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = make(rnd, lang, rnd.randint(1, 9))
        if i % 7 == 0:
            text += "\n" + rnd.choice(stock)
        if i % 11 == 0:
            text += "\n" + rnd.choice(items)[1].upper()
        if i % 5 == 0 and data:
            words = rnd.choice(data)[1].split(" ")
            words[-1] = "changed"
            text = " ".join(words)
        data.append((i, text, lang, "s", len(text)))
    data += [(200, "", "en", "s", 0), (201, None, None, None, None), (202, "### 12 !!", "en", "s", 9), (None, make(rnd, "en", 5), "en", None, 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    known = [r for r in data if r[1] and any(c.isalpha() for c in r[1])]
    texts = {d: t for d, t, n, gone in brute_lines(known) if not gone or gone < n}
    left = [(d, t) for d, t in texts.items()]
    first = {d for d, _, c in brute_join(left, 5, 80, 100) if d == c or (d is None)}
    left = [(d, t) for d, t in left if d in first]
    clean = []
    for d, t in left:
        folded = decontaminate.fold(t)
        hit = False
        for _, item in items:
            b = decontaminate.fold(item).strip()
            hit = hit or sellers(b, folded) <= max(0, min(int(decontaminate.RATE * len(b)), (len(b) - decontaminate.Q) // decontaminate.Q))
        if not hit:
            clean.append((d, t))
    bpe = ByteBpe(tokenizer_path(BYTE_BPE))
    want = sorted(((d, k, s, n) for d, t in clean for k, (s, n) in enumerate(best_fit.cut(len(bpe.encode(t)) // 4 + 1, 1024))), key=str)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(clean) < len(known) - 15
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows), key=str) == want
    assert len({r["sequence_id"] for r in rows}) == brute_bfd([r["length"] for r in rows], 1024)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
