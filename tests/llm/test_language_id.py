import itertools
import os

import numpy as np
import pytest

from sondage.llm import language_id as lid

from .cases import EXTRA, frame, hazards

DATA = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(1)
    e, moves = rnd.normal(size=(3, 5, 3)), rnd.normal(size=(3, 3))
    mask = np.ones((3, 5), bool)
    mask[1, 3:] = False
    e[~mask] = 0
    m, pairs = lid.forward_backward(e, moves, mask)
    want_pairs = np.zeros((3, 3))
    for c in range(3):
        n = int(mask[c].sum())
        total, own, moved = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(e[c, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for a, b in zip(path, path[1:]):
                moved[a, b] += p
        np.testing.assert_allclose(m[c, :n], own / total, rtol=1e-9)
        want_pairs += moved / total
    np.testing.assert_allclose(pairs, want_pairs, rtol=1e-9)


def toy(n=40):
    a, b = "lorem ipsum dolor amet vita".split(), "quick brown jumping lazy think".split()
    rows = [(i, " ".join((a if i % 2 else b)[(i * j) % 5] for j in range(1, 30)), "la" if i % 2 else "en", "s", 0, *EXTRA) for i in range(n)]
    return rows


def test_toy_and_code_switching(spark):
    df = frame(spark, data=toy())
    model = lid.train(df)
    assert all(r["lang_pred"] == ("la" if r["doc_id"] % 2 else "en") and 0 <= r["score"] <= 1 for r in lid.predict(df, model).collect())
    mixed = frame(spark, ["lorem ipsum dolor amet 77 quick brown jumping lazy", None, "12 #"])
    rows = {r["doc_id"]: r for r in lid.label_words(mixed, model).collect()}
    assert rows[0]["labels"] == ["la"] * 4 + [None] + ["en"] * 4
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (1, 2)] == [("und", 0.0)] * 2


def test_long_words_count_to_their_end(spark):
    df = frame(spark, data=toy())
    a, b = "lorem-ipsum-dolor-amet-vita", "quick_brown_jumping_lazy_think"
    texts = ["-".join([a] * 2 + [b] * 20), "_".join([b] * 2 + [a] * 20)]
    got = {r["doc_id"]: r["lang_pred"] for r in lid.predict(frame(spark, texts), lid.train(df)).collect()}
    assert got == {0: "en", 1: "la"}
    owner, found, lettered = lid.features(["a" * 60 + "xyz", "a" * 1000 + "q", "12", "a" * 1000 + "r"])
    assert lettered.tolist() == [True, True, False, True] and np.bincount(owner).tolist() == [63 + 7, 1001 + 7, 0, 1001 + 7]
    assert set(found[owner == 1]) != set(found[owner == 3])
    assert "".join(lid.units("a" * 1000 + " b\n" + "c" * 25)) == "a" * 1000 + "b" + "c" * 25
    unspaced = ["loremipsumdoloramet" * 3 + "quickbrownjumpinglazythink" * 30, "quickbrownjumping" * 3 + "loremipsumdolorametvita" * 30]
    got = {r["doc_id"]: r["lang_pred"] for r in lid.predict(frame(spark, unspaced), lid.train(df)).collect()}
    assert got == {0: "en", 1: "la"}


def test_only_letters_have_a_language(spark):
    model = lid.train(frame(spark, data=toy()))
    texts = ["½ ² ⅷ 12", "12 _ ## ٣ ①", "ª", "日本", "½ quick brown"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.predict(frame(spark, texts), model).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[2][0] != "und" and got[3][0] != "und" and got[4][0] == "en"


def test_sample_does_not_depend_on_layout(spark):
    same = [(None, "lorem ipsum dolor", "la", "s", 0, *EXTRA)] * 500 + toy()
    a, b = (lid.train(frame(spark, data=d, parts=p), sample_docs=8) for d, p in ((same, 2), (same[::-1], 7)))
    assert a.labels == b.labels == ["en", "la"] and np.array_equal(a.weights, b.weights)


def test_hazards(spark):
    df = frame(spark, data=hazards())
    assert lid.predict(df, lid.train(df)).count() == len(hazards())
    assert {r["lang_pred"] for r in lid.predict(df, None).collect()} == {"und"}
    none = df.limit(0)
    assert lid.train(none) is None and lid.predict(none, None).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in lid.op4_language_id(spark, DATA).collect() if r["held_out"]]
    assert len(got) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
