"""Language ID (4): a linear-chain conditional random field over words.

A text is its words without white space; runs of over ``UNIT`` characters (scripts without spaces, joined words) are cut into
labelled units that together cover them, so every character is read. State features of a unit: its letters (lexicon),
affixes up to three letters, all letter trigrams; learned weights are hashed to ``DIMS`` rows. Learned transitions link
the labels of neighbours. Forward-backward gives each unit its label distribution, so code-switched text gets a label per
word; a document takes the label with the most probability over its units with a letter (Unicode category L; digits,
fractions and numerals are none). A chain is ``CHAIN`` consecutive units at most; longer texts are several chains.

Training reads only text and lang of a bounded sample: per language ``SAMPLE_DOCS`` rows (the first by a hash of id and text
among those whose crc32 of the id mod 3 isn't 1), of each up to ``SAMPLE_CHARS`` characters, and of these at most
``2 * SAMPLE_DOCS`` chains a language; half of the chains are spliced from two languages so that transitions see switches.
The sample is found in one pass. Prediction reads whole texts and only the text. The model (``DIMS`` x languages floats)
is broadcast. Nothing is shuffled but the sample; only the number of languages is taken as bounded.

Null texts and texts without a letter: `und`, score 0. Null or repeated ids keep their rows (a null id is not
held out). With no labelled row every text is `und`. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.llm.common import documents, small_batches, text_or_empty

SAMPLE_DOCS = 300
SAMPLE_CHARS = 4_000
CHAIN = 64
DIMS = 1 << 15
EPOCHS = 25
CACHE_WORDS = 300_000
LEAST_SCORE = 0.35
UNIT = 24
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]*")


def letters(word: str) -> str:
    """The letters (Unicode category L) of a word, lower-cased."""
    w = _NOT_LETTERS.sub("", word.lower())
    return w if _PLAIN.fullmatch(w) else "".join(c for c in w if c.isalpha())


def units(text: str) -> list[str]:
    """What a chain is made of: words without white space; runs longer than ``UNIT`` are cut there, so together they cover the text."""
    words = text.split()
    if not words or max(map(len, words)) <= UNIT:
        return words
    return [w[i : i + UNIT] for w in words for i in range(0, len(w), UNIT)]


_MIX = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX[3]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return (h >> np.uint64(49)).astype(np.int64) & (DIMS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature) of the hashed features of all words, and which words have a letter; others have no feature."""
    own = [letters(w) for w in words]
    n = np.fromiter(map(len, own), np.int64, len(own))
    index = np.flatnonzero(n)
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n > 0
    n = n[index]
    c = np.frombuffer("".join(f"^{w}$" for w in own if w).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(n + 2) - (n + 2)
    nth = np.arange(len(c)) - np.repeat(first, n + 2)
    whole = np.add.reduceat(_slot(c * _MIX[0] + nth.astype(np.uint64) * _MIX[1], 0).astype(np.uint64) ** np.uint64(2) * _MIX[2] + c * _MIX[1], first)
    three = (c[:-2] * _MIX[0] + c[1:-1] * _MIX[1]) * _MIX[2] + c[2:]
    at = np.flatnonzero(nth[:-2] < np.repeat(n, n + 2)[:-2])
    owner, found = [index, np.repeat(index, n)], [_slot(whole, 1), _slot(three[at], 2)]
    for k in (1, 2, 3):
        use = np.flatnonzero(n >= k)
        for kind, start in ((2 * k + 1, first + 1), (2 * k + 2, first + 1 + n - k)):
            h = np.zeros(len(use), np.uint64)
            for i in range(k):
                h = h * _MIX[0] + c[start[use] + i]
            owner.append(index[use])
            found.append(_slot(h, kind))
    lettered = np.zeros(len(words), bool)
    lettered[index] = True
    return np.concatenate(owner), np.concatenate(found), lettered


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # DIMS x labels
    moves: np.ndarray  # labels x labels, log

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of words, and which have a letter."""
        owner, found, lettered = features(words)
        return np.stack([np.bincount(owner, self.weights[found, j], len(words)) for j in range(len(self.labels))], axis=1).astype(np.float32), lettered


def forward_backward(e: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains x steps x labels) and expected transitions, from log potentials; masked steps end a chain."""
    n, steps, labels = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
    a = np.exp(moves)
    alpha, beta = np.empty((n, steps, labels)), np.ones((n, steps, labels))
    alpha[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * p[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (p[:, t + 1] * beta[:, t + 1]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], x, 1.0)
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    left = alpha[:, :-1].reshape(-1, labels)
    right = (p[:, 1:] * beta[:, 1:]).reshape(-1, labels)
    z = ((left @ a) * right).sum(axis=1)
    use = mask[:, 1:].reshape(-1) / z
    return m, (left * use[:, None]).T @ right * a


def fit(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 1) -> Crf | None:
    """Adagrad on the log likelihood of chains; ``sample``: (text, label)."""
    sample = sorted({(t, g) for t, g in sample if t and g})
    labels = sorted({g for _, g in sample})
    if not labels:
        return None
    rnd, at = random.Random(seed), {g: i for i, g in enumerate(labels)}
    pieces: dict[str, list[list[str]]] = {g: [] for g in labels}
    for text, g in sample:
        words = units(text)
        pieces[g] += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
    chains: list[tuple[list[str], list[int]]] = []
    for g in labels:
        rnd.shuffle(pieces[g])
        for k, piece in enumerate(pieces[g][: 2 * SAMPLE_DOCS]):
            other = rnd.choice(labels)
            if k % 2 and pieces[other]:
                tail = rnd.choice(pieces[other])[: CHAIN // 2]
                piece = piece[: CHAIN // 2]
                chains.append((piece + tail, [at[g]] * len(piece) + [at[other]] * len(tail)))
            elif piece:
                chains.append((piece, [at[g]] * len(piece)))
    if not chains:
        return None
    n, k = len(chains), len(labels)
    mask = np.zeros((n, CHAIN), bool)
    gold = np.zeros((n, CHAIN), np.int64)
    for i, (words, tags) in enumerate(chains):
        mask[i, : len(words)] = True
        gold[i, : len(words)] = tags
    owner, flat, lettered = features([w for words, _ in chains for w in words])
    truth = np.zeros((n, CHAIN, k))
    truth[np.arange(n)[:, None], np.arange(CHAIN), gold] = 1
    pair = mask[:, 1:].reshape(-1)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1].reshape(-1)[pair], gold[:, 1:].reshape(-1)[pair]), 1)
    w, moves, wg, mg = np.zeros((DIMS, k)), np.zeros((k, k)), np.full((DIMS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        e = np.zeros((n, CHAIN, k))
        e[mask] = np.stack([np.bincount(owner, w[flat, j], len(lettered)) for j in range(k)], axis=1)
        marginal, expected = forward_backward(e, moves, mask)
        error = (truth - marginal)[mask]
        grad = np.stack([np.bincount(flat, error[owner, j], DIMS) for j in range(k)], axis=1) - 0.1 * w
        wg += grad**2
        w += 0.3 * grad / np.sqrt(wg)
        back = seen - expected - 0.1 * moves
        mg += back**2
        moves += 0.3 * back / np.sqrt(mg)
    return Crf(labels, w.astype(np.float32), moves)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Crf | None:
    """Fits the model on its sample, found in one pass: per language the first rows by a hash of id and text, combined map-side."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id", "text")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()
    if not counts:
        return None
    # Rows whose hash lies under the share of a language that gives some 2 * sample_docs distinct rows; then the least of them.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * sample_docs / max(1, r["n"])))])
    place = F.pmod(F.xxhash64(h), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = usable.where(place < F.element_at(share, F.col("lang"))).select("lang", F.substring("text", 1, sample_chars).alias("text"), h.alias("h")).distinct()
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("nth") <= sample_docs)
    return fit([(r["text"], r["lang"]) for r in first.select("text", "lang").collect()])


class Labeller:
    """Unit labels of many texts at once, with a bounded cache of word potentials."""

    def __init__(self, model: Crf, cache_words: int = CACHE_WORDS):
        self.model, self.limit = model, cache_words
        self.cache: dict[str, int] = {}
        self.table = np.zeros((cache_words, len(model.labels)), np.float32)
        self.lettered = np.zeros(cache_words, bool)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Potentials and letter flags of words."""
        cache = self.cache
        found = list(map(cache.get, words))
        if None in found:
            fresh = list({w for w, f in zip(words, found) if f is None})
            if len(cache) + len(fresh) > self.limit:
                cache.clear()
                fresh = list(set(words))
            if len(fresh) > self.limit:
                return self.model.emissions(words)
            e, letter = self.model.emissions(fresh)
            base = len(cache)
            self.table[base : base + len(fresh)], self.lettered[base : base + len(fresh)] = e, letter
            cache.update(zip(fresh, range(base, base + len(fresh))))
            found = list(map(cache.__getitem__, words))
        at = np.asarray(found, np.int64)
        return self.table[at], self.lettered[at]

    def marginals(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, marginals, has a letter) of each text."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(units(text or ""))
            size += len(group[-1])
            if size > 200_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        words = [w for g in group for w in g]
        if not words:
            yield from ((g, np.zeros((0, len(self.model.labels))), np.zeros(0, bool)) for g in group)
            return
        e, letter = self._ids(words)
        sizes = np.asarray([len(g) for g in group])
        chains = -(-sizes // CHAIN)
        nth = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chain = np.repeat(np.cumsum(chains) - chains, sizes) + nth // CHAIN
        mask = np.zeros((int(chains.sum()), CHAIN), bool)
        padded = np.zeros((*mask.shape, e.shape[1]), np.float32)
        mask[chain, nth % CHAIN] = True
        padded[chain, nth % CHAIN] = e
        m, _ = forward_backward(padded, self.model.moves, mask)
        m = m[chain, nth % CHAIN]
        end = np.cumsum(sizes)
        for g, a, b in zip(group, end - sizes, end):
            yield g, m[a:b], letter[a:b]


def label_words(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, words, labels (one per word; null where a word has no letter), lang_pred, score."""
    small_batches(docs.sparkSession)
    return _run(docs, model, True)


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    return _run(docs, model, False)


def _run(docs: DataFrame, model: Crf | None, words: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            preds, scores, all_words, all_labels = [], [], [], []
            if labeller is None:
                preds, scores = ["und"] * len(texts), [0.0] * len(texts)
                all_words = [units(t) for t in texts]
                all_labels = [[None] * len(w) for w in all_words]
            else:
                names = labeller.model.labels
                for own, m, letter in labeller.marginals(texts):
                    if letter.any():
                        mean = m[letter].mean(axis=0)
                        preds.append(names[int(mean.argmax())])
                        scores.append(float(min(1.0, mean.max())))
                    else:
                        preds.append("und")
                        scores.append(0.0)
                    if words:
                        all_words.append(own)
                        all_labels.append([names[i] if has else None for i, has in zip(m.argmax(axis=1).tolist(), letter.tolist())] if len(own) else [])
            columns: list[Any] = [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names_out = ["doc_id", "held_out", "lang_pred", "score"]
            if words:
                columns += [pa.array(all_words, pa.list_(pa.string())), pa.array(all_labels, pa.list_(pa.string()))]
                names_out += ["words", "labels"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + ", words array<string>, labels array<string>" * words
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text")).mapInArrow(label, schema)


def keep_known(docs: DataFrame, model: Crf | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` with a language of at least ``least_score``, their columns passed through. No model: no row goes."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            known = [bool(letter.any()) and m[letter].mean(axis=0).max() >= least_score for _, m, letter in labeller.marginals(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))
