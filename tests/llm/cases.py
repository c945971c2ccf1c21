"""Small inputs with what real tables bring: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, at string, length string, n long, words string, part string"
EXTRA = (1, "r", "a", "l", 2, "w", "p")


def rows(texts, lang="en", source="s"):
    return [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]


def frame(spark, texts=None, data=None, parts=3):
    data = rows(texts) if data is None else data
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def nasty():
    rnd = random.Random(7)
    bits = ["the", "a", " ", "  ", "\n", "\t", " ", "　", "é", "don't", "we'll", "###", "<|endoftext|>", "<s>", "▁", "x1", "日本", "🙂", "\x1c", "\x85", "!?", "0"]
    made = ["".join(rnd.choice(bits) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    return [None, "", " ", "  ", "a ", " a", "a  b ", "\n", " \n x", "word " * 3000, "z" * 5000, *made]


def hazards():
    data = rows([None, "", "one", "a b c d e f g h i j k l", "same text here", "same text here"])
    data.append((None, "no id at all", None, None, None, *EXTRA))
    data.append(data[4])
    data.append((3, None, None, None, None, *EXTRA))
    return data
