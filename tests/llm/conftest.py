"""A small table with every awkward case, and helpers that the tests of this folder share."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row string, body string, "
          "found string, rank long, cell long, base long, part long, shard string, words string, made string, n long, n_words string")


def prose(seed, words=120, vocabulary=4000):
    rng = random.Random(seed)
    names = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
             for _ in range(vocabulary)]
    out = [rng.choice(names) for _ in range(words)]
    return " ".join(w + (".\n" if i % 17 == 16 else "") for i, w in enumerate(out)) + "."


def texts():
    p, q = prose(1), prose(2)
    edited = q.split(" ")
    edited[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "word"), (5, "two words"), (6, p), (7, p), (7, p), (None, p),
        (None, None), (8, q), (9, " ".join(edited)), (10, prose(3, 20000)), (11, "no blanks" * 5000), (12, "é" * 70 + " ß ﬁ " + q[:90]),
        (13, "a b c d e f g h " * 30), (14, "Home | News | Sport | Weather | More\n" * 3 + prose(4, 60)), (15, "WE SHOUT HERE " * 20),
        (16, "x ### y $$$ z %%% w &&& v *** u " * 8), (17, q.upper()), (18, prose(5) + "\n" + p[:300] + "\n" + prose(6)),
        (19, "\x00\x01 control   and 𝒳 astral " + prose(7, 40)), (20, "<|endoftext|> as text <|endoftext|>"), (-3, prose(8)),
        (2 ** 62, prose(8) + " longer"),
    ]


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "k", "r", "b", "f", 1, 2, 3, 4, "s", "w", "m", 5, "n") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge(spark):
    return table(spark, texts())


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def tables(spark, sf):
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "pages", "benchmark", "conversations")}
