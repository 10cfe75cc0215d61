import random

import pytest

WORDS = "the of and ration lumen sorel tavik orbit quen mira dolven pashe krit amber solan veda".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empties, odd spaces and characters, repeats, long texts."""
    rng = random.Random(9)
    long = sentence(rng, 20_000)
    return [
        None, "", " ", "\n", "a", "A b", "a b c", "a  b\n\nc\td\x0be\x0cf\r\ng", " lead", "trail ", "\n\n", "é É ß ÄÖ 中文 字 🙂  x y\x1cz\x85", "word" * 30_000, long, long, long.replace("of1 ", "OF1 ", 1),
        "'s don't I'll 123 456abc !!! ***", "<|endoftext|> x <|endoftext|>", sentence(rng, 80), sentence(rng, 80), "same line\nsame line\nother\n\nsame line", "x y z " * 40, "\x00\x01 zero", "1234567890 " * 20,
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """With a repeated row, a null id, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", 7, "x", True, i) for i, t in enumerate(edge_texts)]
    rows += [rows[3], rows[18], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score string, kept boolean, fp long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
