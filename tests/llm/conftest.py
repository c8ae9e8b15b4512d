import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(n, seed, words=60, vocabulary=400):
    import random

    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(vocab) for _ in range(words)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, special strings, and columns that clash with outputs."""
    long = " ".join(sentences(40, 9, 500))
    rows = [
        (1, None), (2, ""), (3, "   \n "), (4, long), (5, "one two three"), (5, "one two three"), (5, "another text of the same id"), (None, "no id at all here"), (None, None),
        (6, "<|endoftext|> it's “quoted” ΣΑΣ İ! ﬁ 𝄞"), (7, "12345 67890 !!!"), (8, "one two three"), (9, long),
    ]
    return spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t in rows], "doc_id long, text string, score double, n_tokens string, block long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
