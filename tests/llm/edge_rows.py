"""Rows every operator must take: nulls, empty and long texts, repeated rows, columns named like results."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, fingerprint string, "
    "n_words string, tokens string, text_hash string, flags string, h string"
)
LONG = " ".join(f"word{i * 7919 % 5003} and so" for i in range(6000))
PASSAGE = " ".join(f"shared passage number {i} of the text" for i in range(12))


def rows() -> list[tuple]:
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, LONG), (6, "one"), (None, "a text whose id is null, " * 9), (7, PASSAGE),
        (8, "before it " + PASSAGE + " after it"), (9, "Ünïcödé ▁ text 🤗 \x00 with\r\nodd   bytes " * 12), (9, "another text of the same id " * 3),
        (6, "one"), (10, "x" * 5000), (None, None),
    ]
    return [(i, t, None, "s", 1, "k", "s", "f", "n", "t", "h", "g", "i") for i, t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
