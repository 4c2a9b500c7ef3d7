"""Small tables with nulls, empty and long texts, repeated rows and clashing column names."""

DOCS = "doc_id long, text string, lang string, row int, bucket string, score double, shard string"


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 10007}" for i in range(n))


def texts():
    base = words(300, 1)
    return [
        (1, base), (2, base), (3, base.upper()), (4, base.replace("w7919", "other")),
        (5, None), (6, ""), (7, "   \n\t "), (8, "one two three"), (9, "one  two\nthree"),
        (10, "One two three four five six"), (11, words(20_000, 2)), (12, words(20_000, 2) + " tail"),
        (13, "Ärger über Öl. " * 40), (14, "a\nb\n\nc\n"), (15, "x"), (15, "x"), (16, "x" * 5000),
        (None, base), (None, None), (17, words(300, 3)), (18, words(310, 3)), (-5, "<|endoftext|> AB<|endoftext|>c"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", 1, "b", 0.5, "s") for i, t in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
