"""Awkward rows that every operator on documents must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog near the old river bank".split()


def text(n, seed=0):
    return " ".join(WORDS[(i * 7 + seed * 3 + i * i) % len(WORDS)] + ("" if i % 5 else str(seed)) for i in range(n))


AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "123 !!", "en", "s", 6), (5, "é", "fr", None, 1),
    (6, text(20000, 1), "en", "s", 1), (7, "a" * 50000, None, "s", 1), (8, text(50, 2), "en", "s", 1), (8, text(50, 2), "en", "s", 1),
    (None, text(50, 2), "en", "s", 1), (9, text(50, 2), "en", "s", 1), (10, "日本語 😀 \u0000 x", "xx", "s", 1),
]


def documents(spark, rows=AWKWARD, clash=True):
    """The rows, with further columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        df = df.selectExpr("*", "'x' AS score", "1 AS id", "2 AS label", "3 AS fp", "'r' AS row", "0 AS length", "'t' AS terms", "1 AS spans", "1 AS base")
    return df
