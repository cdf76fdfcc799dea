"""Small hostile inputs shared by the operator tests."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, score double, copies long"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", 0.5, 3) for i, t, s in rows], DOC_SCHEMA)


def words(n, start=0):
    return " ".join(f"w{k}" for k in range(start, start + n))


HOSTILE = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "b"), (4, words(50), "a"), (4, words(50), "a"), (5, words(50), None), (None, words(50), "b"), (None, None, None),
    (6, "one", "a"), (7, words(30_000), "b"), (8, "naïve Ünïcode \U0001f600 zero\x00byte", "c"), (9, "A" * 20_000, "c"),
]
