import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=True):
        """Documents with columns whose names clash with those the operators use inside."""
        df = spark.createDataFrame([(d, t, "en", None, len(t) if t else None) for d, t in rows], SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({"in": F.lit(1), "k": F.lit("x"), "tokens": F.lit(None).cast("int"), "row": F.lit(2)}) if extra else df

    return docs


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, tied, accented and repeated texts."""
    base = "the quick brown fox jumps over the lazy dog and runs far away into deep green woods where owls sleep all day long"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base.upper()), (7, "é ß 漢字 " * 40), (8, "x" * 5000), (9, base + " " + base),
        (10, "one two three"), (11, "one two three"), (12, "a\n\n\na\na b\na b\n" * 30), (13, base.replace("fox", "cat")), (14, "Word, " * 20000),
        (15, "tail " + base + " tail"), (16, "　wide　space 12 34"), (17, "🙂 emoji 🙂 " * 10 + base), (18, base[: len(base) // 2]), (18, base[: len(base) // 2]),
    ]
