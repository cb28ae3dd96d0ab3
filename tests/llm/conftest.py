import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, ties, other scripts, and columns whose names clash with the operators' own."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 3), (4, "one", "en", None, 3),
        (5, "same words again and again here", "en", "s", 31), (5, "same words again and again here", "en", "s", 31),
        (6, "same words again and again here", None, "s", 31), (7, long_text, "en", "s", len(long_text)),
        (8, "日本語の文章です é ü 🙂🙂", "ja", "s", 16), (None, "text without a key", "en", "s", 18), (9, "1234 5678 !!", "en", "s", 12),
        (10, "aaaaaaaa" * 50, "en", "s", 400), (11, "<|endoftext|> two  spaces \u00a0 and\u2003more ", "en", "s", 30),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["key", "id", "row", "part", "hash", "component_id", "n_words", "start", "bucket", "score", "first", "row_no", "p"]
    for c in clash:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
