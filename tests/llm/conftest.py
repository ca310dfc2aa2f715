import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of tables of documents: from a list of (id, text), with columns of clashing names."""

    def make(rows, clash=()):
        df = spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t)) for i, t in rows], KIND)
        for name in clash:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Null texts and ids, empty and blank texts, a very long one, ties and repeated rows.
@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{k % 977} token{k % 311}" for k in range(12000))
    return [
        (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, "The quick brown fox jumps over the lazy dog."),
        (6, "The quick brown fox jumps over the lazy dog."), (None, "a text without an id"), (7, "a" * 3000), (8, "naïve Ünïcode 中文字 👍🏽 don't\r\nI'll"), (9, "<|endoftext|> x <|endoftext|>"),
    ]
