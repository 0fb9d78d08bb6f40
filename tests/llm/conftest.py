import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards hex a jovial king and then nine more run away"


def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies and near copies, odd characters."""
    long_text = " ".join(f"word{i % 997} {PROSE.split()[i % 21]}" for i in range(9000))
    near = PROSE * 6
    texts = [
        (1, near), (2, near), (2, near), (3, near + " end"), (4, None), (5, ""), (6, "   "), (7, " \n\t\n "), (None, near),
        (None, None), (8, "a" * 3000), (9, "a" * 3000 + "b"), (10, "Ünïcödé Σς 日本 😀 ½ <|endoftext|> it's ▁x  y "),
        (11, long_text), (12, "x" + long_text), (13, "one two"), (14, "one two\none two\nthree"), (15, "# * $ % & | < >"),
        (16, "tab\tand\x0bvertical\x0cform\rreturn"), (17, "\x00null\x00byte"), (18, "é" * 80), (19, "éé" + "é" * 80 + "z"),
    ]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "web", None if t is None else len(t)) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names of results and of helpers."""
    extra = {n: odd["n_chars"] for n in "k1 k2 score kept spans row offset sequence_id pieces units n_words prints node key removed".split()}
    return odd.withColumns(extra)
