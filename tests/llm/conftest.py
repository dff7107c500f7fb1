import pytest

#: Nulls, empties, short, repeated and equal rows, and clashing column names.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 5),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 5),
    (2, None, None, None, None),
    (3, "", "en", "s2", 0),
    (4, " \n\t ", "en", "s2", 4),
    (5, "one two", "de", "s1", 7),
    (6, "ONE two", "de", None, 7),
    (None, "a text without an id but with words", "en", "s1", 3),
    (7, "password = \"abcdef123456ghij\" and the MIT License, é世", "en", "s3", 9),
    (8, "word " * 3000, "en", "s1", 15000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in ("id", "row", "s", "a", "n", "hash", "bucket", "tag", "keep", "found", "words", "_id", "size", "label")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
