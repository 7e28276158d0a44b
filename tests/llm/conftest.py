import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in water river stream channel basin slope valley ridge terrain flow head reach bank gauge rain".split()


def story(k, n=80):
    return " ".join(WORDS[(k * 7 + i * i + i * k) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, ties, repeated rows, nulls, empty and white texts, a very long text."""
    out = [(k, story(k), "en", "s0", None) for k in range(40)]
    out += [(100 + k, "Der Fluß und das Tal mit dem Ufer, das über die Brücke geht " * 6 + str(k), "de", None, 5) for k in range(25)]
    out += [(200, story(3), "en", "s1", 1), (201, "  " + story(3).replace(" ", "\n") + "\n", "en", "s1", 1), (202, story(4) + " again", None, "s1", 1)]
    out += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \t\n ", "en", "s", 0), (303, "!!! 123 ...", "en", "s", 0), (304, "x", "en", "s", 0)]
    out += [(400, story(5) + " " + "very long " * 60_000, "en", "s", 0), (401, "a" * 50_000, "en", "s", 0), (402, "Ein Wort<|endoftext|>noch eins \u00e9\u0301 \U0001f600", "de", "s", 0)]
    out += [(0, story(0), "en", "s0", None), (None, story(9), "en", "s0", None), (None, "no id of its own here", "en", "s0", None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names the operators could use themselves."""
    from pyspark.sql import functions as F

    for c in ("row", "h", "digest", "norm", "fp", "n", "label", "kept", "score", "node", "root", "rank", "salt", "a.b", "__t"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    return docs
