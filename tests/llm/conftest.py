import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, key string, n string, size string, score string, component string, h string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a very long text, clashing extra columns."""
    long = " ".join(f"w{i % 7919} x{i}" for i in range(150_000))
    base = "the quick brown fox jumps over the lazy dog while seven grey cats watch from the old stone wall near the river bank tonight"
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (None, base), (None, None), (6, long), (7, long + " end"), (8, "one"), (9, "two words"), (10, "é ü 漢字 \U0001f600 mixed   spaces　here and THERE")]
    return spark.createDataFrame([(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, "a", "b", "c", "d", "e", "f", "g", "h") for n, (i, t) in enumerate(rows)], EDGE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
