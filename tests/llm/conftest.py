import pytest

TEXT = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "Ünïcode 中文 🙂 mixed TEXT"), (None, "no id here at all"),
           (6, "same words in the same row " * 4), (6, "same words in the same row " * 4)]


@pytest.fixture()
def docs(spark):
    def make(rows, schema=TEXT):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture()
def awkward(docs):
    """Null, empty and blank texts, a null id, equal rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["key", "node", "id", "mark", "start", "ids", "score", "row", "spans", "target", "w", "n_words", "first"]
    return docs(AWKWARD).withColumns({n: F.lit("x") for n in names})


def words(seed, n, size=400):
    import random
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(size) for _ in range(n))
