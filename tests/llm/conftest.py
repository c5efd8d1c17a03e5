import pytest


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` or full rows, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] or ("en",)), "s", 1, 0, 0.5, "x", 7) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
            "n_words int, score double, fp string, found int")

    return build


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame([(*r, 0.5) for r in rows], "item_id long, text string, score double")


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
