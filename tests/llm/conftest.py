import pytest

from logweir.llm import common


@pytest.fixture(autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture
def documents(spark):
    """Documents with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame(
            [(*r, "x", b"t", i) for i, r in enumerate(rows)],
            "doc_id bigint, text string, lang string, source string, row string, t binary, "
            "n_words int")

    return make
