import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, columns="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        return spark.createDataFrame(rows, columns)

    return make
