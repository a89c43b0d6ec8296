from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Texts that every operator must bear: null, empty, blank, one word, repeated rows, control and wide characters.
ODD = [None, "", " \t\n\x0b\x0c\r ", "word", "word", "\x00\x1f", "ÀÉ ß 世界 \U0001f600 ΑΣ", "a" * 30_000, "x " * 20_000, "\n" * 500]


@pytest.fixture(scope="session")
def documents(spark: SparkSession) -> Callable[..., DataFrame]:
    """A table of the given texts; ids count up, languages and sources may be null, further columns have names that clash."""

    def make(texts: list, ids: list | None = None) -> DataFrame:
        rows = [
            (i if ids is None else ids[i], t, (None, "en", "de")[i % 3], (None, "s1")[i % 2], None) for i, t in enumerate(texts)
        ]
        made = spark.createDataFrame(rows, SCHEMA)
        return made.selectExpr("*", "1 AS n_words", "'x' AS text_hash", "2 AS bits", "'y' AS spans", "3 AS n_tokens", "4 AS kept")

    return make
