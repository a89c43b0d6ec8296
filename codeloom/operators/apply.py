"""User functions over file rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def for_each_file(
    files: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run a user handler over batches of file rows; ``factory`` makes one handler per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handle = factory()
        for batch in batches:
            yield handle(batch)

    return files.mapInPandas(run, schema)
