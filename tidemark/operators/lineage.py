"""Where results come from, read from the files their plans scan."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame


def edges(results: Mapping[str, DataFrame]) -> DataFrame:
    """(result, source): the tables each result reads."""
    found = sorted({(name, m[1]) for name, df in results.items() for f in df.inputFiles() if (m := re.search(r"/([^/]+)\.parquet(?:/|$)", f))})
    return next(iter(results.values())).sparkSession.createDataFrame(found, "result string, source string")


def commented(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """df with a comment in the metadata of its columns; unknown columns are an error."""
    if missing := set(comments) - set(df.columns):
        raise KeyError(f"no columns {sorted(missing)}")
    for c, text in comments.items():
        df = df.withMetadata(c, {"comment": text})
    return df
