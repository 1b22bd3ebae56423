"""Text rules under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fuzzy


def register_functions(spark: SparkSession) -> list[str]:
    """Register the Python-backed functions and the chunk table function.

    Rules that are plain expressions are created as SQL functions, so they stay
    inside generated code.
    """
    @F.pandas_udf("double")
    def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    spark.udf.register("text_similarity", text_similarity)

    class Chunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
            if size <= overlap + 100:
                raise ValueError("chunk size must exceed the overlap by more than the look-back of 100")
            start, n, i = 0, len(text or ""), 0
            while start < n:
                end = min(start + size, n)
                if end < n:
                    cut = max(text.rfind(c, end - 100, end) for c in ".!?\n")
                    end = cut + 1 if cut >= 0 else end
                yield i, start, end, text[start:end]
                i, start = i + 1, (end - overlap if end < n else end)

    spark.udtf.register("chunk_text", F.udtf(Chunks, returnType="chunk_index int, start int, end int, chunk string"))
    for name, body in {
        "normalize_text(t STRING) RETURNS STRING": r"lower(trim(regexp_replace(t, r'\s+', ' ')))",
        "title_key(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(coalesce(t, '')), r'[^a-z0-9]+', ' '))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
    return ["text_similarity", "chunk_text", "normalize_text", "title_key"]
