"""Word count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed


def word_count(lines: DataFrame, text: str = "line") -> DataFrame:
    """(word, count). Counts are combined before the shuffle."""
    return (lines.select(F.explode(F.split(text, fixed.WORD_SEPARATORS)).alias("word")).filter("word <> ''")
            .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
