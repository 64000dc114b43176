"""Rows told apart by what they hold: the id and two hashes of the text, the same in every scan of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = ("text_hash", "text_hash_2")
KEY = ("doc_id", *HASHES)


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text; null is a text of its own."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def same_row(value: str, keys: DataFrame) -> Column:
    """Whether the struct column ``value`` is a row with the key of a row of ``keys``."""
    text = F.col(f"{value}.text")
    return (F.col(f"{value}.doc_id").cast("bigint").eqNullSafe(keys["doc_id"])
            & (text_hashes(text)[0] == keys[HASHES[0]]) & (text_hashes(text)[1] == keys[HASHES[1]]))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (of one struct column ``value``) whose key is not among ``keys``."""
    return rows.join(keys, same_row("value", keys), "left_anti")


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (of one struct column ``value``) whose key is among ``keys``."""
    return rows.join(keys, same_row("value", keys), "left_semi")
