"""Order, top rows, tails and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators import blocks
from millrace.session import scratch_path, written


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1.

    Rows are first cut to n per (key, salt), so no task gets a whole hot key; there are as many salts as shuffle
    partitions. A salt goes by a row's content and input partition: equal rows spread too, and a task that is run
    again does the same. For a small n Spark also cuts each input partition to n rows per key before either shuffle.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*hashable(df), F.spark_partition_id()), F.lit(salts))
    salted = df.withColumn("_salt", salt)
    inner = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    cut = salted.withColumn("_inner", inner).filter(F.col("_inner") <= n).drop("_inner", "_salt")
    return (cut.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(rank) <= n))


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash: all that hold no map."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def top_overall(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of the table: each task keeps n, then those are merged."""
    return df.orderBy(*order).limit(n)


def tail_lines(lines: DataFrame, n: int = fixed.TAIL_LINES, source: str = "source", pos: str = "pos",
               text: str = "line", keep_blank: bool = False) -> DataFrame:
    """The last n lines of each source in their order, numbered from 1; blank lines do not count."""
    kept = lines if keep_blank else lines.filter(F.length(F.trim(text)) > 0)
    last = top_per_key(kept, [source], [F.col(pos).desc()], n, "_back")
    # At most n rows per source are left, so a plain window is safe from here on.
    return (last.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(pos))).drop("_back"))


def tail_bytes(lines: DataFrame, limit: int = fixed.TAIL_BYTES, source: str = "source", pos: str = "pos",
               text: str = "line", width: int | str = blocks.DEFAULT_WIDTH) -> DataFrame:
    """The whole lines within the last ``limit`` bytes of each source. A line counts its newline."""
    sized = lines.withColumn("_bytes", (F.octet_length(text) + 1).cast("bigint"))
    summed = blocks.running_sum(sized, [source], pos, "_bytes", "_from_end", width, from_end=True, stop_at=limit)
    total = sized.groupBy(F.col(source).alias("_of")).agg(F.sum("_bytes").alias("_size"))
    # A file cut inside a line starts at the next full one; a cut right before a line drops that line too.
    return (summed.join(total, F.col(source).eqNullSafe(F.col("_of")))
            .filter((F.col("_from_end") < limit) | (F.col("_size") <= limit))
            .drop("_bytes", "_from_end", "_of", "_size"))


def row_slice(rows: DataFrame, start: int = 1, end: int = fixed.PREVIEW_ROWS, source: str = "source",
              pos: str = "pos", inclusive: bool = True, chars_of: str | None = None,
              max_chars: int = fixed.PREVIEW_CHARS, width: int | str = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Rows ``start`` .. ``end`` of each source, numbered from 1 within the source.

    Records include row ``end``; text does not, and also stops before the line at which the characters
    shown would reach ``max_chars``.
    """
    last = end if inclusive else end - 1
    numbered = blocks.numbered(rows, [source], pos, "row", width, stop_at=last)
    out = numbered.filter(F.col("row").between(start, last))
    if chars_of is not None:
        out = blocks.running_sum(out, [source], "row", F.length(chars_of), "_chars", stop_at=max_chars - 1).drop("_chars")
    return out


def consecutive_uniq(rows: DataFrame, keys: Sequence[str], pos: str, value: Column | str,
                     width: int | str = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Drop each row whose value equals that of the row before it. No rows give no rows."""
    return blocks.first_of_runs(rows, keys, pos, value, width)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Number the rows of each key from 1 in any order, without a task per key."""
    return summed(df, keys, order, F.lit(1).cast("bigint"), out)


def summed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column | str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over a key's rows up to and including this one in any order, without a task per key.

    The table is sorted by range and written; the files then are the blocks in which rows are summed. Only the key that
    a file begins with can have rows in files before it, so there is at most one carried sum for each file.
    """
    path = scratch_path(df.sparkSession, "ranked")
    df.orderBy(*keys, *order).write.parquet(path)
    part = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"),
                    F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).try_cast("int").alias("file"),
                    F.col("_metadata.file_block_start").alias("start"))
    # A struct is never null itself, so rows with a null key join and group like any other.
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    rows = (df.sparkSession.read.schema(df.schema).parquet(path)
            .select(*df.columns, key.alias("_key"), part.alias("_part"), F.monotonically_increasing_id().alias("_pos"))
            .withColumn("_value", F.col(value) if isinstance(value, str) else value))
    first = written(rows.groupBy("_part").agg(F.min("_key").alias("_key")), "first")
    earlier = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = written(rows.join(first.select("_key").distinct(), "_key", "left_semi").groupBy("_key", "_part")
                      .agg(F.sum("_value").alias("_total")).withColumn("_carry", F.sum("_total").over(earlier))
                      .join(first, ["_key", "_part"], "left_semi").filter("_carry IS NOT NULL").select("_key", "_part", "_carry"), "carried")
    inside = W.partitionBy(*(keys or [F.lit(0)]), "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.withColumn(out, F.sum("_value").over(inside)).join(carried, ["_key", "_part"], "left")
            .withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_key", "_part", "_pos", "_value", "_carry")
            .select(*df.columns, out))


def sort_rows(df: DataFrame, *order: Column | str, reverse: bool = False) -> DataFrame:
    """Sorted by range over all tasks."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*[c.desc() for c in columns]) if reverse else df.orderBy(*columns)


def history_page(df: DataFrame, key: str = "id", begin: int = 0, size: int = fixed.HISTORY_PAGE_ROWS) -> DataFrame:
    """``size`` ids down from the greatest minus ``begin``, newest first; ids that do not exist leave gaps."""
    greatest = df.agg(F.max(key)).scalar()
    return (df.filter(F.col(key).between(greatest - (begin + size - 1), greatest - begin))
            .orderBy(F.col(key).desc()))
