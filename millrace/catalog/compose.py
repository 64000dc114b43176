"""User functions and steps put together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import tables, text
from millrace.operators import groups, rows
from millrace.plans import phrases, steps
from millrace.session import scratch_path, written
from millrace.sources import files


@query("udf_scalar", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part")
def udf_scalar(t):
    @F.pandas_udf("string")
    def title(names: pd.Series) -> pd.Series:
        return names.str[:1].str.upper() + names.str[1:]

    t.spark.udf.register("title", title)
    return steps.with_parameters(t.spark, "SELECT p_partkey, title(p_name) AS title FROM {part}", {}, part=t.part)


@query("udaf_custom", """
    SELECT l_suppkey, bit_or(1::BIGINT << l_linenumber) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey""")
def udaf_custom(t):
    return groups.group_fold(t.lineitem, ["l_suppkey"], [
        ("lines", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l_linenumber")), np.bitwise_or, "bigint"),
        ("total", F.col("l_linenumber"), np.add, "bigint")])


@query("udtf_flatten", r"""
    SELECT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS word FROM conversations) WHERE word <> ''""")
def udtf_flatten(t):
    return rows.flat_map(t.conversations, F.transform(F.filter(text.tokens("text"), lambda w: w != ""),
                                                      lambda w: F.struct(w.alias("word"))), keep=["conv_id", "turn"])


@query("udtf_lateral", r"""
    SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, word FROM (
      SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
        SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS words FROM conversations))""")
def udtf_lateral(t):
    """A table function called by name for each row."""
    tables.register(t.spark)
    return t.spark.sql("SELECT c.conv_id, c.turn, w.pos, w.word FROM {c} c, LATERAL flatten_words(c.text) w", c=t.conversations)


@query("udtf_partitioned", """
    SELECT conv_id, turn, role, after FROM (
      SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
    WHERE after <> role""")
def udtf_partitioned(t):
    """A table function over a table, its rows dealt by conversation and in the order of turns."""
    tables.register(t.spark)
    return t.spark.sql("SELECT * FROM exchanges(TABLE(SELECT conv_id, turn, role FROM {c}) PARTITION BY conv_id ORDER BY turn)",
                       c=t.conversations)


@query("compose_steps", """
    SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, round(sum(o_totalprice), 2) AS spent
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 3""")
def compose_steps(t):
    return steps.staged(
        t.orders,
        lambda df: rows.filter_rows(df, "o_orderstatus <> 'P'"),
        steps.columns_of(["o_custkey", "o_totalprice", "nothing"]),
        lambda df: groups.group_fold(df, ["o_custkey"], [("n", F.lit(1), "+", "int"), ("spent", F.col("o_totalprice"), "+", "double")]),
        steps.compose(lambda df: df.withColumn("spent", F.round("spent", 2)), lambda df: rows.filter_rows(df, "n > 3")))


@query("job_chain", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def job_chain(t):
    first, second, staging = (scratch_path(t.spark, n) for n in ("first", "second", "staging"))
    steps.run_in_order(
        lambda: files.staged_overwrite(t.orders.filter("o_totalprice > 100000").select("o_orderpriority"), first, staging, "a"),
        lambda: files.staged_overwrite(t.spark.read.parquet(first).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
                                       second, staging, "b"))
    return t.spark.read.parquet(second)


@query("parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.5 AND o_orderstatus = 'F'")
def parameters(t):
    return steps.with_parameters(
        t.spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= :least AND o_orderstatus = :status",
        {"least": 250000.5, "status": "F"}, orders=t.orders)


@query("job_settings", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def job_settings(t):
    path = scratch_path(t.spark, "set")
    with steps.settings(t.spark, {"spark.sql.shuffle.partitions": 4}):
        counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        rows.partitioned(counts, 2).write.parquet(path)
    return t.spark.read.parquet(path)


@query("typed_intermediate", """
    SELECT CAST(l_suppkey AS INTEGER) AS supplier, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_suppkey""")
def typed_intermediate(t):
    kept = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"))
    typed = steps.typed(rows.make_schema([("supplier", "'int32'"), ("quantity", "'int32'")]))(kept)
    return typed.groupBy("supplier").agg(F.sum("quantity").alias("quantity"))


@query("phrase_popularity", """
    SELECT hour, ngram, round(score, 6) AS score, "count", round(mean, 6) AS mean FROM scored WHERE score > 2.0""", ("scored",))
def phrase_popularity(t):
    return phrases.popular_phrases(t.query_log).withColumn("score", F.round("score", 6)).withColumn("mean", F.round("mean", 6))


@query("phrase_two_hours", """
    SELECT a.ngram, a."count" AS count00, b."count" AS count12
    FROM frequency a JOIN frequency b ON a.ngram = b.ngram AND a.hour = '00' AND b.hour = '12'""", ("frequency",))
def phrase_two_hours(t):
    return phrases.phrases_in_both_hours(t.query_log)


@query("progress_rows", """
    SELECT l_shipdate, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS passed
    FROM lineitem GROUP BY l_shipdate""")
def progress_rows(t):
    """Rows are counted as they pass on their way into a table, and the count is told with the result."""
    observed, seen = rows.counted(t.lineitem)
    days = written(observed.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n")), "days")
    return days.withColumn("passed", F.lit(seen.get["rows"]).cast("bigint"))
