"""Row-wise operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import text
from millrace.operators import groups, rows
from millrace.plans import phrases
from millrace.session import written


@query("flat_map_pairs", """
    SELECT l_orderkey AS key, unnest(['quantity', 'price']) AS name, unnest([l_quantity, l_extendedprice]) AS value
    FROM lineitem WHERE l_returnflag <> 'N'""")
def flat_map_pairs(t):
    pairs = F.when(F.col("l_returnflag") != "N", F.array(
        F.struct(F.col("l_orderkey").alias("key"), F.lit("quantity").alias("name"), F.col("l_quantity").alias("value")),
        F.struct(F.col("l_orderkey").alias("key"), F.lit("price").alias("name"), F.col("l_extendedprice").alias("value"))))
    return rows.flat_map(t.lineitem, pairs)


@query("map_partition_init", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1.5, 2) AS scaled FROM lineitem")
def map_partition_init(t):
    def setup():
        factor = 1.5  # stands for what is costly to build and is built once per task

        def scale(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"l_orderkey": batch["l_orderkey"], "l_linenumber": batch["l_linenumber"],
                                 "scaled": (batch["l_quantity"] * factor).round(2)})
        return scale

    return rows.map_batches(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), setup,
                            "l_orderkey bigint, l_linenumber int, scaled double")


@query("filter_rows", "SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'R'")
def filter_rows(t):
    return rows.filter_rows(t.lineitem, (F.col("l_quantity") > 25) & (F.col("l_returnflag") != "R"))


@query("select_cols", "SELECT o_orderkey, o_orderstatus FROM orders")
def select_cols(t):
    return rows.select_present(t.orders, ["o_orderkey", "no_such_column", "o_orderstatus"])


@query("rename_cols", """
    SELECT o_orderkey AS id, o_custkey AS price, o_orderstatus, o_orderdate, o_orderpriority,
           CAST(NULL AS VARCHAR) AS extra FROM orders""")
def rename_cols(t):
    return rows.rename(t.orders, [("o_orderkey", "id"), ("o_totalprice", "price"), ("o_custkey", "price"),
                                  ("no_such_column", "extra")])


@query("project_cols", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
           round(round(l_extendedprice * (1 - l_discount), 4) * (1 + l_tax), 6) AS gross FROM lineitem""")
def project_cols(t):
    out = rows.project(t.lineitem, [("net", "round(l_extendedprice * (1 - l_discount), 4)"),
                                    ("gross", lambda: F.round(F.col("net") * (1 + F.col("l_tax")), 6))])
    return out.select("l_orderkey", "l_linenumber", "net", "gross")


@query("select_with_defaults", """
    SELECT c_custkey, c_name, 'EUR' AS currency, CAST(NULL AS VARCHAR) AS phone FROM customer""")
def select_with_defaults(t):
    return rows.select_or_default(t.customer, ["c_custkey", ("c_name", "nobody"), ("currency", "EUR"), "phone"])


@query("having_filter", """
    SELECT l_suppkey, CAST(count(*) AS BIGINT) AS items FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600""")
def having_filter(t):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("items"))
    return rows.filter_rows(counts, "items > 600")


@query("map_after_reduce", """
    SELECT o_custkey, unnest(['orders', 'spent']) AS name, unnest([CAST(n AS DOUBLE), round(s, 2)]) AS value
    FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)""")
def map_after_reduce(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return rows.flat_map(totals, F.array(
        F.struct(F.lit("orders").alias("name"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("spent").alias("name"), F.round("s", 2).alias("value"))), keep=["o_custkey"])


@query("rewrite_group_input", """
    SELECT l_suppkey % 10 AS bucket, CAST(sum(greatest(l_linenumber, 3)) AS BIGINT) AS total
    FROM lineitem GROUP BY l_suppkey % 10""")
def rewrite_group_input(t):
    # What a reducer's input wrapper does to key and values is done to the columns before grouping.
    rewritten = t.lineitem.select((F.col("l_suppkey") % 10).alias("bucket"),
                                  F.greatest("l_linenumber", F.lit(3)).alias("value"))
    return rewritten.groupBy("bucket").agg(F.sum("value").cast("bigint").alias("total"))


@query("rewrite_combiner", """
    SELECT l_suppkey, max(l_linenumber) * 10 AS top FROM lineitem GROUP BY l_suppkey""")
def rewrite_combiner(t):
    # Values are rewritten before they are combined and the combined value once more after.
    keyed = t.lineitem.select("l_suppkey", (F.col("l_linenumber") * 2).alias("value"))
    merged = groups.merge_by_key(keyed, ["l_suppkey"], groups.pairwise(["l_suppkey"], {"value": np.maximum}))
    return merged.select("l_suppkey", (F.col("value") * 5).alias("top"))


@query("clean_query_filter", r"""
    SELECT page_id, q FROM (SELECT page_id, unnest([url, html, '  ']) AS q FROM pages)
    WHERE length(trim(q)) > 0 AND NOT regexp_matches(q, '(?i)^\s*(https?://|ftp://|www\.)\S*')""")
def clean_query_filter(t):
    q = F.explode(F.array("url", "html", F.lit("  ")))
    return rows.filter_rows(t.pages.select("page_id", q.alias("q")), text.is_query("q"))


@query("positional_project", """
    SELECT o_orderdate AS day, o_orderkey AS id FROM orders""")
def positional_project(t):
    return rows.by_position(t.orders, [(4, "day"), (0, "id")])


@query("flatten_group", """
    SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""")
def flatten_group(t):
    grouped = t.orders.groupBy(F.struct("o_orderstatus", "o_orderpriority").alias("group")).agg(
        F.count(F.lit(1)).alias("n"))
    return grouped.select("group.*", "n")


@query("filter_score", "SELECT hour, ngram, round(score, 6) AS score FROM scored WHERE score > 2.0", ("scored",))
def filter_score(t):
    scores = phrases.phrase_scores(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log)))
    return rows.filter_rows(scores, "score > 2.0").select("hour", "ngram", F.round("score", 6).alias("score"))


@query("split_by_hour", """
    SELECT hour, CAST(count(*) AS BIGINT) AS phrases, CAST(sum("count") AS BIGINT) AS users
    FROM frequency WHERE hour IN ('00', '12') GROUP BY hour""", ("frequency",))
def split_by_hour(t):
    log = t.query_log.filter(text.extract_hour("time").isin("00", "12"))
    first, second = phrases.split_hours(written(phrases.hour_frequency(phrases.hourly_ngrams(log)), "frequency"))

    def summed(df):
        return df.groupBy("hour").agg(F.count(F.lit(1)).alias("phrases"), F.sum("count").alias("users"))

    return summed(first).unionByName(summed(second))


@query("required_fields_check", """
    SELECT event_id, array_to_string(list_filter([
        CASE WHEN event_id % 7 = 0 THEN 'type is missing' END,
        CASE WHEN event_id % 5 = 0 THEN 'value is not a double' END,
        CASE WHEN event_type IN ('error', 'signup') THEN 'state is not an allowed value' END,
        CASE WHEN event_id % 3 = 0 THEN 'at is not a time' END], lambda x: x IS NOT NULL), '; ') AS problems
    FROM events""")
def required_fields_check(t):
    k = F.col("event_id")
    fields = F.map_concat(
        F.when(k % 7 != 0, F.create_map(F.lit("type"), F.lit("event"))).otherwise(F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("value"), F.when(k % 5 == 0, F.lit("many")).otherwise(F.col("value").cast("string"))),
        F.create_map(F.lit("state"), F.col("event_type")),
        F.create_map(F.lit("at"), F.when(k % 3 == 0, F.lit("noon")).otherwise(F.col("ts").cast("string"))))
    checked = rows.missing_fields(
        t.events.select("event_id", fields.alias("fields")), present=["type"], kinds={"value": "double"},
        members={"state": ["click", "view", "purchase"]}, times=["at", "until"], optional=["until"])
    return checked.select("event_id", F.array_join("problems", "; ").alias("problems"))
