"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import json_text
from millrace.operators import config as cfg
from millrace.plans import phrases
from millrace.session import scratch_path, written
from millrace.sources import files


@query("union_paths", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_paths(t):
    a, b = scratch_path(t.spark, "customers"), scratch_path(t.spark, "suppliers")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.parquet(a)
    t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.parquet(b)
    return files.union_paths(t.spark, f"{a},{b}")


@query("except_jobs", "SELECT job FROM nodes EXCEPT SELECT dep FROM edges", ("nodes", "edges"))
def except_jobs(t):
    return t.nodes.subtract(t.edges.select("dep"))


@query("intersect_phrases", """
    SELECT ngram FROM frequency WHERE hour = '00' INTERSECT SELECT ngram FROM frequency WHERE hour = '12'""", ("frequency",))
def intersect_phrases(t):
    return phrases.phrases_in_common(written(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log)), "frequency"))


@query("config_equal", """
    SELECT scope, bool_and(a IS NOT DISTINCT FROM b) AS equal FROM (
      SELECT scope, key, value AS a, CASE WHEN key = 'owner' THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE value END AS b FROM effective)
    GROUP BY scope""", ("effective",))
def config_equal(t):
    effective = cfg.effective(t.config, cfg.chains(t.scopes))
    other_owner = t.nation.filter("n_nationkey = 3").select("n_name").scalar()
    other = effective.withColumn("value", F.when(F.col("key") == "owner", other_owner).otherwise(F.col("value")))
    return cfg.equal_sets(effective, other)


@query("doc_equal", """
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 <> 0 AND event_id % 5 <> 0 END AS equal FROM events""")
def doc_equal(t):
    k = F.col("event_id")
    left = F.concat(F.lit('{"id": '), k, F.lit(', "tags": ["a", 1, true], "in": '), "props", F.lit("}"))
    # Keys in another order and numbers as texts are equal; another value or another order of a list is not.
    tags = F.when(k % 5 == 0, F.lit('[1, "a", true]')).otherwise(F.lit('["a","1",true]'))
    right = F.concat(F.lit('{"tags":'), tags, F.lit(',"in":'), "props", F.lit(',"id":"'),
                     F.when(k % 3 == 0, k + 1).otherwise(k), F.lit('"}'))
    # What is no document, or names a key twice, is equal to nothing, not even to another such.
    left = F.when(k % 14 == 0, F.lit("{bad")).when(k % 7 == 0, F.lit('{"a": 1, "a": 2}')).otherwise(left)
    right = F.when(k % 7 == 0, F.lit("[oops")).otherwise(right)
    return t.events.select("event_id", json_text.same_document(left, right).alias("equal"))
