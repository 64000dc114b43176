"""Joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import graph, history, joins
from millrace.operators.joins import JoinInput
from millrace.plans import phrases
from millrace.session import written


@query("join_n_way", """
    SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS BIGINT) ELSE d.n_chars END AS size,
           e.event_type
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.user_id = d.doc_id""")
def join_n_way(t):
    labels = t.labels.withColumn("size", F.col("quality").cast("bigint"))
    return joins.join_inputs(["doc_id"], [
        JoinInput(t.documents.withColumnRenamed("n_chars", "size"), ["lang", "size"]),
        JoinInput(labels, ["quality", "toxic", "size"], unique=True),
        JoinInput(t.events.withColumnRenamed("user_id", "doc_id"), ["event_type"])])


@query("join_reduce", """
    SELECT l_orderkey, CAST(count(*) AS BIGINT) AS items, round(max(l_extendedprice), 2) AS dearest
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) > 1""")
def join_reduce(t):
    """Of each order with more than one item: how many, and the dearest."""
    def start(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.groupby("l_orderkey", as_index=False, dropna=False).agg(items=("l_extendedprice", "size"),
                                                                             dearest=("l_extendedprice", "max"))

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby("l_orderkey", as_index=False, dropna=False).agg({"items": "sum", "dearest": "max"})

    schema = "l_orderkey bigint, items bigint, dearest double"
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = joins.join_reduce(["l_orderkey"], [JoinInput(orders, ["o_custkey"]), JoinInput(t.lineitem, ["l_extendedprice"])],
                            start, schema, merge, lambda done: done[done["items"] > 1], schema, how="inner")
    return out.withColumn("dearest", F.round("dearest", 2))


def _record_orders(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The customer's row comes first; then, of its orders, each that is dearer than all before it."""
    segment, most = None, -math.inf
    for batch in batches:
        for source, name in zip(batch.column("input").to_pylist(), batch.column("segment").to_pylist()):
            if source:
                break
            segment = name
        orders = batch.filter(pc.equal(batch.column("input"), 1))
        price = orders.column("price").to_numpy()
        before = np.maximum.accumulate(np.append(most, price))
        if len(price) and segment is not None:
            new = orders.filter(pa.array(price > before[:-1]))
            yield pa.RecordBatch.from_pydict({"custkey": new.column("custkey"), "segment": pa.array([segment] * new.num_rows),
                                              "orderkey": new.column("orderkey"), "price": new.column("price")})
        most = before[-1]


@query("join_reduce_ordered", """
    SELECT custkey, c_mktsegment AS segment, orderkey, price FROM (
      SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price,
             max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders)
    JOIN customer ON c_custkey = custkey WHERE before IS NULL OR price > before""")
def join_reduce_ordered(t):
    customers = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"),
                             F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))
    return joins.join_reduce_ordered(["custkey"], [customers, orders], ["at", "orderkey"], _record_orders,
                                     "custkey bigint, segment string, orderkey bigint, price double")


@query("join_inner", """
    SELECT a.ngram, a."count" AS count00, b."count" AS count12
    FROM frequency a JOIN frequency b ON a.ngram = b.ngram AND a.hour = '00' AND b.hour = '12'""", ("frequency",))
def join_inner(t):
    return phrases.join_hours(written(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log)), "frequency"))


@query("unresolved_deps", """
    SELECT job, dep FROM (SELECT job, dep FROM edges
      UNION ALL SELECT 'p' || p_partkey, 'q' || p_partkey FROM part WHERE p_partkey % 10 = 3)
    WHERE dep NOT IN (SELECT job FROM nodes)""", ("nodes", "edges"))
def unresolved_deps(t):
    wrong = t.part.filter("p_partkey % 10 = 3").select(F.concat(F.lit("p"), "p_partkey").alias("job"),
                                                       F.concat(F.lit("q"), "p_partkey").alias("dep"))
    return graph.unresolved(t.edges.unionByName(wrong), t.nodes)


@query("root_jobs", "SELECT job FROM roots", ("roots",))
def root_jobs(t):
    return graph.roots(t.nodes, t.edges)


@query("run_with_job", """
    SELECT runs.run, runs.job, runs.started, c_name AS owner
    FROM runs LEFT JOIN customer ON runs.job = 'job' || c_custkey""", ("runs",))
def run_with_job(t):
    jobs = t.customer.select(F.concat(F.lit("job"), "c_custkey").alias("job"), F.col("c_name").alias("owner"))
    return history.with_jobs(t.runs.select("run", "job", "started"), jobs)


@query("failed_with_log_tail", """
    SELECT f.job, f.started, f.log, CAST(x.rank AS INTEGER) AS rank, x.line
    FROM (SELECT * FROM latest WHERE job IN (SELECT job FROM runs WHERE NOT succeeded)) f
    LEFT JOIN (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM (
        SELECT * FROM lines WHERE length(trim(line)) > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) <= 60)) x
    ON x.source = f.log""", ("latest", "lines"))
def failed_with_log_tail(t):
    return history.failed_with_tail(t.runs.filter("NOT succeeded").select("job"), t.runs,
                                    t.lines.withColumnRenamed("source", "log"))
