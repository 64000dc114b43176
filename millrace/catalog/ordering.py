"""Order, limits and the operators that depend on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import groups, history, ordering
from millrace.plans import phrases
from millrace.sources import files


@query("recent_runs_topk", "SELECT run, job, started FROM runs ORDER BY started DESC, job LIMIT 100", ("runs",))
def recent_runs_topk(t):
    return history.recent_runs(t.runs, 100).select("run", "job", "started")


@query("latest_run_per_job", "SELECT run, job, started, ended, succeeded FROM latest", ("latest",))
def latest_run_per_job(t):
    return history.latest_runs(t.runs).drop("log")


@query("history_page", """
    SELECT id, kind FROM (SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 3 <> 0)
    WHERE id BETWEEN (SELECT max(event_id) FROM events WHERE event_id % 3 <> 0) - 40 - 20 + 1
                 AND (SELECT max(event_id) FROM events WHERE event_id % 3 <> 0) - 40""")
def history_page(t):
    executions = t.events.filter("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return ordering.history_page(executions, begin=40)


@query("row_slice", """
    SELECT source, pos, n AS row, line FROM (
      SELECT *, sum(length(line)) OVER (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chars FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM lines) WHERE n >= 11 AND n < 1000)
    WHERE chars < 20000""", ("lines",))
def row_slice(t):
    return ordering.row_slice(t.lines, 11, 1000, inclusive=False, chars_of="line", max_chars=20000,
                              width=64 * 1048576).select("source", "pos", F.col("row"), "line")


@query("tail_lines", """
    SELECT source, pos, line, CAST(row_number() OVER (PARTITION BY source ORDER BY pos) AS INTEGER) AS rank FROM (
      SELECT * FROM lines WHERE length(trim(line)) > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) <= 60)""",
       ("lines",))
def tail_lines(t):
    return ordering.tail_lines(t.lines)


@query("tail_bytes", """
    SELECT source, pos, line FROM (
      SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS back,
             sum(strlen(line) + 1) OVER (PARTITION BY source) AS size FROM lines)
    WHERE size <= 50000 OR back < 50000""", ("lines",))
def tail_bytes(t):
    return ordering.tail_bytes(t.lines, 50000, width=64 * 1048576)


@query("sort_rows", """
    SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS BIGINT) AS rank
    FROM orders""")
def sort_rows(t):
    # The rank shows the order to a check that takes rows in any order.
    prices = t.orders.select("o_orderkey", "o_totalprice")
    return ordering.ranked(prices, [], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()])


@query("order_by_hour_score", """
    SELECT hour, ngram, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY hour ORDER BY round(score, 6), ngram) AS BIGINT) AS rank
    FROM scored WHERE score > 2.0""", ("scored",))
def order_by_hour_score(t):
    scores = phrases.phrase_scores(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log))).filter("score > 2.0")
    return ordering.ranked(scores.select("hour", "ngram", F.round("score", 6).alias("score")), ["hour"], ["score", "ngram"])


@query("consecutive_uniq", """
    SELECT event_id, event_type FROM events
    QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id)
         OR row_number() OVER (ORDER BY event_id) = 1""")
def consecutive_uniq(t):
    return ordering.consecutive_uniq(t.events.select("event_id", "event_type"), [], "event_id", "event_type")


@query("last_n_ring", """
    SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rank FROM (
      SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)""")
def last_n_ring(t):
    lines = t.events.select("user_id", "event_id", "event_type")
    return ordering.tail_lines(lines, 5, source="user_id", pos="event_id", text="event_type", keep_blank=True)


@query("runtime_series", """
    SELECT job, CAST(started AS DATE) AS day, CAST(epoch_us(ended) - epoch_us(started) AS BIGINT) // 60000000 AS minutes, started
    FROM runs WHERE succeeded QUALIFY count(*) OVER (PARTITION BY job) > 1""", ("runs",))
def runtime_series(t):
    return history.runtime_series(t.runs)


@query("sort_by_index", """
    SELECT o_custkey AS custkey, 1 AS index, o_orderkey AS id FROM orders
    UNION ALL SELECT c_custkey, 0, c_custkey FROM customer""")
def sort_by_index(t):
    both = files.tagged_union([t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_custkey").alias("id")),
                               t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("id"))])
    return groups.grouped_order(both, ["custkey"], ["index", "id"])
