"""Streams over the provided files, run until all of them have been taken in."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.catalog.registry import query
from millrace.operators import ordering
from millrace.session import scratch_path
from millrace.streaming import state


def _event_stream(t):
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(_split_up(t))


def _split_up(t):
    """The events as several files, so that they come in several micro-batches."""
    path = scratch_path(t.spark, "arriving")
    t.events.repartitionByRange(4, "event_id").write.parquet(path)
    return path


def _drained(t, rows, reduce, merge):
    """A stream without state: batches are reduced, their sets merged."""
    target, checkpoint = scratch_path(t.spark, "updates"), scratch_path(t.spark, "progress")
    state.start_updates(rows, target, checkpoint, reduce=reduce, merge=merge, compact_every=2).awaitTermination()
    schema = reduce(t.spark.createDataFrame([], rows.schema)).schema
    state.compact(t.spark, target, merge, schema)
    return state.read_updates(t.spark, target, merge, schema)


@query("stream_latest_state", """
    SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id""")
def stream_latest_state(t):
    saves = _event_stream(t).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return _drained(t, saves, state.latest_state, state.merged_state)


@query("stream_last_n", """
    SELECT 'user' || user_id AS source, event_id AS pos, event_type AS line,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rank FROM (
      SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30)""")
def stream_last_n(t):
    lines = _event_stream(t).select(F.concat(F.lit("user"), "user_id").alias("source"), F.col("event_id").alias("pos"),
                                    F.col("event_type").alias("line"))
    cut = state.newest_lines()
    return ordering.tail_lines(_drained(t, lines, cut, cut), fixed.RING_LINES, keep_blank=True)


@query("stream_run_stats", """
    SELECT 'job' || user_id AS job, CAST(count(*) AS BIGINT) AS runs,
           CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS successes FROM events GROUP BY user_id""")
def stream_run_stats(t):
    runs = _event_stream(t).select(F.concat(F.lit("job"), "user_id").alias("job"), (F.col("event_type") != "error").alias("succeeded"))
    return _drained(t, runs, state.run_stats, state.merged_stats)
