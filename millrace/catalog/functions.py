"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import config_values, json_text, numbers, status, text, times


@query("fn_cut", r"""
    SELECT event_id, nullif(parts[1], '') AS f0, parts[3] AS f2, parts[9] AS f8 FROM (
      SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [event_type] ELSE [event_type, '', CAST(user_id AS VARCHAR)] END AS parts FROM events)""")
def fn_cut(t):
    line = F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit("\t\t"))) \
        .otherwise(F.concat("event_type", F.lit("\t\t"), "user_id", F.lit("\t")))
    return t.events.select("event_id", text.cut(line, [0, 2, 8]).alias("c")).select(
        "event_id", F.get("c", F.lit(0)).alias("f0"), F.get("c", F.lit(1)).alias("f2"), F.get("c", F.lit(2)).alias("f8"))


@query("fn_assoc", """
    SELECT o_orderkey, array_to_string([o_orderstatus, upper('x') || o_orderstatus, o_orderpriority, 'X' || o_orderpriority], '|') AS out FROM orders""")
def fn_assoc(t):
    arr = F.array("o_orderstatus", "o_orderstatus", "o_orderpriority", "o_orderpriority")
    return t.orders.select("o_orderkey", F.array_join(
        text.apply_at(arr, lambda x: F.concat(F.lit("X"), x), [1, 3]), "|").alias("out"))


@query("fn_tokenize_ws", r"""
    SELECT doc_id, CAST(len(ws) AS INTEGER) AS n, array_to_string(ws, '|') AS joined FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents)""")
def fn_tokenize_ws(t):
    ws = text.tokens("text")
    return t.documents.select("doc_id", F.size(ws).alias("n"), F.array_join(ws, "|").alias("joined"))


@query("fn_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def fn_lower(t):
    return t.documents.select("doc_id", F.lower("text").alias("text"))


@query("fn_extract_hour", """SELECT "time", substr("time", 7, 2) AS hour FROM query_log""", ("query_log",))
def fn_extract_hour(t):
    return t.query_log.select("time", text.extract_hour("time").alias("hour"))


@query("fn_ngrams", """
    SELECT doc_id, gram FROM (SELECT DISTINCT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram
      FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))""".replace("\\\\", "\\"))
def fn_ngrams(t):
    return t.documents.select("doc_id", text.words("text").alias("words")).select(
        "doc_id", F.explode(text.ngrams("words")).alias("gram"))


@query("fn_shell_quote", r"""SELECT event_id, '"' || replace(props, '"', '\"') || '"' AS quoted FROM events""")
def fn_shell_quote(t):
    return t.events.select("event_id", text.shell_quote("props", '"').alias("quoted"))


@query("fn_null_or_empty", """
    SELECT event_id, event_id % 3 < 2 AS empty, event_id % 3 = 0 AS missing FROM events""")
def fn_null_or_empty(t):
    s = F.when(F.col("event_id") % 3 == 1, F.lit("")).when(F.col("event_id") % 3 == 2, F.col("event_type"))
    return t.events.select("event_id", text.is_null_or_empty(s).alias("empty"), s.isNull().alias("missing"))


@query("fn_format_dates", """
    SELECT event_id, strftime(ts, '%m-%d-%Y') AS day, strftime(ts, '%m-%d-%Y %H:%M:%S') AS moment, strftime(ts, '%Y.%m') AS month FROM events""")
def fn_format_dates(t):
    return t.events.select("event_id", times.format_date("ts").alias("day"), times.format_time("ts").alias("moment"),
                           times.format_date("ts", "yyyy.MM").alias("month"))


_ELAPSED = """CASE WHEN m // 60 <> 0 THEN (m // 60) || CASE WHEN m // 60 = 1 THEN ' hour, ' ELSE ' hours, ' END ELSE '' END
      || (m % 60) || CASE WHEN m % 60 = 1 THEN ' minute' ELSE ' minutes' END"""


@query("fn_format_period", f"""
    SELECT run, {_ELAPSED} AS shown FROM (SELECT run, (epoch_us(ended) - epoch_us(started)) // 60000000 AS m FROM runs)""", ("runs",))
def fn_format_period(t):
    return t.runs.select("run", times.format_between("started", "ended").alias("shown"))


@query("fn_duration_minutes", """
    SELECT run, CAST((epoch_us(ended) - epoch_us(started)) // 60000000 AS BIGINT) AS minutes FROM runs""", ("runs",))
def fn_duration_minutes(t):
    return t.runs.select("run", times.minutes_between("started", "ended").alias("minutes"))


@query("fn_date_parts", """
    SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
           strftime(ts, '%M') AS minute, strftime(ts, '%S') AS seconds, strftime(ts, '%g') AS milliseconds FROM events""")
def fn_date_parts(t):
    # The zone is that of the session, which a table of times without zone says nothing about.
    return t.events.select("event_id", *times.date_parts("ts")).drop("timezone")


@query("fn_parse_period", """
    SELECT name, CASE WHEN period <> 'n' THEN CAST(left(period, -1) AS INTEGER) END AS n,
           CASE WHEN period <> 'n' THEN right(period, 1) END AS unit, secs AS seconds FROM timed""", ("timed",))
def fn_parse_period(t):
    p = times.parse_period("period")
    return t.schedules.select("name", p.getField("n").alias("n"), p.getField("unit").alias("unit"),
                              times.period_seconds(p).alias("seconds"))


@query("fn_print_period", "SELECT name, period AS printed FROM schedules", ("schedules",))
def fn_print_period(t):
    return t.schedules.select("name", times.print_period(times.parse_period("period")).alias("printed"))


@query("fn_display_bytes", r"""
    SELECT o_orderkey, CASE WHEN s >= 1024 ^ 4 THEN regexp_replace(format('{:,.2f}', s / 1024.0 ^ 4), '\.?0+$', '') || ' tb'
      WHEN s >= 1024 ^ 3 THEN regexp_replace(format('{:,.2f}', s / 1024.0 ^ 3), '\.?0+$', '') || ' gb'
      WHEN s >= 1024 ^ 2 THEN regexp_replace(format('{:,.2f}', s / 1024.0 ^ 2), '\.?0+$', '') || ' mb'
      WHEN s >= 1024 THEN regexp_replace(format('{:,.2f}', s / 1024.0), '\.?0+$', '') || ' kb' ELSE s || ' B' END AS shown
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN o_orderkey * 3 + 1024
            WHEN 2 THEN o_orderkey * 7001 + 1048576 WHEN 3 THEN o_orderkey * 77777 + 1073741824
            ELSE (o_orderkey * 12345 + 1100000000000) * 3 END AS s FROM orders)""")
def fn_display_bytes(t):
    k = F.col("o_orderkey")
    size = (F.when(k % 5 == 0, k % 1024).when(k % 5 == 1, k * 3 + 1024).when(k % 5 == 2, k * 7001 + 1048576)
            .when(k % 5 == 3, k * 77777 + 1073741824).otherwise((k * 12345 + 1100000000000) * 3))
    return t.orders.select("o_orderkey", numbers.display_bytes(size).alias("shown"))


@query("fn_parse_bytes", """
    SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN NULL ELSE CAST(p_size AS BIGINT) *
      CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 WHEN 4 THEN 1048576
                         WHEN 5 THEN 1073741824 WHEN 6 THEN 1073741824 END END AS bytes FROM part""")
def fn_parse_bytes(t):
    units = F.array(*[F.lit(u) for u in ["", "k", "KB", "m", "mb ", "g", "Gb", "parsecs"]])
    unit = F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", numbers.parse_bytes(F.concat("p_size", unit)).alias("bytes"))


@query("fn_format_percent", r"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           regexp_replace(format('{:,.1f}', l_quantity / 7.0 * 100), '\.?0+$', '') || '%' AS shown FROM lineitem""")
def fn_format_percent(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             numbers.format_percent(F.col("l_quantity") / 7.0, 1).alias("shown"))


@query("fn_ellipsify", """
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS short FROM documents""")
def fn_ellipsify(t):
    return t.documents.select("doc_id", text.ellipsify(F.when(F.col("doc_id") % 5 != 0, F.col("text")), 40).alias("short"))


@query("fn_newline_to_br", r"SELECT doc_id, regexp_replace(text, '[\r\n]', '<br/>', 'g') AS html FROM documents")
def fn_newline_to_br(t):
    return t.documents.select("doc_id", text.newline_to_br("text").alias("html"))


@query("fn_repeat_seq", """
    SELECT p_partkey, repeat(p_type, p_size % 4) AS repeated, CAST(unnest(range(p_size % 4 + 1)) AS INTEGER) AS i FROM part""")
def fn_repeat_seq(t):
    n = F.col("p_size") % 4
    return t.part.select("p_partkey", text.repeated("p_type", n).alias("repeated"),
                         F.explode(text.counting(n + 1)).alias("i"))


@query("fn_arith", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_suppkey AS sum, l_partkey - l_suppkey AS diff, l_partkey * l_suppkey AS prod,
           l_partkey // (l_linenumber + 1) AS quot, l_partkey % (l_linenumber + 1) AS rest, greatest(l_partkey, l_suppkey) AS top
    FROM lineitem""")
def fn_arith(t):
    d = F.col("l_linenumber").cast("bigint") + 1
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             numbers.add("l_partkey", "l_suppkey").alias("sum"), numbers.sub("l_partkey", "l_suppkey").alias("diff"),
                             numbers.mul("l_partkey", "l_suppkey").alias("prod"), numbers.div("l_partkey", d).alias("quot"),
                             numbers.mod("l_partkey", d).alias("rest"), numbers.maximum("l_partkey", "l_suppkey").alias("top"))


@query("fn_base_name", r"SELECT page_id, regexp_extract(url, '[^.]*$') AS base FROM pages")
def fn_base_name(t):
    return t.pages.select("page_id", text.base_name("url").alias("base"))


@query("fn_fahrenheit", "SELECT p_partkey, CAST(trunc((p_size - 32) * 5.0 / 9.0 + 0.5) AS INTEGER) AS celsius FROM part")
def fn_fahrenheit(t):
    return t.part.select("p_partkey", numbers.celsius("p_size").alias("celsius"))


@query("fn_typed_get", r"""
    SELECT event_id, array_to_string(list_concat([event_type], CASE WHEN event_id % 2 = 0 THEN ['x'] ELSE [] END), '|') AS items,
           event_id % 2 = 0 AS flag, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS n,
           CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS INTEGER) END AS small, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE value END AS ratio,
           CASE WHEN event_id % 2 = 0 THEN 'http://h/' || user_id END AS uri FROM events""")
def fn_typed_get(t):
    k = F.col("event_id")
    even = k % 2 == 0
    return t.events.select(
        "event_id",
        F.array_join(config_values.as_list(F.concat("event_type", F.when(even, F.lit(" , x,")).otherwise(F.lit("")))), "|").alias("items"),
        config_values.as_boolean(F.when(even, F.lit(" True ")).otherwise(F.lit("yes"))).alias("flag"),
        config_values.as_long(F.when(k % 3 != 0, k.cast("string")), default=-1).alias("n"),
        config_values.as_int(F.when(k % 5 == 0, F.lit("many")).otherwise(F.col("user_id").cast("string"))).alias("small"),
        config_values.as_double(F.when(k % 7 != 0, F.col("value").cast("string")), default=0.5).alias("ratio"),
        config_values.as_uri(F.when(even, F.concat(F.lit("http://h/"), "user_id")).otherwise(F.lit("no uri"))).alias("uri"))


@query("fn_json_to_strings", r"""
    SELECT event_id, unnest(['k', 'list', 'nested']) AS key,
           unnest([regexp_extract(props, '\d+'), 'a,1,true', CAST(user_id AS VARCHAR)]) AS value FROM events""")
def fn_json_to_strings(t):
    doc = F.concat(F.lit('{"top":{"k":'), F.get_json_object("props", "$.k"), F.lit('},"list":["a",1,true],"nested":{"u":'),
                   "user_id", F.lit("}}"))
    shaped = json_text.to_strings(doc, "top map<string,string>, list array<string>, nested map<string,string>")
    return t.events.select("event_id", shaped.alias("d")).select("event_id", F.explode(F.create_map(
        F.lit("k"), F.element_at("d.top", "k"), F.lit("list"), F.array_join("d.list", ","),
        F.lit("nested"), F.element_at("d.nested", "u"))).alias("key", "value"))


@query("fn_status_label", """
    SELECT job, CASE WHEN p % 13 = 0 THEN 'normal' WHEN status = 'IGNORED' THEN 'disabled' ELSE lower(status) END AS label
    FROM (SELECT *, CAST(substr(job, 2) AS BIGINT) AS p FROM node_status)""", ("node_status",))
def fn_status_label(t):
    p = F.substring("job", 2, 20).cast("bigint")
    state = F.when(p % 13 == 0, F.lit("LOST")).otherwise(F.col("status"))
    return t.node_status.select("job", status.label(state).alias("label"))
