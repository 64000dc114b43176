"""Column functions on literal values."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import config_values, json_text, numbers, status, text, times


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("line, fields, expected", [
    ("a\tb\tc", [0, 2], ["a", "c"]), ("a\t\tc", [1], [""]), ("a\t\t", [0, 1, 2], ["a", None, None]),
    ("a", [3], [None]), ("\t\t", [0], [None]), ("", [0], [""]), ("\ta", [0, 1], ["", "a"])])
def test_cut(spark, line, fields, expected):
    assert value(spark, text.cut(F.lit(line), fields)) == expected


def test_cut_with_another_delimiter(spark):
    assert value(spark, text.cut(F.lit("a,b,c,,"), [1, 3], ",")) == ["b", None]


def test_apply_at(spark):
    arr = F.array(*[F.lit(i) for i in (0, 5, 10, 15, 20, 25, 30)])
    assert value(spark, text.apply_at(arr, lambda x: x * 2, 1)) == [0, 10, 10, 15, 20, 25, 30]
    assert value(spark, text.apply_at(arr, lambda x: x * 2, [1, 2, 5])) == [0, 10, 20, 15, 20, 50, 30]
    assert value(spark, text.apply_at(arr, lambda x: x * 2, [1, 1])) == [0, 20, 10, 15, 20, 25, 30]


def test_ngrams(spark):
    df = spark.createDataFrame([("to be or to be",), ("one",), ("",)], "q string").select(text.words("q").alias("w"))
    assert [sorted(r[0]) for r in df.select(text.ngrams("w")).collect()] == [
        ["be", "be or", "or", "or to", "to", "to be"], ["one"], []]
    assert [sorted(r[0]) for r in df.select(text.ngrams("w", (3,))).collect()] == [["be or to", "or to be", "to be or"], [], []]


@pytest.mark.parametrize("s, keep", [("cats", True), ("", False), ("  ", False), (None, False), ("http://x.y", False),
                                     (" www.x.y z", False), ("see http://x", True)])
def test_is_query(spark, s, keep):
    assert value(spark, text.is_query(F.lit(s).cast("string"))) is keep


def test_small_text_functions(spark):
    assert value(spark, text.shell_quote(F.lit("it's"))) == "'it\\'s'"
    assert value(spark, text.ellipsify(F.lit(None).cast("string"), 5)) == ""
    assert value(spark, text.ellipsify(F.lit("abcdef"), 5)) == "ab..."
    assert value(spark, text.ellipsify(F.lit("abcde"), 5)) == "abcde"
    assert value(spark, text.newline_to_br(F.lit("a\r\nb"))) == "a<br/><br/>b"
    assert value(spark, text.base_name(F.lit("a.b.C"))) == "C"
    assert value(spark, text.counting(F.lit(0))) == []
    assert value(spark, text.counting(F.lit(3))) == [0, 1, 2]
    with pytest.raises(Exception, match="it is null"):
        value(spark, text.required(F.lit(None).cast("string"), "it is null"))


@pytest.mark.parametrize("size, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1 kb"), (1536, "1.5 kb"), (1048576, "1 mb"),
                                         (1300000, "1.24 mb"), (1024 ** 3 * 10, "10 gb"), (1024 ** 5, "1,024 tb")])
def test_display_bytes(spark, size, shown):
    assert value(spark, numbers.display_bytes(F.lit(size).cast("bigint"))) == shown


@pytest.mark.parametrize("s, size", [("10k", 10240), ("10KB", 10240), (" 1m", 1 << 20), ("1gb", 1 << 30), ("7", 7), ("x", None)])
def test_parse_bytes(spark, s, size):
    assert value(spark, numbers.parse_bytes(F.lit(s))) == size


def test_numbers(spark):
    assert value(spark, numbers.celsius(F.lit(90))) == 32
    assert value(spark, numbers.celsius(F.lit(0))) == -17
    assert value(spark, numbers.format_percent(F.lit(0.1234), 1)) == "12.3%"
    assert value(spark, numbers.format_percent(F.lit(1.0), 2)) == "100%"
    assert value(spark, numbers.div(F.lit(-7), F.lit(2))) == -3
    arr = F.array(F.lit(3), F.lit(9), F.lit(4))
    assert value(spark, numbers.folded_from_first(arr, lambda a, x: a - x)) == -10
    with pytest.raises(Exception, match="empty array"):
        value(spark, numbers.folded_from_first(F.array().cast("array<int>"), lambda a, x: a + x))


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize("end, shown", [("2024-01-01 00:00:59", "0 minutes"), ("2024-01-01 01:01:00", "1 hour, 1 minute"),
                                        ("2024-01-03 02:00:00", "50 hours, 0 minutes")])
def test_format_between(spark, end, shown):
    assert value(spark, times.format_between(ts("2024-01-01 00:00:00"), ts(end))) == shown


@pytest.mark.parametrize("s, shown", [("3d", "3 days, 0 minutes"), ("1h", "1 hour, 0 minutes"), ("25h", "25 hours, 0 minutes"),
                                      ("1m", "1 minute"), ("5s", "0 minutes"), ("n", None)])
def test_periods(spark, s, shown):
    period = times.parse_period(F.lit(s))
    assert value(spark, times.format_period(period)) == shown
    assert value(spark, times.print_period(period)) == s


def test_bad_period(spark):
    with pytest.raises(Exception, match="invalid period"):
        value(spark, times.parse_period(F.lit("3w")))
    assert value(spark, times.parse_period(F.lit("3w"), strict=False)) is None


@pytest.mark.parametrize("start, period, expected", [
    ("2024-01-01 00:00:00", "1d", "2024-01-11 00:00:00"), ("2024-01-01 05:00:00", "1d", "2024-01-11 05:00:00"),
    ("2024-01-10 23:59:59", "7m", "2024-01-11 00:06:59"), ("2024-02-01 00:00:00", "1d", "2024-02-01 00:00:00"),
    ("2024-01-01 00:00:00", "n", "2024-01-01 00:00:00")])
def test_next_run(spark, start, period, expected):
    out = times.next_run(ts(start), times.parse_period(F.lit(period)), ts("2024-01-11 00:00:00"))
    assert value(spark, out) == datetime.datetime.fromisoformat(expected)


def test_next_run_over_any_number_of_periods(spark):
    out = times.next_run(ts("1990-01-01 00:00:03"), times.parse_period(F.lit("5s")), ts("2024-01-01 00:00:00"))
    assert value(spark, out) == datetime.datetime(2024, 1, 1, 0, 0, 3)
    never = times.next_run(ts("2020-01-01 00:00:00"), times.parse_period(F.lit("0s")), ts("2024-01-01 00:00:00"))
    assert value(spark, never) is None


def test_config_values(spark):
    assert value(spark, config_values.as_list(F.lit("a , b,c,,"))) == ["a", "b", "c"]
    assert value(spark, config_values.as_list(F.lit("  "))) == []
    assert value(spark, config_values.as_boolean(F.lit(" TRUE "))) is True
    assert value(spark, config_values.as_boolean(F.lit("yes"))) is False
    assert value(spark, config_values.as_int(F.lit(" 12 "))) == 12
    assert value(spark, config_values.as_long(F.lit(None).cast("string"), default=4)) == 4
    assert value(spark, config_values.as_double(F.lit("x"))) is None
    with pytest.raises(Exception, match="missing required"):
        value(spark, config_values.as_int(F.lit(None).cast("string"), strict=True))
    with pytest.raises(Exception, match="not a int"):
        value(spark, config_values.as_int(F.lit("x"), strict=True))


@pytest.mark.parametrize("a, b, same", [
    ('{"a": 1, "b": [1, "x", true]}', '{"b":["1","x","true"],"a":"1"}', True), ('{"a": 1}', '{"a": 2}', False),
    ('{"a": [1, 2]}', '{"a": [2, 1]}', False), ('{"a": {"x": 1, "y": 2}}', '{"a": {"y": 2, "x": 1}}', True),
    ('{"a": "1,2,3"}', '{"a": "1,\\"2\\",3"}', False), (None, None, True), ('{"a": null}', '{}', False),
    ('{bad', '{other', None), ('{bad', '{}', None), ('1', '"1"', True), ('{"a": 1.50}', '{"a": 1.5}', True)])
def test_same_document(spark, a, b, same):
    assert value(spark, json_text.same_document(F.lit(a).cast("string"), F.lit(b).cast("string"))) is same


def test_output_pairs(spark):
    assert value(spark, json_text.output_pairs(F.lit(' {"a": 1, "b": "x"} '))) == {"a": "1", "b": "x"}
    for bad in ("", "{oops", None):
        assert value(spark, json_text.output_pairs(F.lit(bad).cast("string"))) == {}


def test_composed_states_in_full(spark):
    names = ["READY", "IGNORED", "RUNNING", "SUCCEEDED", "COMPLETED", "FAILED"]
    pairs = spark.createDataFrame([(j, b) for j in names for b in names], "j string, b string")
    for row in pairs.select("j", "b", status.composed("j", "b").alias("s")).collect():
        if row.j not in ("READY", "IGNORED"):
            assert row.s == row.j
        else:
            assert row.s == {"RUNNING": "RUNNING", "FAILED": "FAILED"}.get(row.b, "READY")


def test_labels(spark):
    assert [value(spark, status.label(F.lit(s))) for s in ("IGNORED", "FAILED", "OTHER")] == ["disabled", "failed", "normal"]


def test_table_functions(spark, rows):
    from millrace.functions import tables
    tables.register(spark)
    texts = spark.createDataFrame([(1, " a  b\nc"), (2, ""), (3, None), (4, "x")], "id int, t string")
    got = spark.sql("SELECT id, pos, word FROM {d}, LATERAL flatten_words(t)", d=texts)
    assert rows(got) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (4, 0, "x")]
    turns = spark.createDataFrame([(c, t, "ab"[(c + t // 2) % 2]) for c in range(40) for t in range(7)] + [(50, 1, None), (50, 2, "a")],
                                  "conv_id bigint, turn bigint, role string")
    got = spark.sql("SELECT * FROM exchanges(TABLE(SELECT * FROM {d}) PARTITION BY conv_id ORDER BY turn)", d=turns)
    assert rows(got) == sorted(((c, t, "ab"[(c + t // 2) % 2], "ba"[(c + t // 2) % 2]) for c in range(40) for t in (2, 4, 6)), key=repr)
