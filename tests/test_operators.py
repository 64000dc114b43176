"""Operators on small tables, against a plain calculation of the same thing."""

import collections
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, config, graph, groups, history, joins, ordering, rows as row_ops, status
from millrace.operators.joins import JoinInput
from millrace.plans import phrases


def hot_rows(n=3000, seed=1):
    """One key holds a third of the rows; positions have gaps; some keys are null."""
    rnd = random.Random(seed)
    out, pos = [], 0
    for i in range(n):
        pos += rnd.choice([1, 1, 1, 7, 400])
        key = "hot" if rnd.random() < 0.34 else rnd.choice(["a", "b", "c", None])
        out.append((key, pos, rnd.randrange(5)))
    return out


@pytest.fixture(scope="module")
def hot(spark):
    data = hot_rows()
    return data, spark.createDataFrame(data, "key string, pos long, v int").repartition(7).cache()


def by_key(data):
    found = defaultdict(list)
    for key, pos, v in sorted(data, key=lambda r: r[1]):
        found[key].append((pos, v))
    return found


def test_running_sum_and_numbers(hot, rows):
    data, df = hot
    expected_sum, expected_n, expected_back = [], [], []
    for key, items in by_key(data).items():
        for i, (pos, v) in enumerate(items):
            expected_sum.append((key, pos, sum(x for _, x in items[:i + 1])))
            expected_n.append((key, pos, i + 1))
            expected_back.append((key, pos, sum(x for _, x in items[i:])))
    for width in (16, 1000, 1 << 20):
        assert rows(blocks.running_sum(df, ["key"], "pos", "v", "s", width), "key", "pos", "s") == sorted(expected_sum, key=repr)
        assert rows(blocks.numbered(df, ["key"], "pos", "n", width), "key", "pos", "n") == sorted(expected_n, key=repr)
    back = blocks.running_sum(df, ["key"], "pos", "v", "s", 100, from_end=True)
    assert rows(back, "key", "pos", "s") == sorted(expected_back, key=repr)
    few = blocks.running_sum(df, ["key"], "pos", "v", "s", 100, from_end=True, stop_at=20)
    assert rows(few, "key", "pos", "s") == sorted((r for r in expected_back if r[2] <= 20), key=repr)


def test_consecutive_uniq(hot, rows):
    data, df = hot
    expected = [(k, items[i][0]) for k, items in by_key(data).items() for i in range(len(items))
                if i == 0 or items[i][1] != items[i - 1][1]]
    assert rows(ordering.consecutive_uniq(df, ["key"], "pos", "v", 50), "key", "pos") == sorted(expected, key=repr)


def test_consecutive_uniq_of_a_sequence(spark):
    items = [1, 1, 1, 1, 2, 2, 2, 2, 1, 2, 2, 3, 3, 3, 3, None, None, 3]
    df = spark.createDataFrame(list(enumerate(items)), "pos int, v int")
    out = ordering.consecutive_uniq(df, [], "pos", "v", 3).orderBy("pos").collect()
    assert [r.v for r in out] == [1, 2, 1, 2, 3, None, 3]
    assert ordering.consecutive_uniq(df.limit(0), [], "pos", "v").count() == 0


def test_ranked(hot, rows):
    data, df = hot
    expected = []
    for key, items in by_key(data).items():
        for i, (pos, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0]))):
            expected.append((key, pos, i + 1))
    out = ordering.ranked(df, ["key"], [F.col("v").desc(), F.col("pos")])
    assert rows(out, "key", "pos", "rank") == sorted(expected, key=repr)


def test_top_per_key_small_and_large(hot, rows, spark):
    data, df = hot
    for n in (3, 1200):
        expected = [(k, p) for k, items in by_key(data).items() for p, _ in items[-n:]]
        out = ordering.top_per_key(df, ["key"], [F.col("pos").desc()], n)
        assert rows(out, "key", "pos") == sorted(expected, key=repr)


def test_tail_lines_keeps_the_last_character_and_drops_blanks(spark):
    lines = ["a", "", "b", "  ", "c", "last"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source string, pos long, line string")
    assert [r.line for r in ordering.tail_lines(df, 3).orderBy("rank").collect()] == ["b", "c", "last"]
    assert [r.line for r in ordering.tail_lines(df, 3, keep_blank=True).orderBy("rank").collect()] == ["  ", "c", "last"]


def test_ring_of_five(spark):
    fed = []
    for more in ([0, 1, 2, 3], [4], [5], [6, 7, 8, 9, 10]):
        fed += more
        df = spark.createDataFrame([("s", i, str(i)) for i in fed], "source string, pos long, line string")
        assert [int(r.line) for r in ordering.tail_lines(df, 5, keep_blank=True).orderBy("rank").collect()] == fed[-5:]


@pytest.mark.parametrize("limit, kept", [(100, ["aaaa", "bbbb", "cc"]), (13, ["aaaa", "bbbb", "cc"]), (12, ["bbbb", "cc"]),
                                         (9, ["bbbb", "cc"]), (8, ["cc"])])
def test_tail_bytes(spark, limit, kept):
    # Lines take 5, 5 and 3 bytes. A cut right before a line drops that line.
    df = spark.createDataFrame([("f", 0, "aaaa"), ("f", 1, "bbbb"), ("f", 2, "cc")], "source string, pos long, line string")
    assert [r.line for r in ordering.tail_bytes(df, limit, width=1).orderBy("pos").collect()] == kept


def test_row_slice_stops_at_a_number_of_characters(spark):
    df = spark.createDataFrame([("f", i, "x" * 10) for i in range(20)], "source string, pos long, line string")
    assert ordering.row_slice(df, 3, 6, width=4).count() == 4
    text = ordering.row_slice(df, 3, 16, inclusive=False, chars_of="line", max_chars=50, width=4)
    assert sorted(r.row for r in text.collect()) == [3, 4, 5, 6]


def test_history_page_does_not_fill_gaps(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 9)], "id long")
    assert [r.id for r in ordering.history_page(df, begin=1, size=4).collect()] == [8, 5]


def test_join_gap_patterns(spark, rows):
    """All patterns of 0..2 rows of one key in three inputs: left outer from the first, partners multiply."""
    data = [[], [], []]
    expected = []
    for key, counts in enumerate(itertools.product(range(3), repeat=3)):
        made = [[f"{i}{n}" for n in range(c)] for i, c in enumerate(counts)]
        for i in range(3):
            data[i] += [(key, x) for x in made[i]]
        for combo in itertools.product(made[0], made[1] or [None], made[2] or [None]):
            expected.append((key, *combo))
    tables = [spark.createDataFrame(d, f"k int, c{i} string") for i, d in enumerate(data)]
    for pieces in (None, 1, 100):
        out = joins.join_inputs(["k"], [JoinInput(t, [f"c{i}"]) for i, t in enumerate(tables)], rows_per_piece=pieces)
        assert rows(out) == sorted(expected, key=repr)


def test_join_last_partner_owns_a_column_even_with_null(spark, rows):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (3, "a3")], "k int, x string")
    b = spark.createDataFrame([(1, None), (2, "b2")], "k int, x string")
    out = joins.join_inputs(["k"], [JoinInput(a, ["x", "gone"]), JoinInput(b, ["x"])])
    assert rows(out) == sorted([(1, None, None), (2, "b2", None), (3, "a3", None)], key=repr)


def test_join_with_null_keys(spark, rows):
    a = spark.createDataFrame([(None, "a"), (1, "b")], "k int, x string")
    b = spark.createDataFrame([(None, "c")], "k int, y string")
    inputs = [JoinInput(a, ["x"]), JoinInput(b, ["y"])]
    assert rows(joins.join_inputs(["k"], inputs)) == sorted([(None, "a", None), (1, "b", None)], key=repr)
    assert rows(joins.join_inputs(["k"], inputs, null_safe=True)) == sorted([(None, "a", "c"), (1, "b", None)], key=repr)


def test_spread_join_of_a_hot_key(spark, rows):
    left = [(k, f"l{i}") for i, k in enumerate([1, 1, 2, 3, None])]
    right = [(1, "same")] * 50 + [(1, f"r{i}") for i in range(50)] + [(2, "r")]
    l, r = spark.createDataFrame(left, "k int, x string"), spark.createDataFrame(right, "k int, y string").repartition(5)
    for how in ("left", "inner"):
        plain = l.join(r, "k", how).select("k", "x", "y")
        assert rows(joins.spread_join(l, r, ["k"], how, rows_per_piece=7)) == rows(plain)


def test_group_fold(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7), (None, 3), (None, 4)], "k string, v int").repartition(3)
    projections = [("total", F.col("v"), "+", "bigint"), ("n", F.lit(1), "+", "int")]
    own = [("total", F.col("v"), lambda a, b: a + b, "bigint"), ("n", F.lit(1), lambda a, b: a + b, "int")]
    expected = sorted([("a", 3, 2), ("b", 7, 1), (None, 7, 2)], key=repr)
    assert rows(groups.group_fold(df, ["k"], projections)) == expected
    assert rows(groups.group_fold(df, ["k"], own)) == expected
    replaced = groups.group_fold(df, ["k"], [("k", F.lit(1), "+", "int")])
    assert rows(replaced) == [(1,), (2,), (2,)]


def test_merge_by_key_over_many_batches(hot, rows, spark):
    data, df = hot
    expected = [(k, max(v for _, v in items), sum(p for p, _ in items)) for k, items in by_key(data).items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        merge = groups.pairwise(["key"], {"v": max, "pos": lambda a, b: a + b})
        out = groups.merge_by_key(df.select("key", "v", "pos"), ["key"], merge, held=20)
        assert rows(out) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_in_pieces_loses_nothing(hot, rows):
    data, df = hot
    out = groups.in_pieces(df, ["key"], ["pos"], 100).collect()
    assert sorted(((r.key, r.pos, r.v) for r in out), key=repr) == sorted(data, key=repr)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.key, r.piece] += 1
    assert max(sizes.values()) == 100
    assert len([k for k in sizes if k[0] == "hot"]) == -(-sum(1 for d in data if d[0] == "hot") // 100)


def test_rename_order_matters(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = row_ops.rename(df, [("a", "b"), ("b", "d"), ("x", "y")])
    assert {c: out.first()[c] for c in out.columns} == {"c": 3, "d": 1, "y": None}


def test_select_and_project(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert row_ops.select_present(df, ["b", "zz"]).columns == ["b"]
    assert tuple(row_ops.select_or_default(df, [("b", "x"), ("c", "x"), "d"]).first()) == (None, "x", None)
    out = row_ops.project(df, [("p", "a + 1"), ("q", lambda: F.col("p") * 10)])
    assert out.first()["q"] == 20


def test_schema_texts():
    text = row_ops.make_schema([("f", "'int32'"), ("g", "'string'")])
    assert text == "{'f':'int32', 'g':'string'}"
    assert row_ops.schema_from_text(text).simpleString() == "struct<f:int,g:string>"
    with pytest.raises(ValueError, match="unknown type"):
        row_ops.schema_from_text("{'f':'decimal'}")


def test_check_schema_fails_before_any_job(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing columns"):
        row_ops.check_schema(df, row_ops.schema_from_text("{'b':'int32'}"))


def test_group_states_in_full(spark):
    names = ["READY", "IGNORED", "RUNNING", "SUCCEEDED", "COMPLETED", "FAILED"]
    children = [(i, s) for i, combo in enumerate(list(itertools.product(names, repeat=2)) + list(itertools.product(names, repeat=3)))
                for s in combo]
    df = (spark.createDataFrame(children, "flow int, status string")
          .withColumn("start_time", F.lit(None).cast("timestamp_ntz")).withColumn("end_time", F.lit(None).cast("timestamp_ntz")))
    found = {r.flow: r.status for r in status.group_status(df, ["flow"]).collect()}
    members = defaultdict(list)
    for flow, s in children:
        members[flow].append(s)
    for flow, states in members.items():
        if "FAILED" in states:
            expected = "FAILED"
        elif set(states) <= {"SUCCEEDED", "COMPLETED"}:
            expected = "SUCCEEDED"
        else:
            expected = "RUNNING" if set(states) == {"RUNNING"} else "READY"
        assert found[flow] == expected, states


def test_last_and_first_win(spark, rows):
    df = spark.createDataFrame([("f", "1", "1", 0), ("f", "2", "1", 0), ("f", "2", "2", 1), ("f", "3", "2", 1)],
                               "flow string, key string, value string, position int")
    assert rows(groups.last_wins(df, ["flow", "key"], "position"), "key", "value") == [("1", "1"), ("2", "2"), ("3", "2")]
    assert rows(groups.first_wins(df, ["flow", "key"], "position"), "key", "value") == [("1", "1"), ("2", "1"), ("3", "2")]


def random_graph(seed, n=30, m=60, cyclic=False):
    rnd = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rnd.randrange(n), rnd.randrange(n)
        if a > b or (cyclic and a != b):
            edges.add((f"n{a:02d}", f"n{b:02d}"))
    return [f"n{i:02d}" for i in range(n)], sorted(edges)


def reach(start, edges):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def tables(spark, names, edges):
    return (spark.createDataFrame([(n,) for n in names], "job string"),
            spark.createDataFrame(edges, "job string, dep string"))


def test_levels_and_closure(spark, rows):
    names, edges = random_graph(3)
    nodes_df, edges_df = tables(spark, names, edges)
    needs = defaultdict(list)
    for a, b in edges:
        needs[a].append(b)

    def level(n):
        return max((level(d) + 1 for d in needs[n]), default=0)

    assert rows(graph.levels(nodes_df, edges_df)) == [(n, level(n)) for n in names]
    seeds = spark.createDataFrame([(n, n) for n in names], "root string, job string")
    expected = sorted((n, x) for n in names for x in reach(n, edges))
    assert rows(graph.closure(seeds, edges_df, ("root",)), "root", "job") == expected
    assert graph.cycles(nodes_df, edges_df).count() == 0


def test_cycles(spark, rows):
    names, edges = random_graph(5, n=20, m=22, cyclic=True)
    edges += [("n03", "n03")]
    nodes_df, edges_df = tables(spark, names, edges)

    def after(n):
        return set().union(set(), *[reach(b, edges) for a, b in edges if a == n])

    looping = {n for n in names if n in after(n)}
    expected = sorted((n, "self" if n == "n03" else "cycle") for n in names if n in looping or after(n) & looping)
    assert rows(graph.cycles(nodes_df, edges_df)) == expected


def test_pure_cycle_is_found(spark, rows):
    nodes_df, edges_df = tables(spark, ["a", "b"], [("a", "b"), ("b", "a")])
    assert rows(graph.cycles(nodes_df, edges_df)) == [("a", "cycle"), ("b", "cycle")]


def test_tree_has_a_row_per_job(spark, rows):
    nodes_df, edges_df = tables(spark, ["top", "x", "y", "z"], [("top", "y"), ("top", "x"), ("x", "z"), ("y", "z")])
    assert rows(graph.tree(nodes_df, edges_df)) == [
        ("top", True, '{"name":"top","dependencies":["x","y"]}'), ("x", False, '{"name":"x","dependencies":["z"]}'),
        ("y", False, '{"name":"y","dependencies":["z"]}'), ("z", False, '{"name":"z","dependencies":[]}')]


def test_ready_treats_ignored_as_done(spark, rows):
    _, edges_df = tables(spark, [], [("a", "x"), ("b", "y"), ("c", "x"), ("c", "y")])
    states = spark.createDataFrame([("a", "READY"), ("b", "READY"), ("c", "READY"), ("x", "IGNORED"), ("y", "RUNNING")],
                                   "job string, status string")
    assert rows(graph.ready(states, edges_df)) == [("a",)]


def test_interpolation(spark, rows):
    entries = spark.createDataFrame([
        ("s", "givenName", "Ada"), ("s", "familyName", "Byron"),
        ("s", "card", "signed by ${givenName} ${familyName}"), ("s", "twice", "${card}! ${card}"),
        ("s", "made", "${given${part}}"), ("s", "part", "Name"), ("s", "money", "$5 \\ ${part}"),
        ("s", "lost", "see ${nowhere}"), ("s", "a", "${b}"), ("s", "b", "x${c}"), ("s", "c", "${b}"),
        ("s", "own", "${own}"), ("t", "card", "${givenName}")], "scope string, key string, value string")
    out = {(r.scope, r.key): (r.value, r.problem) for r in config.interpolate(entries).collect()}
    assert len(out) == 13
    card = "signed by Ada Byron"
    assert out["s", "card"] == (card, None)
    assert out["s", "twice"] == (f"{card}! {card}", None)
    assert out["s", "made"] == ("Ada", None)
    assert out["s", "money"] == ("$5 \\ Name", None)
    assert out["s", "lost"][1] == "unknown: nowhere"
    assert out["t", "card"][1] == "unknown: givenName"
    for key in ("a", "b", "c", "own"):
        assert out["s", key][1].startswith("circular: ")


def test_config_chain(spark, rows):
    deep = [("s0", None)] + [(f"s{i}", f"s{i - 1}") for i in range(1, 12)]
    scopes = spark.createDataFrame(deep, "scope string, parent string")
    chain = config.chains(scopes)
    assert rows(chain) == sorted([(f"s{i}", f"s{j}", i - j) for i in range(12) for j in range(i + 1)], key=repr)
    entries = spark.createDataFrame([("s0", "a", "0"), ("s5", "a", "5"), ("s3", "b", None), ("s1", "b", "1")],
                                    "scope string, key string, value string")
    seen = {(r.scope, r.key): r.value for r in config.effective(entries, chain).collect()}
    assert seen["s4", "a"] == "0" and seen["s11", "a"] == "5" and seen["s2", "b"] == "1" and seen["s9", "b"] is None
    assert rows(config.contains_value(entries, chain, "0")) == sorted([(f"s{i}",) for i in range(12)])
    looped = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "scope string, parent string")
    with pytest.raises(ValueError, match="own ancestor"):
        config.chains(looped)


def test_recent_runs_sorts_before_it_cuts(spark):
    runs = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 100)], "job string, started long")
    assert [tuple(r) for r in history.recent_runs(runs, 2).collect()] == [("b", 100), ("a", 4)]


def test_max_execution_id(spark):
    names = spark.createDataFrame([("7.json",), ("12.json",), ("x.json",), ("99.txt",)], "name string")
    assert history.max_execution_id(names).first()[0] == 12
    assert history.max_execution_id(names.limit(0)).first()[0] == 0


def test_upcoming(spark, rows):
    s = spark.sql("SELECT 'a' AS name, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS start, '6h' AS period "
                  "UNION ALL SELECT 'b', TIMESTAMP_NTZ '2024-01-01 03:00:00', 'n'")
    out = history.upcoming(s, F.lit("2024-01-01 13:00:00").cast("timestamp_ntz"))
    assert [(n, t.hour) for n, t in rows(out)] == [("a", 0), ("a", 12), ("a", 6), ("b", 3)]


BIG = 9007199254740993  # not a double


def test_accumulators_keep_whole_numbers_nulls_and_texts(spark, rows):
    data = [(BIG, BIG, "b", None, 1), (BIG, None, None, 2.0, 2), (BIG - 1, None, "x", None, 4), (None, BIG - 1, "a", 1.0, 8),
            (None, BIG, "c", None, 16), (BIG, 3, "a", 5.0, 32)]
    df = spark.createDataFrame(data, "k bigint, v bigint, s string, d double, bits int").repartition(3)
    own = [("top", F.col("v"), np.maximum, "bigint"), ("last", F.col("v"), max, "bigint"), ("sum", F.col("d"), "+", "double"),
           ("n", F.col("v"), "count", "bigint"), ("text", F.col("s"), "+", "string"), ("bits", F.col("bits"), "|", "int"),
           ("added", F.col("d"), lambda a, b: a + b, "double"), ("mixed", F.col("bits"), np.bitwise_xor, "int")]
    assert rows(groups.group_fold(df, ["k"], own)) == sorted([
        (BIG, BIG, BIG, 7.0, 2, "ab", 35, 7.0, 35), (BIG - 1, None, None, None, 0, "x", 4, None, 4),
        (None, BIG, BIG, 1.0, 2, "ac", 24, 1.0, 24)], key=repr)


def test_a_reducer_sees_exact_numbers(spark, rows):
    df = spark.createDataFrame([(BIG, 1), (BIG, None), (None, 5), (BIG - 1, None)], "k bigint, v bigint").repartition(3)

    def merge(states):
        return states.groupby("k", dropna=False, as_index=False).agg({"v": "max"})

    out = groups.reduce_groups(df, ["k"], lambda b: b, "k bigint, v bigint", merge, lambda b: b, "k bigint, v bigint")
    assert rows(out) == sorted([(BIG, 1), (None, 5), (BIG - 1, None)], key=repr)


def test_tables_with_maps(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "id AS pos", "map('a', id) AS m")
    for n in (5, 2000):
        got = ordering.top_per_key(df, ["k"], [F.col("pos").desc()], n).collect()
        assert len(got) == 3 * min(n, 100) and {r.m["a"] for r in got} == {r.pos for r in got}
    pairs = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, name string")
    joined = joins.spread_join(pairs, df.select("k", "m"), ["k"], "left", rows_per_piece=30)
    assert joined.count() == 200


def test_runs_of_one_time_have_one_latest(spark):
    for parts in (1, 2, 5):
        runs = spark.createDataFrame([("j", 5, "a"), ("j", 5, "c"), ("j", 5, "b")], "job string, started int, log string")
        assert history.latest_runs(runs.repartition(parts)).first().log == "c"
        assert history.recent_runs(runs.repartition(parts), 1).first().log == "c"


def test_join_reduce_reduces_by_the_join_key(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, name string")
    b = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k bigint, v bigint")

    def start(batch):
        return batch.groupby("k", as_index=False).agg(n=("v", "size"), top=("v", "max"))

    def merge(states):
        return states.groupby("k", as_index=False).agg({"n": "sum", "top": "max"})

    schema = "k bigint, n bigint, top bigint"
    out = joins.join_reduce(["k"], [joins.JoinInput(a, ["name"]), joins.JoinInput(b, ["v"])], start, schema, merge,
                            lambda s: s, schema)
    assert rows(out) == [(1, 2, 7), (2, 1, 1)]


def test_runs_of_keys():
    """Keys over batch borders, nulls and NaN as keys, and reducers that don't read on."""
    nan = float("nan")
    rows = [("a", 1.0)] * 3 + [("a", nan)] * 4 + [(None, nan)] * 2 + [(None, None)] * 3 + [("b", None)]
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pylist([{"k": k, "x": x, "n": n + i} for i, (k, x) in enumerate(rows[n:n + size])],
                                              schema=pa.schema([("k", pa.string()), ("x", pa.float64()), ("n", pa.int64())]))
                   for n in range(0, len(rows), size)]
        found = [(repr(key), [n for b in own for n in b.column("n").to_pylist()]) for key, own in groups.runs_of_keys(batches, ["k", "x"])]
        assert found == [("('a', 1.0)", [0, 1, 2]), ("('a', nan)", [3, 4, 5, 6]), ("(None, nan)", [7, 8]),
                         ("(None, None)", [9, 10, 11]), ("('b', None)", [12])]
        assert len(list(groups.runs_of_keys(batches, ["k", "x"]))) == 5  # nothing read of any key
    assert list(groups.runs_of_keys([], ["k"])) == []


def test_ordered_reducer_streams_a_hot_key(spark):
    """The reducer meets a key's rows in order and in batches, and its results leave before the key is over."""
    def steps(key, batches):
        before, batch_number = None, 0
        for batch in batches:
            at = batch.column("at").to_pylist()
            assert at == sorted(at) and (before is None or before <= at[0])
            batch_number, before = batch_number + 1, at[-1]
            yield pa.RecordBatch.from_pydict({"key": [key[0]], "number": [batch_number], "rows": [len(at)]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        df = spark.range(30_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'hot', concat('k', id % 50))) AS key", "id * 7919 % 30011 AS at")
        got = groups.reduce_ordered(df, ["key"], ["at"], steps, "key string, number bigint, rows bigint").collect()
    finally:
        spark.conf.set(key, kept)
    total = collections.Counter()
    for r in got:
        total[r.key] += r.rows
    assert total[None] == total["hot"] == 10_000 and sum(total.values()) == 30_000
    assert max(r.rows for r in got) <= 500 and max(r.number for r in got if r.key == "hot") >= 20
    assert groups.reduce_ordered(df.limit(0), ["key"], ["at"], steps, "key string, number bigint, rows bigint").count() == 0


def test_join_reduce_ordered(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, name string")
    right = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (3, 1), (None, 2)], "k int, v int")

    def reducer(key, batches):
        table = pa.Table.from_batches(batches)
        names = [n for n in table["name"].to_pylist() if n]
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0]], pa.int32()), "names": ["".join(names)],
                                          "values": [",".join(str(v) for v in table["v"].to_pylist() if v is not None)]})

    got = joins.join_reduce_ordered(["k"], [left, right], ["v"], reducer, "k int, names string, values string")
    assert rows(got) == sorted([(1, "a", "3,5"), (2, "b", "9"), (4, "d", ""), (3, "", "1"), (None, "", "2")], key=repr)


def test_many_small_batches_are_not_held_side_by_side():
    import weakref
    alive = most = 0

    def gone():
        nonlocal alive
        alive -= 1

    def small():
        nonlocal alive, most
        for n in range(3000):
            batch = pa.RecordBatch.from_pydict({"n": [n]})
            weakref.finalize(batch, gone)
            alive += 1
            most = max(most, alive)
            yield batch
            del batch

    tables = list(groups.gathered(small(), 2500))
    assert [t.num_rows for t in tables] == [2500, 500]
    assert [n for t in tables for n in t.column("n").to_pylist()] == list(range(3000))
    assert most <= groups.SMALL_BATCHES + 2


def test_few_schedules_are_expanded_by_many_tasks(spark):
    df = spark.sql("SELECT 'j' || id AS name, TIMESTAMP_NTZ '2024-01-01' AS start, '1s' AS period FROM range(0, 100, 1, 1)")
    runs = history.upcoming(df, F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"))
    assert runs.count() == 6100 and runs.select(F.spark_partition_id()).distinct().count() > 1


def test_few_long_queries_are_taken_apart_by_many_tasks(spark):
    log = spark.sql("SELECT 'u' AS user, '240101000000' AS time, concat_ws(' ', transform(sequence(1, 50), x -> 'w' || (id * 50 + x))) AS query "
                    "FROM range(0, 64, 1, 1)")
    ngrams = phrases.hourly_ngrams(log)
    plan = ngrams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")  # dealt out before there are many rows
    assert ngrams.count() == 64 * (50 + 49)


def test_pass_on_deals_rows_out_before_it_combines_them(spark, rows):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "job string, dep string")
    outputs = spark.createDataFrame([("x", "k", "1"), ("y", "k", None), ("x", "m", "2"), ("y", "n", "3")], "job string, key string, value string")
    own = spark.createDataFrame([("a", "n", None), ("c", "k", "4")], "job string, key string, value string")
    seen = config.pass_on(edges, outputs, own)
    assert rows(seen) == sorted([("a", "k", None), ("a", "m", "2"), ("a", "n", None), ("b", "k", None), ("b", "n", "3"), ("c", "k", "4")], key=repr)
    assert "Repartition 4, true" in seen._jdf.queryExecution().optimizedPlan().toString()


def test_sums_in_order_of_keys_over_several_files(spark):
    """A key over all files, keys at their edges, null keys and no keys at all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = [(k, i, i % 5 + 1) for k, n in ((None, 40), ("a", 1), ("b", 300), ("c", 2), ("d", 90)) for i in range(n)]
        df = spark.createDataFrame(listed, "k string, i int, v long").repartition(5)
        for keys in (["k"], []):
            got = ordering.summed(df, keys, ["i"] if keys else ["k", "i"], "v", "sum")
            assert got.columns == ["k", "i", "v", "sum"]
            wanted, total = {}, defaultdict(int)
            for k, i, v in listed:
                total[k if keys else 0] += v
                wanted[k, i] = total[k if keys else 0]
            assert {(r.k, r.i): r["sum"] for r in got.collect()} == wanted and got.count() == len(listed)
        assert ordering.summed(df.limit(0), ["k"], ["i"], "v", "sum").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
