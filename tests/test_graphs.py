"""Levels, cycles and reach on graphs of many shapes, against plain Python."""

import json
import random
from collections import defaultdict

import pytest

from millrace.operators import graph, paths, trees


def reach(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[start] = seen
    return out


def expected(nodes, edges):
    """(levels, cycle members by name, problems)."""
    far = reach(edges)
    needs = defaultdict(set)
    for a, b in edges:
        needs[a].add(b)
    looping = {v for v in nodes if v in far.get(v, ())}
    stuck = looping | {v for v in nodes if far.get(v, set()) & looping}
    level = {}

    def of(v):
        if v not in level:
            level[v] = max((of(w) + 1 for w in needs[v]), default=0)
        return level[v]
    for v in sorted(nodes, key=lambda v: len(far.get(v, ()))):  # what is below first, so recursion stays shallow
        if v not in stuck:
            of(v)
    cycle = {v: min(w for w in far[v] if v in far[w]) for v in looping if any(w != v and v in far[w] for w in far[v])}
    problems = {v: (cycle[v], "member") if v in cycle else (v, "self") if (v, v) in edges else (None, "above") for v in stuck}
    return level, problems


def shapes():
    rng = random.Random(5)
    for n, m in ((40, 48), (60, 150)):
        yield f"random {n} {m}", {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}, n
    for n in (50,):
        yield f"dag {n}", {(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.randint(0, 2))}, n
    two = {(0, 1), (1, 2), (2, 0), (2, 10), (10, 11), (11, 12), (12, 10), (20, 0), (12, 30), (31, 31), (40, 31), (5, 6), (6, 7), (7, 8), (9, 5)}
    yield "two cycles and a way between", two, 45
    yield "rings behind a stretch, and one alone", ({(n, 50 + (n - 49) % 9) for n in range(50, 59)} | {(n, n + 1) for n in range(20)} | {(20, 21), (21, 22), (22, 20)} | {(30, 25), (25, 26), (26, 30), (26, 0)}), 60
    yield "loop through stretches", ({(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (4, 5), (5, 0), (6, 7), (7, 8), (6, 8), (8, 9), (8, 10), (10, 9)}), 11
    yield "self on a cycle", {(0, 1), (1, 0), (0, 0), (2, 2), (2, 0)}, 3
    yield "nothing", set(), 4


@pytest.mark.parametrize("name, edges, n", [pytest.param(*s, id=s[0]) for s in shapes()])
def test_levels_and_cycles(spark, name, edges, n):
    nodes = [f"n{v:03}" for v in range(n)]
    named = {(f"n{a:03}", f"n{b:03}") for a, b in edges}
    v, e = spark.createDataFrame([(x,) for x in nodes], "job string"), spark.createDataFrame([*named, *list(named)[:2]], "job string, dep string")
    level, problems = expected(nodes, named)
    found, stuck = paths.levels(v, e)
    assert dict(map(tuple, found.collect())) == level
    assert {r.job for r in stuck.collect()} == set(problems)
    assert {r.job: (r.cycle, r.problem) for r in graph.cycle_members(v, e).collect()} == problems


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    write = paths.written
    for name in ("written", "written_counting"):
        real = getattr(paths, name)
        monkeypatch.setattr(paths, name, lambda *a, _real=real, **k: (rounds.append(a[1:2]), _real(*a, **k))[1])
    assert write is not paths.written
    e = spark.range(1, n).selectExpr("concat('j', id) AS job", "concat('j', id - 1) AS dep")
    got = dict(map(tuple, graph.levels(spark.range(n).selectExpr("concat('j', id) AS job"), e).collect()))
    assert got == {f"j{k}": k for k in range(n)} and len(rounds) < 40


@pytest.mark.parametrize("tags", [(), ("root",), ("root", "kind")])
def test_closure(spark, tags):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(110)}
    seeds = [(f"n{k % 90}", None if k % 50 == 7 else f"r{k % 75}", k % 3) for k in range(150)]
    far = reach(edges)
    wanted = set()
    for job, root, kind in seeds:
        key = {"root": root, "kind": kind}
        wanted |= {(*(key[t] for t in tags), x) for x in far.get(job, set()) | {job}}
    df = spark.createDataFrame(seeds, "job string, root string, kind int")
    e = spark.createDataFrame(list(edges), "job string, dep string")
    got = [tuple(r) for r in graph.closure(df, e, tags).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_sets_of_neighbouring_tags_travel_together(spark):
    """200 roots above one ladder: rows are a word of 64 roots each."""
    seeds = spark.range(200).selectExpr("'top' AS job", "concat('r', id) AS root").coalesce(1)
    e = spark.range(30).selectExpr("if(id = 0, 'top', concat('s', id)) AS job", "concat('s', id + 1) AS dep")
    out = graph.closure(seeds, e, ("root",))
    assert out.count() == 200 * 31


def test_tags_are_neighbours_by_their_first_job_and_rounds_write_what_is_new(spark, monkeypatch):
    """1,024 roots in shuffled order above one tree: words of them share nearly all, and a row of bits is written once."""
    counts, real = [], graph.written_counting
    monkeypatch.setattr(graph, "written_counting", lambda *a, **k: (lambda out: (counts.append(out[1]["rows"]), out)[1])(real(*a, **k)))
    e = spark.range(2, 2048).selectExpr("concat('j', lpad(id, 4, '0')) AS job", "concat('j', lpad(id div 2, 4, '0')) AS dep")
    seeds = (spark.range(1024, 2048).selectExpr("concat('j', lpad(id, 4, '0')) AS job").selectExpr("job AS root", "job")
             .orderBy("root").repartition(4))
    out = {tuple(r) for r in graph.closure(seeds, e, ("root",)).collect()}
    assert out == {(f"j{k:04}", f"j{k >> d:04}") for k in range(1024, 2048) for d in range(11)}
    # 2,047 jobs; those near the top are in the words of all 16 groups of 64 neighbours.
    assert sum(counts) < 2500


@pytest.mark.parametrize("tags", [(), ("root",)])
def test_closure_over_merged_tables(spark, monkeypatch, tags):
    monkeypatch.setattr(graph, "TABLES", 3)
    seeds = spark.createDataFrame([("r", "n0"), ("s", "n4")], "root string, job string")
    e = spark.range(12).selectExpr("concat('n', id) AS job", "concat('n', if(id = 11, 3, id + 1)) AS dep")
    got = [tuple(r) for r in graph.closure(seeds, e, tags).collect()]
    wanted = {("r", f"n{k}") for k in range(12)} | {("s", f"n{k}") for k in range(3, 12)}
    assert len(got) == len(set(got)) and set(got) == (wanted if tags else {(j,) for _, j in wanted})


def nested(root, needs, parents):
    """The document that the pieces must come to."""
    def of(job):
        return {"name": job, "dependencies": [of(d) if parents.get(d) == job else {"name": d} for d in sorted(needs[job])]}
    return of(root)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_come_to_the_nested_document(spark, seed):
    rng = random.Random(seed)
    names = [f'j{v:02}"\\' if v % 9 == 0 else f"j{v:02}" for v in range(40)]
    edges = {(names[a], names[rng.randrange(a)]) for a in range(1, 40) for _ in range(rng.randint(0, 3))}
    edges |= {(names[a], names[a - 1]) for a in range(20, 30)} | {(names[5], names[5])}
    if seed == 2:
        edges |= {(names[3], names[8]), (names[8], names[3])}  # a cycle that roots may reach
    needs = defaultdict(set)
    for a, b in edges:
        if a != b:
            needs[a].add(b)
    roots = sorted(set(names) - {b for a, b in edges if a != b})
    parents, layer = dict.fromkeys(roots), roots
    while layer:
        found = {}
        for a in sorted(layer):
            for b in needs[a]:
                if b not in parents:
                    found.setdefault(b, a)
        parents |= found
        layer = list(found)
    got = defaultdict(list)
    for r in trees.tokens(spark.createDataFrame([(x,) for x in names], "job string"),
                          spark.createDataFrame(list(edges), "job string, dep string")).collect():
        got[r.root].append((r.pos, r.piece))
    assert sorted(got) == roots
    for root, pieces in got.items():
        assert sorted(p for p, _ in pieces) == list(range(len(pieces)))
        assert json.loads("".join(text for _, text in sorted(pieces))) == nested(root, needs, parents)


def test_a_search_reads_only_edges_to_what_is_not_met(spark, monkeypatch):
    """Edges are written anew without those to jobs that have been met; results stay those of the whole table."""
    monkeypatch.setattr(trees, "FEW_EDGES", 4)
    kept, real = [], trees.written_counting

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "steps":
            kept.append(out[1]["rows"])
        return out
    monkeypatch.setattr(trees, "written_counting", counted)
    n = 200
    edges = {(f"j{k:03}", f"j{d:03}") for k in range(2, n) for d in (k // 2, k // 3)}
    needs, parents, layer = defaultdict(set), {}, [f"j{k:03}" for k in range(n // 2, n)]
    for a, b in edges:
        needs[a].add(b)
    parents = dict.fromkeys(layer)
    while layer:
        found = {}
        for a in sorted(layer):
            for b in needs[a]:
                if b not in parents:
                    found.setdefault(b, a)
        parents |= found
        layer = list(found)
    e = spark.createDataFrame(sorted(edges), "job string, dep string")
    roots = spark.range(n // 2, n).selectExpr("concat('j', lpad(id, 3, '0')) AS job")
    got = [tuple(r) for r in trees.first_met(roots, e).collect()]
    assert len(got) == len(parents) and dict(got) == parents
    assert len(kept) >= 3 and kept == sorted(kept, reverse=True) and kept[0] < len(edges)


def test_jobs_at_the_top_have_no_part_in_joins_by_pointer(spark):
    """Half of the jobs point to nothing: their nulls would meet in one task of a left join."""
    state = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "b", 4), ("d", None, 8)], "job string, up string, value long")
    above = state.selectExpr("job AS up", "up AS up_2", "value AS value_2")
    below = trees._add_below(state, above)
    assert {r.job: (r.up, r.value) for r in below.collect()} == {"a": (None, 3), "b": (None, 6), "c": ("a", 4), "d": (None, 8)}
    plan = below._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (up" not in plan
    assert {r.job: r.value for r in trees._doubled(state, trees._add_below).collect()} == {"a": 7, "b": 6, "c": 4, "d": 8}
