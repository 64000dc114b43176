"""Files on disk, and streams over them."""

import os
import pathlib
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators import rows as row_ops
from millrace.plans import phrases, steps, words
from millrace.session import scratch_path, shared_folder
from millrace.sources import files, records
from millrace.streaming import state


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_text_offsets(spark, tmp_path, rows):
    put(tmp_path, "a.txt", "one\ntwo\n\nthree")
    got = files.read_text(spark, str(tmp_path), offsets=True)
    assert rows(got, "offset", "line") == [(0, "one"), (4, "two"), (8, ""), (9, "three")]
    many = "".join(f"line {n}\r\n" if n % 3 else f"é{n}\n" for n in range(500))
    put(tmp_path, "more/b.txt", many)
    raw = many.encode()
    for r in files.read_text(spark, str(tmp_path / "more"), offsets=True).collect():
        assert raw[r.offset:].split(b"\n")[0].rstrip(b"\r").decode() == r.line
    with pytest.raises(ValueError, match="input path"):
        files.read_text(spark, None)


def test_latest_and_first(spark, tmp_path):
    for name in ("2024-01-01", "2024-02-01", "2023-12-31"):
        spark.createDataFrame([(name,)], "d string").write.parquet(str(tmp_path / name))
    assert files.read_records(spark, f"{tmp_path}#LATEST/ignored").first()["d"] == "2024-02-01"
    assert files.read_records(spark, f"{tmp_path}#LATEST", pick="first").first()["d"] == "2023-12-31"
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.latest(spark, f"{tmp_path}/empty#LATEST")


def test_staged_overwrite_leaves_the_target_when_the_write_fails(spark, tmp_path):
    target, staging = str(tmp_path / "out"), str(tmp_path / "staging")
    files.staged_overwrite(spark.range(3), target, staging, "job")
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.staged_overwrite(bad, target, staging, "job")
    assert spark.read.parquet(target).count() == 3
    files.staged_overwrite(spark.range(5), target, staging, "job")
    assert spark.read.parquet(target).count() == 5


def test_write_records_checks_first(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_records(spark.range(1), str(tmp_path / "x"), row_ops.schema_from_text("{'other':'int64'}"))
    assert not os.path.exists(tmp_path / "x")


def test_preview_counts_over_splits(spark, tmp_path, rows):
    put(tmp_path, "log.txt", "".join(f"line {i}\n" for i in range(1, 400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        out = files.preview(spark, str(tmp_path), 100, 110)
        assert [(r, line) for _, r, line in rows(out)] == [(i, f"line {i}") for i in range(100, 110)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_history(spark, tmp_path, rows):
    done = "start=1704067200500\nend=1704067260500\nsucceeded=true\njobNotStaleException=false\n"
    put(tmp_path, "load/01-01-2024.00.00.00.500/run.properties", "#comment\n" + done)
    put(tmp_path, "load/01-02-2024.00.00.00.000/load.01-02-2024.00.00.00.000.log", "still at it\n")
    put(tmp_path, "load/not-a-time/run.properties", done)
    found = rows(records.read_runs(spark, str(tmp_path)))
    assert [(j, str(s), str(e), ok) for j, s, e, ok, _ in found] == [
        ("load", "2024-01-01 00:00:00.500000", "2024-01-01 00:01:00.500000", True),
        ("load", "2024-01-02 00:00:00", "None", False)]
    assert found[0][4] == "load/01-01-2024.00.00.00.500/load.01-01-2024.00.00.00.500.log"


def test_job_definitions(spark, tmp_path, rows):
    put(tmp_path, "common.properties", "zone=top\nowner: me\n")
    put(tmp_path, "sub/x.schema", "zone = sub\n")
    put(tmp_path, "sub/ship.job", "# job\ntype=push\ndependencies=load,clean")
    put(tmp_path, "other/ship.job", "type=twin\n")
    put(tmp_path, "sub/__MACOSX/y.job", "type=none\n")
    put(tmp_path, "sub/notes.txt", "zone=ignored\n")
    out = records.read_job_definitions(spark, str(tmp_path))
    assert rows(out, "scope", "parent", "key", "value") == sorted([
        ("dir:", None, "zone", "top"), ("dir:", None, "owner", "me"), ("dir:sub", "dir:", "zone", "sub"),
        ("job:sub/ship.job", "dir:sub", "type", "push"),
        ("job:sub/ship.job", "dir:sub", "dependencies", "load,clean"),
        ("job:other/ship.job", "dir:other", "type", "twin")], key=repr)
    assert rows(records.duplicate_definitions(out)) == [("ship", 2)]


def test_flow_documents_one_per_file(spark, tmp_path, rows):
    put(tmp_path, "7.json", '{"type":"flow",\n"flow":{"jobs":{"a":{"status":"RUNNING","name":"a"}},'
                            '"root":["a"],"dependencies":{},"id":"7"},"parentProps":{}}')
    put(tmp_path, "notes.txt", "x")
    out = records.read_flows(spark, str(tmp_path))
    assert [(r.id, r.jobs["a"].status, r.root) for r in out.collect()] == [("7", "RUNNING", ["a"])]


def test_schedules(spark, rows):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    lines = spark.createDataFrame([
        ("a", "2023-01-01.00.00.00.000 1d true"), ("b", "2023-01-01.00.00.00.000 n false"),
        ("c", "2025-01-01.00.00.00.000 n TRUE"), ("d", "2025-01-01.00.00.00.000 1d"), ("e", "a b c d")], "key string, value string")
    assert rows(records.parse_schedules(lines, now), "name", "period", "ignore_dep") == [("a", "1d", True), ("c", "n", True)]


def test_log_lines(spark):
    df = spark.createDataFrame([("02-01-2024 03:04:05 job7 WARN - a - b",), ("no log line",)], "line string")
    first, second = records.parse_log_lines(df).collect()
    assert (str(first.ts), first.logger, first.level, first.message) == ("2024-01-02 03:04:05", "job7", "WARN", "a - b")
    assert second.ts is None and second.level is None
    child = records.parse_child_lines(spark.createDataFrame([("ERROR: x",), ("plain",)], "line string")).collect()
    assert [(r.level, r.message) for r in child] == [("ERROR", ": x"), ("INFO", "plain")]


def test_avro_is_gated(spark, tmp_path):
    if not files.has_avro(spark):
        with pytest.raises(ModuleNotFoundError):
            files.read_as_json(spark, str(tmp_path))


def test_phrases_by_hand(spark, rows):
    log = [(f"u{i}", f"24010{1}{h:02d}0000", "Cats") for h, n in ((0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (12, 9)) for i in range(n)]
    # Asked again by the same user, which counts once, then a URL and a blank.
    log += [("u0", "240101000000", "cats"), ("u0", "240101000000", "http://cats"), ("u0", "240101000000", " ")]
    df = spark.createDataFrame(log, "user string, time string, query string")
    found = phrases.popular_phrases(df).collect()
    assert [(r.hour, r.ngram, r["count"]) for r in found] == [("12", "cats", 9)]
    mean = 14 / 6
    spread = (sum((c - mean) ** 2 for c in (1, 1, 1, 1, 1, 9)) / 6) ** .5
    assert found[0].score == pytest.approx((9 - mean) / spread)
    both = rows(phrases.phrases_in_both_hours(df))
    assert both == [("cats", 1, 9)]
    assert both == rows(phrases.join_hours(phrases.hour_frequency(phrases.hourly_ngrams(df))))


def test_word_count(spark, rows):
    df = spark.createDataFrame([("a b\ta",), ("",), ("\fb\r",)], "line string")
    assert rows(words.word_count(df)) == [("a", 2), ("b", 2)]


def test_steps(spark):
    def add(name):
        return lambda df: df.withColumn("trace", F.concat("trace", F.lit(name)))

    df = spark.createDataFrame([("",)], "trace string")
    assert steps.compose(add("a"), add("b"), add("c"))(df).first()[0] == "cba"
    assert steps.staged(df, add("a"), add("b")).first()[0] == "ab"
    assert steps.compose()(df).first()[0] == ""
    done = []

    def fail():
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        steps.run_in_order(lambda: done.append(1), fail, lambda: done.append(2))
    assert done == [1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with steps.settings(spark, {"spark.sql.shuffle.partitions": 3}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_observed_rows(spark):
    df, seen = row_ops.counted(spark.range(17))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 17


def test_shared_folder_is_the_one_of_the_session(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == folder
    assert scratch_path(spark, "x").startswith(folder) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stream_restarts_where_it_stopped(spark, tmp_path, rows):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(data):
        spark.createDataFrame(data, "source string, pos long, line string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("source string, pos long, line string").parquet(source)
        with state.state_in_files(spark):
            state.start_updates(state.last_lines(stream, n=3, slots=2), target, progress).awaitTermination()
        return rows(state.read_last_lines(spark, target, 3), "source", "rank", "line")

    arrive([("a", i, f"l{i}") for i in range(5)] + [("b", 0, "only")])
    assert run() == [("a", 1, "l2"), ("a", 2, "l3"), ("a", 3, "l4"), ("b", 1, "only")]
    arrive([("a", i, f"l{i}") for i in range(5, 7)])
    assert run() == [("a", 1, "l4"), ("a", 2, "l5"), ("a", 3, "l6"), ("b", 1, "only")]


def test_fixed_values_are_in_use():
    assert fixed.TAIL_BYTES == 204800 and fixed.RUN_DIR_FORMAT.count(".") == 4


def test_property_files_continue_and_escape(spark):
    text = ["# comment\\", "dependencies = a,\\", "     b,\\", "\t c", "!x", "", "path=C:\\\\temp\\", "more", "k\\:1\\ 2 : v\\u00e9\\=",
            "even=x\\\\", "next word", "alone"]
    lines = spark.createDataFrame([("f", n, x) for n, x in enumerate(text)], "path string, pos int, line string")
    got = {r.key: r.value for r in records.property_lines(records.logical_lines(lines)).collect()}
    assert got == {"dependencies": "a,b,c", "path": "C:\\tempmore", "k:1 2": "vé=", "even": "x\\", "next": "word", "alone": ""}


def test_updates_are_compacted_to_a_row_per_key(spark, tmp_path, rows):
    arriving, target = str(tmp_path / "in"), str(tmp_path / "updates")
    schema = "job string, succeeded boolean"
    for n in range(5):
        spark.createDataFrame([("a", True), (f"b{n}", False)], schema).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    stats = state.run_stats(stream)
    state.start_updates(stats, target, str(tmp_path / "progress"), keys=["job"], compact_every=2).awaitTermination()
    state.compact(spark, target, ["job"], stats.schema)
    state.compact(spark, target, ["job"], stats.schema)
    stored = spark.read.parquet(target)
    assert stored.count() == 6 and stored.filter("job = 'a'").first().runs == 5
    assert rows(state.read_updates(spark, target, ["job"], stats.schema)) == [
        ("a", 5, 5), *[(f"b{n}", 1, 0) for n in range(5)]]


ODD_NAMES = ["my job", "a%20b", "é+ü #1", "plain", "😀 x", "50%"]


@pytest.fixture
def run_tree(spark, tmp_path):
    root = str(tmp_path / "runs of + jobs %41")
    done = "start=1704164645006\nend : 1704164999000\nsucceeded true\n"
    rows = [(f"{n}/01-02-2024.03.04.05.006/run.properties", done) for n in ODD_NAMES]
    rows += [(f"{n}/{d}/x.log", "hi") for n in ODD_NAMES for d in ("01-02-2024.03.04.05.006", "02-02-2024.03.04.05.006", "notes")]
    assert files.write_named(spark.createDataFrame(rows, "name string, text string"), root) == len(rows)
    return root


def test_runs_of_jobs_with_odd_names(spark, run_tree):
    got = {(r.job, str(r.started)): (str(r.ended), r.succeeded, r.log) for r in records.read_runs(spark, run_tree).collect()}
    assert got == {**{(n, "2024-01-02 03:04:05.006000"): ("2024-01-02 03:09:59", True,
                                                          f"{n}/01-02-2024.03.04.05.006/{n}.01-02-2024.03.04.05.006.log") for n in ODD_NAMES},
                   **{(n, "2024-02-02 03:04:05.006000"): ("None", False,
                                                          f"{n}/02-02-2024.03.04.05.006/{n}.02-02-2024.03.04.05.006.log") for n in ODD_NAMES}}


def test_a_filter_on_a_job_opens_its_files_only(spark, run_tree):
    runs = records.read_runs(spark, run_tree)
    for name in ODD_NAMES[1:]:
        shutil.rmtree(f"{run_tree}/{name}")  # opening one of these files would fail from here on
    assert [r.succeeded for r in runs.filter("job = 'my job'").orderBy("started").collect()] == [True, False]


def test_job_definitions_with_odd_names(spark, tmp_path):
    root = str(tmp_path / "jobs + %20")
    text = [("s dir/a b/my first+.job", "type=java\\\n  script\n"), ("s dir/one.properties", "k=1\nk=2"), ("s dir/two.properties", "k=3"),
            ("top%41.job", "k=x"), ("__MACOSX/a.job", "k=y"), ("s dir/.hidden.job", "k=z"), ("s dir/readme.txt", "k=r")]
    files.write_named(spark.createDataFrame(text, "name string, text string"), root)
    got = sorted(map(tuple, records.read_job_definitions(spark, root + "/").collect()))
    assert got == [("dir:s dir", "dir:", "config", "k", "3", None),
                   ("job:s dir/a b/my first+.job", "dir:s dir/a b", "job", "type", "javascript", "my first+"),
                   ("job:top%41.job", "dir:", "job", "k", "x", "top%41")]


def test_files_of_several_splits_keep_their_lines_in_order(spark, tmp_path):
    lines = "".join(f"k{n} = a,\\\n   b{n}\n" for n in range(400))
    files.write_named(spark.createDataFrame([("x/big.job", lines)], "name string, text string"), str(tmp_path))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "512")
    try:
        got = {r.key: r.value for r in records.read_job_definitions(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {f"k{n}": f"a,b{n}" for n in range(400)}


ODD_ENTRIES = [("a b/c%", "a key", "  v w "), ("a b/c%", "=x:#!", 'C:\\new\tz\n"é😀\\u0041'), ("007", "k\\", "#e"),
               ("s+é", "ключ", ""), ("s+é", "n", None), ("s+é", "\t\r\n\f", "\\"), ("s+é", "x", " "), ("s+é", "trail", "y \\ ")]


def test_config_files_are_read_back(spark, tmp_path):
    path = str(tmp_path / "config out")
    records.write_config(spark.createDataFrame(ODD_ENTRIES, "scope string, key string, value string"), path)
    got = sorted(map(tuple, records.read_config(spark, path).collect()))
    assert got == sorted((s, k, v or "") for s, k, v in ODD_ENTRIES)
    written = [f for f in pathlib.Path(path).rglob("*.txt")]
    assert len(written) == 3 and all(f.read_bytes().isascii() for f in written)


@pytest.mark.skipif(shutil.which("java") is None, reason="the library of the language is asked through Spark's own")
def test_config_lines_are_those_of_the_standard_library(spark):
    """java.util.Properties reads the lines, and writes the same ones."""
    jvm = spark.sparkContext._jvm
    entries = [(k, v or "") for _, k, v in ODD_ENTRIES]
    df = spark.createDataFrame([("s", k, v) for k, v in entries], "scope string, key string, value string")
    lines = {r.key: r.line for r in records.config_lines(df).collect()}
    props = jvm.java.util.Properties()
    props.load(jvm.java.io.StringReader("\n".join(lines.values())))
    assert {k: props.getProperty(k) for k, _ in entries} == dict(entries)
    for key, value in entries:
        one = jvm.java.util.Properties()
        one.setProperty(key, value)
        out = jvm.java.io.ByteArrayOutputStream()
        one.store(out, None)
        assert lines[key] in out.toString().split("\n")[1:], key


def test_schedule_log_and_output_files(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    text = [("a b/s.schedule", "x\\ y = 2025-01-01.00.00.00.000 \\\n  1d true\n#z\nbad = 1 2\n")]
    files.write_named(spark.createDataFrame(text, "name string, text string"), str(tmp_path / "schedules"))
    found = records.read_schedules(spark, str(tmp_path / "schedules"), now).collect()
    assert [(r.name, r.period, r.ignore_dep, r.problem) for r in found] == [("x y", "1d", True, None)]
    text = [("j é/r.log", "02-01-2024 03:04:05 job7 WARN - a - b\n  more\n"), ("j é/r.txt", "no log")]
    files.write_named(spark.createDataFrame(text, "name string, text string"), str(tmp_path / "logs"))
    found = records.read_logs(spark, str(tmp_path / "logs")).orderBy("path", "pos").collect()
    assert [(r.path.split("/")[-2], r.line, r.message) for r in found] == [("j é", "02-01-2024 03:04:05 job7 WARN - a - b", "a - b"), ("j é", "  more", None)]
    text = [("a+b.json", '{"k": 1,\n "l": "x"}'), ("none.json", ""), ("bad %.json", "{")]
    files.write_named(spark.createDataFrame(text, "name string, text string"), str(tmp_path / "outputs"))
    assert sorted(map(tuple, records.read_outputs(spark, str(tmp_path / "outputs")).collect())) == [("a+b", "k", "1"), ("a+b", "l", "x")]


def test_listing_of_one_directory(spark, tmp_path):
    (tmp_path / "empty é").mkdir()
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x").write_text("1")
    (tmp_path / "f 1%").write_text("123")
    (tmp_path / "_hidden").write_text("1")
    wanted = [("deep/", True, None), ("empty é/", True, None), ("f 1%", False, 3)]
    for page in (100, 2, 1):
        assert sorted(map(tuple, files.list_directory(spark, str(tmp_path), page=page).collect())) == wanted
    assert files.list_directory(spark, str(tmp_path), hidden=True).count() == 4


def arrivals(spark, folder, batches, schema):
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are taken in by their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_without_state(spark, tmp_path, rows):
    """Many batches of new ids, and copies that come late: no rows of state, and an older copy never replaces a newer."""
    rng, batches, newest = random.Random(4), [], {}
    for n in range(8):
        own = [(f"new{n}", n, f"s{n}")] + [(f"id{rng.randrange(5)}", s, f"s{s}") for s in rng.sample(range(100), 4)]
        batches.append(own)
        for i, seq, _ in own:
            newest[i] = max(newest.get(i, -1), seq)
    saves = arrivals(spark, str(tmp_path / "in"), batches, "id string, seq long, state string")
    target = str(tmp_path / "out")
    stream = state.start_updates(saves, target, str(tmp_path / "progress"), reduce=state.latest_state, merge=state.merged_state, compact_every=3)
    stream.awaitTermination()
    assert all(not p.get("stateOperators") for p in stream.recentProgress)
    got = state.read_updates(spark, target, state.merged_state, state.latest_state(spark.createDataFrame([], saves.schema)).schema)
    assert rows(got) == sorted(((i, seq, f"s{seq}") for i, seq in newest.items()), key=repr)


@pytest.mark.parametrize("broken_at", [0, 2, 3, 5])
def test_a_merge_that_breaks_off_counts_nothing_twice(spark, tmp_path, rows, monkeypatch, broken_at):
    target, schema = str(tmp_path / "sets"), "job string, runs long, successes long"
    for n in range(4):
        spark.createDataFrame([("a", 1, n % 2), (f"b{n}", 2, 0)], schema).coalesce(1).write.parquet(f"{target}/batch={n}")
    wanted = sorted([("a", 4, 2), *[(f"b{n}", 2, 0) for n in range(4)]])
    types, steps_done = spark.createDataFrame([], schema).schema, [0]

    class Failing:
        """A file system that stops at one of its changes."""
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            call = getattr(self.fs, name)
            if name not in ("create", "delete", "rename"):
                return call

            def step(*a):
                if steps_done[0] == broken_at:
                    raise OSError("stopped")
                steps_done[0] += 1
                return call(*a)
            return step

    real = files.file_system
    with monkeypatch.context() as m:
        m.setattr(state.files, "file_system", lambda s, p: (Failing(real(s, p)[0]), real(s, p)[1]))
        with pytest.raises(OSError, match="stopped"):
            state.compact(spark, target, state.merged_stats, types)
    assert rows(state.read_updates(spark, target, state.merged_stats, types)) == wanted
    state.compact(spark, target, state.merged_stats, types)
    assert rows(state.read_updates(spark, target, state.merged_stats, types)) == wanted
    assert rows(spark.read.schema(schema).parquet(target).drop("batch")) == wanted


def test_a_silent_source_leaves_the_state(spark, tmp_path, rows):
    schema, target, progress = "source string, pos long, line string", str(tmp_path / "out"), str(tmp_path / "progress")

    def run(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with state.state_in_files(spark):
            state.start_updates(state.last_lines(stream, n=3, slots=1, silent_ms=1500), target, progress,
                                merge=state.merged_lines(3), compact_every=1).awaitTermination()
        return {(r.source, r.line) for r in state.read_last_lines(spark, target, 3).collect()}

    def held():
        table = spark.read.format("statestore").option("stateVarName", "lines").load(progress)
        return {r[0] for r in table.select("key.source").collect()}

    assert run([("quiet", n, f"q{n}") for n in range(3)] + [("loud", n, f"l{n}") for n in range(5)]) == {
        ("quiet", "q0"), ("quiet", "q1"), ("quiet", "q2"), ("loud", "l2"), ("loud", "l3"), ("loud", "l4")}
    assert held() == {"quiet", "loud"}
    time.sleep(2)
    run([("loud", 5, "l5")])
    run([("loud", 6, "l6")])
    assert held() == {"loud"}
    # What the silent one had said is still in the updates when it speaks again.
    assert run([("quiet", 3, "q3")]) >= {("quiet", "q1"), ("quiet", "q2"), ("quiet", "q3"), ("loud", "l6")}
    assert spark.read.parquet(target).count() == 2

def test_last_lines_without_state_cut_each_batch(spark, tmp_path, rows):
    schema, arriving, target = "source string, pos long, line string", str(tmp_path / "in"), str(tmp_path / "out")
    for start in (0, 4, 8):
        spark.createDataFrame([(s, n, f"{s}{n}") for s in ("a", "b") for n in range(start, start + 4)] + [("c", 1, "same")], schema) \
            .coalesce(1).write.mode("append").parquet(arriving)
    stream, cut = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving), state.newest_lines(3)
    state.start_updates(stream, target, str(tmp_path / "progress"), reduce=cut, merge=cut, compact_every=2).awaitTermination()
    assert spark.read.parquet(target).count() == (3 + 3 + 2) + (3 + 3 + 1)  # a merged set and a batch, three lines a source at most
    assert rows(state.read_updates(spark, target, cut, stream.schema)) == [
        (s, n, f"{s}{n}") for s in ("a", "b") for n in (10, 11, 9)] + [("c", 1, "same")] * 3


def test_trees_are_listed_and_read_by_tasks(spark, run_tree):
    found = {r.path.removeprefix(run_tree + "/") for r in files.tree(spark, run_tree).collect()}
    assert len(found) == 4 * len(ODD_NAMES) and "a%20b/notes/x.log" in found
    # No list of the files is kept in the plan, where the driver would hold it.
    assert not [f for f in records.read_runs(spark, run_tree).inputFiles() if "run.properties" in f or f.endswith(".log")]


def test_config_files_of_no_and_of_many_scopes(spark, tmp_path):
    schema, modes = "scope string, key string, value string", str(tmp_path / "modes")
    entries = [(f"s{n}/?", f"k{i}", f"{n}.{i}") for n in range(40) for i in range(3)] + [(None, "k", "of none")]
    records.write_config(spark.createDataFrame(entries, schema), modes)
    assert sorted(map(tuple, records.read_config(spark, modes).collect()), key=repr) == sorted(entries, key=repr)
    assert spark.read.schema("value string, scope string").text(modes).filter("scope = 's7/?'").count() == 3
    with pytest.raises(FileExistsError):
        records.write_config(spark.createDataFrame(entries, schema), modes)
    records.write_config(spark.createDataFrame(entries[:1], schema), modes, mode="overwrite")
    assert records.read_config(spark, modes).count() == 1
    records.write_config(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert records.read_config(spark, str(tmp_path / "none")).count() == 0
