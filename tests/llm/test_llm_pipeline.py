"""The pipeline stage by stage on the smallest tables, each against brute force on its own input."""

import collections
import os
import re

import duckdb
import public_tokenizers
import pytest
from test_llm_operators import jaccard_components

import check
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from millrace.llm import pretokens, quality
from millrace.session import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and result."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, FOLDER), "stage")
        out.append((docs.collect(), result.collect(), docs.columns, result.columns))
        docs = result
    return out


def test_the_stages_in_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "near dedup", "benchmark decontamination", "packing"]
    assert all(before == after for _, _, before, after in stages[:-1])


def test_quality_keeps_what_the_network_keeps(spark, stages):
    before, after, *_ = stages[0]
    net = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = net.scores([r.text.encode() for r in before])
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores) if s >= 0.3}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.95


def test_lines_stay_in_the_first_document(stages):
    before, after, *_ = stages[1]

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    first = collections.defaultdict(set)
    for r in before:
        for line in r.text.split("\n"):
            first[key(line)].add(r.doc_id)
    wanted = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(key(x)) < 10 or min(first[key(x)]) == r.doc_id)
              for r in before}
    assert {r.doc_id: r.text for r in after} == wanted
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_document_of_each_group_stays(stages):
    before, after, *_ = stages[2]
    rows = [(r.doc_id, r.text) for r in before]
    _, component = jaccard_components(rows, 5, 80)
    groups = collections.defaultdict(list)
    for (doc, _), c in zip(rows, component):
        groups[c].append(doc)
    assert {r.doc_id for r in after} == {min(g) for g in groups.values()}


def test_no_benchmark_item_is_left(spark, stages):
    before, after, *_ = stages[3]

    def plain(text):
        return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before if any(item in plain(r.text) for item in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == held


def test_every_token_is_packed_once(stages):
    before, after, *_ = stages[4]
    library = pretokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = collections.Counter()
    for r in after:
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}


def test_run_and_the_registered_queries(spark, stages):
    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sum(r.length for r in rows.collect()) == sum(r.length for r in stages[-1][1])


@pytest.mark.parametrize("name", ["op3_vector_search", "op6_near_dedup", "op8_line_dedup", "op11_hard_negatives"])
def test_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    ok, note = check.compare(spark, connection, name, FOLDER)
    assert ok, note


def test_run_over_odd_documents(spark, tmp_path):
    """Nulls, equal ids, a very long text, copies and columns with names that the stages use; then an empty table."""
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = [r for r in source.limit(60).collect()]
    rows = [(r.doc_id, r.text) for r in good] + [(None, good[3].text), (None, None), (7, None), (7, ""), (5000, good[5].text + " more")]
    rows += [(5001, " ".join(r.text for r in good) * 3), (good[0].doc_id, good[0].text), (good[0].doc_id, good[0].text)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "length(text) AS n_chars", "1 AS row", "'v' AS value", "2 AS ids", "3 AS text_hash", "4 AS kept", "5 AS `dotted.name`")
    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{FOLDER}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, folder), "stage")
            assert docs.columns == odd.columns
        lengths = collections.Counter()
        for r in written(corpus_pipeline.STAGES[-1][1](spark, docs, folder), "packed").collect():
            lengths[r.doc_id] += r.length
        library = pretokens.load(public_tokenizers.path("byte_bpe_50k.json"))
        wanted = collections.Counter()
        for r in docs.collect():
            wanted[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert lengths == wanted and (name == "odd") == bool(wanted)
    assert docs.count() == 0
