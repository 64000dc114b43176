"""The ten operators against brute force on small tables with nulls, ties, repeats, long texts and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import (components, decontamination, line_dedup, near_dedup, packing, pretokens, quality, queries, secrets,
                          sharding, token_counts, token_files, vector_search)

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
random.seed(3)
VOCABULARY = ["the", "of", "Ând", "then", "tion", "éau", "ß", "42", "x-y", "it's", "Σ", "and", "ing", "re", "la", "por"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "er", "ly", "ou"]) for _ in range(n))


LONG = prose(9000, 1)
BASE = prose(120, 2)
ODD = ["", None, " ", "\n\n", "a", "\x00", "<|endoftext|> b<|startoftext|>", "  two  spaces \n x", "\x1c\xa0　q",
       "日本語 😀", "aaaa" * 300, LONG, LONG, BASE, BASE, BASE.replace("the", "THE", 1), BASE + " more", prose(60, 4)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("llm"))


@pytest.fixture(scope="module")
def make(spark, folder):
    """A written table of (doc_id, text) with columns whose names the operators use themselves."""
    def table(rows, parts=3):
        path = f"{folder}/{random.random()}"
        (spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
         .selectExpr("*", "1 AS row", "'v' AS value", "2 AS shard", "3 AS node", "4 AS key", "5 AS label", "6 AS part",
                     "7 AS slot", "8 AS score", "9 AS n_lines", "10 AS lost", "11 AS `dotted.name`").write.parquet(path))
        return spark.read.parquet(path)
    return table


@pytest.fixture(scope="module")
def odd(make):
    """Odd texts; the last rows have no id, one id twice, and one row twice."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    return make([*rows, (None, "no id"), (None, BASE), (3, "same id"), (5, "\x00")])


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_librarys_ids():
    column = pa.array([t or "" for t in ODD])
    for words, path in ((pretokens.LowerWords(WORD), WORD), (pretokens.SpacedWords(BYTE), BYTE)):
        library = pretokens.load(path)
        ids, offsets = words(column)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [
            e.ids for e in library.encode_batch(column.to_pylist(), add_special_tokens=False)]


def test_memory_forgets_and_stays_right():
    memory = pretokens.Memory(lambda words: [[len(w)] * len(w) for w in words], most=40)
    for n in range(30):
        words = pa.array([f"{'w' * (1 + (n * i) % 7)}{i % 11}" for i in range(25)])
        codes = memory.codes(words)
        assert memory.lengths[codes].tolist() == [len(w) for w in words.to_pylist()]
        assert memory.pool[memory.starts[codes]].tolist() == [len(w) for w in words.to_pylist()]


def test_token_files(spark, folder, odd):
    path = token_files.write(odd, f"{folder}/orc", WORD, end_id=2)
    library = pretokens.load(WORD)
    rows = token_files.digests(spark, path).collect()
    assert len(rows) == len(ODD) + 4
    wanted = collections.Counter()
    for doc, text in texts(odd):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        wanted[doc, len(ids), crc(ids)] += 1
    assert wanted == collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    one = token_files.read(spark, path, [4])
    assert [r.doc_id for r in one.collect()] == [4]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in one._jdf.queryExecution().toString()


def test_token_counts(odd):
    library = pretokens.load(WORD)
    got = collections.Counter(map(tuple, token_counts.count(odd, WORD, limit=50).collect()))
    wanted = collections.Counter()
    for doc, text in texts(odd):
        n = len(library.encode(text, add_special_tokens=False).ids)
        wanted[doc, len(text.encode()), n, n > 50] += 1
    assert got == wanted


def test_packing(odd):
    library = pretokens.load(BYTE)
    rows = packing.pack(odd, BYTE, length=256, open_windows=3).collect()
    wanted = collections.Counter()
    for doc, text in texts(odd):
        wanted[doc, len(library.encode(text, add_special_tokens=False).ids) + 1] += 1
    pieces = collections.Counter()
    for r in rows:
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert pieces == collections.Counter({k: k[1] * n for k, n in wanted.items()})
    long = [*library.encode(LONG, add_special_tokens=False).ids, 0]
    for r in rows:
        if r.doc_tokens == len(long):
            assert r.ids_crc32 == crc(long[r.start:r.start + r.length])
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256


def test_packed_sequences_hold_the_documents_ids(odd):
    library = pretokens.load(BYTE)
    rows = packing.pack(odd, BYTE, length=256, open_windows=3).collect()
    wanted = collections.Counter()
    for doc, text in texts(odd):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        wanted.update((doc, n, *ids[n:n + 256]) for n in range(0, len(ids), 256))
    assert collections.Counter((r.doc_id, r.start, *r.ids) for r in rows) == wanted
    assert all(len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 for r in rows)
    shared = collections.Counter(r.sequence_id for r in rows)
    assert max(shared.values()) > 1 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_open_windows_merge_over_levels(spark):
    rng = random.Random(1)
    rows = [(p, rng.randint(1, 1023), [(p << 33, 0)]) for p in range(200)]
    df = spark.createDataFrame(rows, packing.WINDOWS)
    once = packing.merge_once(df, 1024, 8).collect()
    assert sum(r.fill for r in once) == sum(r[1] for r in rows)
    assert sorted(m.sequence_id for r in once for m in r.members) == sorted(r[2][0][0] for r in rows)
    assert all(r.fill <= 1024 for r in once)
    assert all(n <= 8 for p, n in collections.Counter(r.part for r in once).items() if p >= 0)


def test_sharding(spark, odd):
    rows = sharding.shuffle(odd, shards=4).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    n = len(ODD) + 4
    assert sorted(map(len, shards.values())) == sorted(n // 4 + (i < n % 4) for i in range(4))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert collections.Counter((r.value.doc_id, r.value.text) for r in rows) == collections.Counter(
        (r.doc_id, r.text) for r in odd.collect())
    assert rows[0].value["dotted.name"] == 11
    plan = sharding.shuffle(odd, shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_moves_the_texts(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_sharding(spark, str(tmp_path)).collect()
    raw = [(doc, text.encode()) for doc, text in texts(odd)]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (doc, len(t) + 1, zlib.crc32(t)) for doc, t in raw)
    # What is lost on the way shows in the digests.
    shuffle = sharding.shuffle
    monkeypatch.setattr(sharding, "shuffle", lambda *a, **b: shuffle(*a, **b).withColumn(
        "value", F.col("value").withField("text", F.lit("lost"))))
    rows = queries.op2_sharding(spark, str(tmp_path)).collect()
    assert {(r.size, r.text_crc32) for r in rows} == {(5, zlib.crc32(b"lost"))}


def test_hypergeometric_has_its_mean_and_spread(spark):
    """5,000 draws of 30 of 100 rows, 40 of them marked."""
    sql = sharding.hypergeometric("100D", "40D", "30D", "u")
    drawn = [r.k for r in spark.range(5000).selectExpr("(xxhash64(id) & 9007199254740991L) / 9007199254740992D AS u")
             .selectExpr(f"{sql} AS k").collect()]
    assert abs(np.mean(drawn) - 12) < 0.15
    assert abs(np.var(drawn) - 30 * 0.4 * 0.6 * 70 / 99) < 0.4
    edge = spark.range(1).selectExpr("0.3D AS u").selectExpr(
        *[f"{sharding.hypergeometric(*a, 'u')} AS x{n}" for n, a in enumerate(
            [("10D", "0D", "5D"), ("10D", "10D", "5D"), ("10D", "4D", "0D"), ("10D", "4D", "10D"), ("0D", "0D", "0D")])])
    assert list(edge.first()) == [0, 5, 0, 4, 0]


def test_the_matrix_keeps_its_margins(spark):
    counts = {p: (p * 37) % 50 for p in range(0, 90, 2) if (p * 37) % 50}
    df = spark.createDataFrame(list(counts.items()), "part bigint, n bigint")
    rows = sharding.communication_matrix(df, 3, 11).collect()
    assert {r.part: sum(r.room) for r in rows} == counts
    total = sum(counts.values())
    assert sorted(map(sum, zip(*[r.room for r in rows]))) == sorted(total // 3 + (i < total % 3) for i in range(3))
    assert all(x >= 0 for r in rows for x in r.room)


def test_vector_search(spark, folder):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(120)]
    rows += [(120 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [1.0]),
             (204, [float("inf"), 1.0, 1.0, 1.0]), (250, [2.0]), (None, [9.0, 9.0, 9.0, 9.0]), (50, [5.0, 5.0, 5.0, 5.0]),
             (300, []), (350, [])]
    path = f"{folder}/vectors"
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr(
        "*", "1 AS row", "2 AS tile", "3 AS asks").write.parquet(path)
    shard_rows, vector_search.ROWS_PER_SHARD = vector_search.ROWS_PER_SHARD, 2
    fan, vector_search.FAN = vector_search.FAN, 4
    got = vector_search.search(spark.read.parquet(path), F.expr("vec_id % 50 = 0")).collect()
    vector_search.ROWS_PER_SHARD, vector_search.FAN = shard_rows, fan
    valid = [(i, np.floor(256 * np.array(v))) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = collections.Counter()
    for n, (q, v) in enumerate(valid):
        if q % 50 == 0:
            scores = sorted((-int(v @ w), c) for m, (c, w) in enumerate(valid) if m != n and len(v) == len(w))
            wanted.update((q, rank, c, -s) for rank, (s, c) in enumerate(scores[:5], 1))
    assert collections.Counter(map(tuple, got)) == wanted


def test_large_products_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert vector_search.products(a, a)[0, 0] == np.iinfo(np.int64).max  # 2^80 stays at the limit
    b = np.array([[2.0**20 + 1, 1.0]])
    assert vector_search.products(a, b)[0, 0] == 2**40 * (2**20 + 1) + 3


def test_decontamination(spark, make):
    items = [(1, prose(30, 50)), (2, prose(15, 51)), (3, "three short words"), (4, None), (None, "..."),
             (5, prose(30, 50).replace(" ", ", ").replace("the", "THE")), (6, prose(40, 52))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    two_changed = items[0][1].split()
    two_changed[8], two_changed[19] = "changed", "again"
    many_changed = items[6][1].split()
    many_changed[::3] = ["other"] * len(many_changed[::3])
    docs = make([(1, prose(50, 60) + " " + items[0][1] + ". " + prose(20, 61)), (2, " ".join(two_changed)),
                 (3, "Three, SHORT words!"), (4, prose(400, 62)), (5, None), (6, ""), (7, " ".join(many_changed)),
                 (None, prose(5, 63) + " " + items[1][1]), (8, prose(3000, 64) + " " + items[6][1]), (9, "three short"),
                 (1, items[1][1])])
    found = decontamination.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted(
        [(1, 1), (2, 1), (3, 3), (None, 2), (8, 6), (1, 2)], key=str)
    exact = {(r.doc_id, r.item_id): r for r in found}
    assert exact[2, 1].n_equal >= 13 and exact[2, 1].first_word == 0
    kept = decontamination.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9] and kept.columns == docs.columns
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_masks_survive_any_two_exchanges():
    places = set(range(decontamination.SPAN))
    for a in places:
        for b in places:
            assert any(a not in m and b not in m for m in decontamination.MASKS)


def test_exchanged_words_hide_no_item():
    """One and two exchanged words in items of 13 to 25 words, against all stretches one by one."""
    for n in range(13, 26):
        item, least = np.arange(1, n + 1).astype(np.uint64), min(decontamination.LEAST, n)
        for a in range(n):
            for b in range(a, n):
                doc = item.copy()
                doc[[a, b]] = 0
                equal = [x not in (a, b) for x in range(n)]
                most = max(k for i in range(n) for j in range(i + 1, n + 1)
                           if 5 * (k := sum(equal[i:j])) >= 4 * (j - i))
                doc = np.concatenate([np.full(3, 99, np.uint64), doc, np.full(2, 98, np.uint64)])
                k, first, last = decontamination.stretches(doc, item, [3, 4])
                assert k == most and (k >= least) == (most >= least)
                same = doc[first:last] == item[first - 3:last - 3]
                assert same.sum() == k and 5 * k >= 4 * (last - first) and same[0] and same[-1]


def test_one_exchanged_word_in_seventeen(spark, make):
    words = [f"w{n}" for n in range(17)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    docs = make([(n, " ".join(["before", *words[:n], "other", *words[n + 1:], "behind"])) for n in range(17)])
    found = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert sorted(found) == list(range(17)) and all(r.n_equal == 16 for r in found.values())
    assert (found[4].first_word, found[4].last_word) == (1, 18)
    assert decontamination.clean(docs, bench).count() == 0


def test_secrets(make):
    key = "AKIA" + "ABCDEFGH12345678"
    cases = [f'password = "hunter22" x {key} y', "API_KEY: abc password:token = abcdefgh", "deadbeef" * 3 + "z",
             "tOKen='a.b/c+d=e' secret=12345 passwd :  short!", "AKIA123", "paſſword=notascii", None, "", LONG,
             "é " + "0f" * 30, f"token={'ab12' * 8}", "x" * 5000 + " " + key + key]
    df = make([(n, t) for n, t in enumerate(cases)] + [(None, "secret=abcdef"), (1, "secret=abcdef")])
    got = {(r.doc_id, r.spans): r for r in secrets.scan(df).collect()}
    assert len(got) == len(cases) + 2
    for r in got.values():
        spans = [s for s in r.spans.split(",") if s and not s.startswith("learned")]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
    for n, text in [*enumerate(cases), (None, "secret=abcdef")]:
        text, found = text or "", []
        assign = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        for kind, pattern, least, group in (("assign", assign, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0),
                                            ("hex", "[0-9a-f]+", 24, 0)):
            found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}")
                      for m in re.finditer(pattern, text) if len(m[group]) >= least]
        wanted = hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
        assert any(r.base_sha256 == wanted for (doc, _), r in got.items() if doc == n), (n, text[:50])


def test_other_tokens_touch_no_span():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["AKIA", "0f" * 13, "token=", " ", "x" * 25, "Zz9" * 9, "\n"]) for _ in range(12))
        base = secrets.base_spans(text)
        wanted = [(m.start(), m.end(), m[0]) for m in secrets.TOKEN.finditer(text)
                  if not any(m.start() < e and s < m.end() for s, e, *_ in base)]
        assert secrets.other_tokens(text, base) == wanted


def test_learned_formats():
    rng = random.Random(5)
    hexes = {"".join(rng.choice("0123456789abcdef") for _ in range(40)): 1 for _ in range(200)}
    keys = {"tk_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(24)): 1 for _ in range(200)}
    automaton = secrets.infer(hexes | keys)
    assert len(automaton.counts) < 60
    fresh = "tk_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(24))
    assert secrets.ratio(automaton, fresh) > secrets.MARGIN
    for word in ("internationalization", "einlichheitenpfpfver", "the-quick-brown-fox-jumps", "queelleaiierelletion"):
        assert secrets.ratio(automaton, word) < 0


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = {"upper17": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 17, ""), "base62": (BASE62, 24, ""),
           "prefix": (BASE62, 20, "sk-"), "dotted": (BASE62, 12, "v1.")}


@pytest.mark.parametrize("name", [*FORMATS])
def test_bare_credentials_are_found_and_ordinary_tokens_left(make, name):
    """300 credentials behind a key teach a format; 200 others of it stand bare among words, numbers, hosts and paths."""
    rng = random.Random(name)
    letters, n, prefix = FORMATS[name]

    def credential():
        half = "".join(rng.choice(letters) for _ in range(n))
        return prefix + half + ("." + "".join(rng.choice(letters) for _ in range(n)) if name == "dotted" else "")

    def ordinary():
        syllable = lambda k: "".join(rng.choice(["ing", "ation", "the", "lich", "eau", "ver", "ment"]) for _ in range(k))
        return rng.choice([lambda: syllable(6), lambda: str(rng.randrange(10**16, 10**17)), lambda: f"mail{rng.randrange(99)}.example.com",
                           lambda: f"/{syllable(2)}/{syllable(2)}/{syllable(1)}.html", lambda: f"{syllable(4)}.{syllable(1).title()}",
                           lambda: f"2024-01-{rng.randrange(10, 31)}/{syllable(3)}", lambda: syllable(7).title()])()
    bare = [credential() for _ in range(200)]
    rows = [(i, f"{prose(10, i)} token={credential()} and {ordinary()}, {ordinary()}") for i in range(300)]
    rows += [(1000 + i, f"{prose(8, i)} {c}. {ordinary()} {prose(5, i + 1)} {ordinary()}") for i, c in enumerate(bare)]
    rows += [(2000 + i, f"{ordinary()} {prose(30, i)} {ordinary()}") for i in range(300)]
    texts_, hits, false = dict(rows), 0, 0
    for r in secrets.scan(make(rows)).collect():
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            if kind == "learned":
                right = texts_[r.doc_id][int(a):int(b)] in bare
                hits, false = hits + right, false + (not right)
    assert hits >= 180 and false <= 8, (hits, false)  # of 200 credentials, and of some 1,600 ordinary tokens


def jaccard_components(rows, size, percent):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return ({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size
                else {tuple(words)} if words else set())
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_near_duplicates(make):
    """Chains, groups whose members are linked only through others, and copies of everything."""
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(ODD)]
    words = prose(150, 70).split()
    for n in range(40):  # a chain: each changes two more words of the one before
        words = list(words)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((100 + n, " ".join(words)))
    base = prose(100, 71).split()
    for n in range(60):  # a family: copies of one text with up to 12 words changed
        copy = list(base)
        for _ in range(rng.randrange(13)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        rows.append((200 + n, " ".join(copy)))
    rows += [(300, rows[110][1]), (301, "one two"), (302, "ONE two"), (303, "one"), (None, BASE), (3, "same id")]
    df = make(rows)
    tile, near_dedup.TILE = near_dedup.TILE, 8
    got = near_dedup.near_duplicates(df, size=2, percent=80).collect()
    near_dedup.TILE = tile
    sets, component = jaccard_components(rows, 2, 80)
    members = collections.defaultdict(list)
    for (doc, _), c in zip(rows, component):
        members[c].append((doc is None, doc or 0))
    wanted = collections.Counter()
    for (doc, _), s, c in zip(rows, sets, component):
        none, first = min(members[c])
        wanted[doc, len(s), None if none else first] += 1
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == wanted
    assert sum(r.kept for r in got) == len(members)
    assert len(near_dedup.first_of_each(df, 2, 80).collect()) == len(members)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_stay_the_same_when_files_are_split_anew(spark, make):
    """Another plan of the scan between the decision and the last join, as after the loss of an executor."""
    copy, item = prose(60, 700), prose(30, 701)
    near = make([(n, copy if n % 3 == 1 else prose(60, 710 + n)) for n in range(24)], parts=6)
    held = make([(n, f"{prose(20, 740 + n)} {item if n % 3 == 1 else prose(30, 770 + n)}") for n in range(24)], parts=6)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = [near_dedup.first_of_each(near), decontamination.clean(held, bench)]
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        ids = [sorted(r.doc_id for r in df.collect()) for df in kept]
    finally:
        spark.conf.set(key, before)
    assert ids == [[n for n in range(24) if n % 3 != 1 or n == 1], [n for n in range(24) if n % 3 != 1]]


def test_tiles_find_what_the_first_class_misses():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    table = pa.table({"node": list(range(30)), "label": [n % 7 for n in range(30)], "shingles": sets})
    got = near_dedup.tile_links(table, table, 50)
    linked = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(set(a) & set(b))
            if i % 7 != j % 7 and 100 * common >= 50 * (len(a) + len(b) - common):
                linked.add((i, j % 7))
    assert {(a, b % 7) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist())} == linked


def test_estimates_are_near():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(15):
            x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            both = int(1000 * 2 * share / (1 + share))
            a, b = x[:1000], np.concatenate([x[:both], rng.integers(0, 2**63, 1000 - both, dtype=np.uint64)])
            pair = [near_dedup.registers(s)[None, :] for s in (a, b)]
            errors.append(near_dedup.similarity(*pair, np.array([1000]), np.array([1000]))[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def test_quality_learns_and_handles_odd_texts(spark, make, odd):
    rng = random.Random(6)
    rows = [(n, prose(80, 1000 + n) if n % 3 else " ".join(w.upper() + "!!" for w in prose(80, 1000 + n).split()))
            for n in range(240)]
    docs = make(rows)
    labels = spark.createDataFrame([(n, int(n % 3 > 0), 0) for n in range(240)] + [(None, 1, 0), (500, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    net = quality.train(docs, labels)
    got = quality.score(docs, net).select("value.doc_id", "score", quality.held_out(F.col("value.doc_id")).alias("h"))
    held = [(r.doc_id % 3 > 0, r.score) for r in got.collect() if r.h]
    assert len(held) > 20
    assert {n for n in range(240) if zlib.crc32(str(n).encode()) % 5 == 0} == {r.doc_id for r in got.collect() if r.h}
    assert sum((s >= 0.3) == good for good, s in held) / len(held) > 0.95
    scores = [r.score for r in quality.score(odd, net).collect()]
    assert len(scores) == len(ODD) + 4 and all(0 <= s <= 1 for s in scores)
    untrained = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, untrained).collect()} == {0.5}
    rng.random()


def test_gradients_follow_differences():
    net = quality.Network.new(1)
    for name in ("table", "w1", "b1", "w2", "b2"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    documents, labels = [b"abcdef" * 90, b"xyz!", b""], np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.scores(documents)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))
    grads = quality.gradients(net, documents, labels)
    for name, at in (("w2", (3,)), ("w1", (2, 3)), ("table", (2, ord("c"), 5)), ("table", (0, ord("x"), 1)), ("b2", (0,))):
        value = getattr(net, name)
        value[at] += 1e-3
        up = loss()
        value[at] -= 2e-3
        down = loss()
        value[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        symbols, segments = quality.lay_out([b"a" * n, b"b"])
        assert (symbols == ord("a")).sum() == n and (symbols == ord("b")).sum() == 1
        _, chunks = quality.chunked(np.zeros((segments[-1], quality.FILTERS), np.float32), segments)
        assert len(chunks) == 3 and chunks[1] == max(1, -(-n // quality.SEGMENT) - 1)


@pytest.mark.parametrize("bits", [27, 8])
def test_line_dedup(make, bits):
    """With 8 bits nearly every line is a suspect; the result is the same."""
    lines = [" All Rights reserved. ", "all rights reserved.\t", "short", "ünïcode línê", "ÜNÏCODE LÍNÊ", "x" * 500, "",
             "0123456789", "\x1c0123456789", "only here, once"]
    rng = random.Random(2)
    rows = [(n, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for n in range(60)]
    rows += [(70, None), (71, ""), (72, LONG), (73, LONG), (None, lines[0]), (None, "0123456789\nnew without id"),
             (3, "same document\nsame document"), (3, "same document"), (74, "\n".join(["one line many times"] * 9))]
    df = make(rows)
    got = line_dedup.dedup(df, bits=bits)

    def key(line):
        stripped = line.strip(" \t\n\v\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(float("inf") if doc is None else doc)
    wanted = collections.Counter()
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1
                                             and min(holders[key(x)]) != (float("inf") if doc is None else doc))]
        wanted[doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)] += 1
    rows = got.select("value.doc_id", "text", "n_lines", "n_dropped", F.col("value.`dotted.name`")).collect()
    assert collections.Counter(tuple(r)[:4] for r in rows) == wanted and rows[0][4] == 11


def test_empty_tables(spark, make, folder):
    empty = make([(1, "x")]).limit(0)
    assert token_files.digests(spark, token_files.write(empty, f"{folder}/none", WORD, 2)).count() == 0
    assert token_counts.count(empty, WORD).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert sharding.shuffle(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert quality.score(empty, quality.Network.new(1)).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vector_search.search(vectors, F.lit(True)).count() == 0


def test_masks_reach_the_rule():
    """Every choice of exchanged words that the rule allows leaves a mask whole somewhere, in items of any size; longer
    stretches hold one of these sizes, since one half of a stretch has at least as few exchanged words for its length."""
    for n, exchanged in [(k, decontamination.unequal(k)) for k in range(1, 17)] + [(20, 4), (25, 5)]:
        masks = decontamination.masks_of(min(n, decontamination.SPAN))
        seen = [sum(1 << (p + at) for p in m) for m in masks for at in range(n - m[-1])]
        lost = [c for c in itertools.combinations(range(n), exchanged)
                if all(s & sum(1 << x for x in c) for s in seen)]
        assert not lost, (n, lost[:3])


@pytest.mark.parametrize("n", [5, 8, 11, 13, 15, 16, 20, 27])
def test_exchanged_words_are_found_end_to_end(spark, make, n):
    """Seeds, join and verification together: as many words exchanged as the rule allows, at random places and close
    together, are found; one more in a short item is not."""
    rng = random.Random(n)
    item = [f"w{k}" for k in range(n)]
    allowed = decontamination.unequal(n)
    docs, right = [], set()
    for k in range(60):
        many = allowed if k % 3 else allowed + 1
        first = rng.randrange(n - many + 1)
        places = rng.sample(range(n), many) if k % 2 else range(first, first + many)
        doc = [f"x{rng.randrange(999)}" if p in places else w for p, w in enumerate(item)]
        equal = [w == v for w, v in zip(doc, item)]
        most = max((sum(equal[i:j]) for i in range(n) for j in range(i + 1, n + 1) if 5 * sum(equal[i:j]) >= 4 * (j - i)), default=0)
        if most >= min(decontamination.LEAST, n - allowed):
            right.add(k)
        docs.append((k, f"{prose(30, k)} {' '.join(doc)}, {prose(9, k + 1)}"))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert len(right) >= 40 and {r.doc_id for r in decontamination.contaminated(make(docs), bench).collect()} == right
