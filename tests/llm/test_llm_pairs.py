"""Hard negatives, fingerprints and token alignment against brute force, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from millrace.llm import cross_tokens, hard_negatives, order_minhash, pretokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ["1 AS row", "'v' AS value", "2 AS tile", "3 AS block", "4 AS score", "5 AS rank", "6 AS part", "7 AS hash",
            "8 AS chunk", "9 AS pair", "10 AS probes", "11 AS vector", "12 AS `dotted.name`", "13 AS place"]
BITS = ["a", "The", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "é", "İ", "Σ", "'s", "!", "...", "<|endoftext|>", "<s>",
        "<unk>", "　", "\xa0", "\x85", "\x1c", "日本", "😀", "12", " word", " the", " of", "\x00", "ﬁ", "̀", "K", "▁", "<0x0A>"]


def odd_texts(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


LONG = " ".join(odd_texts(3000, 5))
DOCS = [*enumerate(odd_texts(150, 1)), (150, None), (151, ""), (152, LONG), (153, LONG), (154, "plain words, twice"),
        (155, "plain words, twice"), (156, "abc"), (157, "ab"), (157, "ab"), (157, "other"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pairs") / "docs")
    (spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(5).selectExpr("*", *CLASHING).write.parquet(path))
    return spark.read.parquet(path)


# Hard negatives

def vector_rows(n, width, seed, copies=True):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, width))
    rows = [(i, [float(x) for x in centers[i % 4] + rng.normal(size=width) * 0.7], int(rng.integers(0, 4))) for i in range(n)]
    if copies:
        rows += [(n + i, rows[2][1], i % 3) for i in range(20)]  # equal vectors: ties everywhere
    return rows


def mined(rows, anchor, positives, negatives, low, high):
    """Brute force; rows are told apart by their place."""
    usable = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in usable]
    out = collections.Counter()
    for n, (i, v, label) in enumerate(whole):
        if not anchor(i):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, m, other) for m, (j, w, other) in enumerate(whole)
                        if m != n and len(w) == len(v))
        for p, j, _, _ in [s for s in scores if s[3] == label][:positives]:
            fit = [(s, m) for s, m, _, other in scores if other != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out.update((i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(fit, 1))
    return out


ODD_VECTORS = [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0), (None, [1.0] * 8, 1),
               (504, [1.0] * 8, None), (505, [], 1), (510, [], 1), (506, [0.5] * 3, 2), (520, [0.4] * 3, 2), (530, [0.1] * 3, 0),
               (0, [0.25] * 8, 1), (540, [1e300] * 8, 1), (541, [-0.0] * 8, 2)]


@pytest.mark.parametrize("width", [1, 8, 13])
def test_hard_negatives(spark, monkeypatch, width):
    for name, value in (("ANCHORS_PER_BLOCK", 3), ("ROWS_PER_SHARD", 40), ("SLICE", 16), ("FIRST_SLICE", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows(150, width, width) + [r for r in ODD_VECTORS if r[0] != 540]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", *CLASHING)
    got = hard_negatives.mine(table, (table["vec_id"] % 10) == 0).collect()
    wanted = mined(rows, lambda i: i % 10 == 0, 5, 3, 50, 95)
    assert len(wanted) > 20
    assert collections.Counter(map(tuple, got)) == wanted
    assert hard_negatives.mine(table.limit(0), table["vec_id"] == 0).count() == 0


def test_scores_beyond_doubles_stay_whole():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert hard_negatives.whole_products(a, a).tolist() == [[2**63 - 1, 2**40 + 3], [2**40 + 3, 2]]


@pytest.mark.parametrize("width", [4, 16, 37, 64])
def test_bounds_hold_at_every_halving(width):
    rng = np.random.default_rng(width)
    x = np.floor(256 * rng.normal(size=(60, width)) + rng.normal(size=(60, 1)) * 99)
    means, deviations = hard_negatives.summaries(x)
    n = np.arange(60)
    side = hard_negatives.Side(n, n, n, x, means, deviations, n)
    exact, widths = x @ x.T, []
    for halvings in range(hard_negatives.halvings_of(width) + 1):
        m, d = side.level(halvings)
        assert (np.abs(exact - m @ m.T) <= d @ d.T + 1e-6 * np.abs(exact).max()).all()
        widths.append((d @ d.T).mean())
    assert all(later <= before + 1e-6 for before, later in zip(widths, widths[1:]))


def test_bounds_rule_pairs_out():
    """Most pairs of well-parted clusters are never scored exactly."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 64)) * 3
    x = np.floor(256 * (np.repeat(centers, 64, axis=0) + rng.normal(size=(512, 64)) * 0.2))
    n = np.arange(512)
    side = hard_negatives.Side(n, n, n, x, *hard_negatives.summaries(x), n)
    alive = n[:, None] != n[None, :]
    scores = np.where(alive, x @ x.T, -np.inf)
    floor = np.sort(scores, axis=1)[:, -5]
    i, j, found = hard_negatives.scored(side, side, alive, floor, np.full(512, hard_negatives.HIGHEST))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(scores >= floor[:, None]))))
    assert alive.sum() < 512 * 64


# Fingerprints

def brute_fingerprint(text):
    """Every function looks at every numbered k-mer."""
    o = order_minhash
    if not text:
        return np.zeros(o.ENTRIES, np.uint16)
    kmers, seen, items = o.kmers(text), collections.Counter(), []
    for place, k in enumerate(kmers.tolist()):
        items.append((int(o.mixed(np.array([(k + seen[k] * int(o._OCCURRENCE)) % 2**64], np.uint64))[0]), place, k))
        seen[k] += 1
    out = []
    for f in o._FUNCTIONS.tolist():
        best = sorted(sorted(items, key=lambda x: x[0] ^ f)[:o.TUPLE], key=lambda x: x[1])
        entry = 0
        for i in range(o.TUPLE):
            value = best[i][2] if i < len(best) else 0
            entry = int(o.mixed(np.array([(entry * int(o._ORDER) + value + i + 1) % 2**64], np.uint64))[0])
        out.append(entry % (2**16 - 1) + 1)
    return np.array(out, np.uint16)


def test_fingerprints_are_those_of_brute_force():
    for text in [*odd_texts(30, 8), "ab", "x" * 500, LONG[:4000], LONG[:9000]]:
        assert order_minhash.fingerprint(text).tolist() == brute_fingerprint(text).tolist(), text[:40]


def test_fingerprints_follow_edits_and_order():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    text = " ".join(words)
    own = order_minhash.fingerprint(text)
    shares = []
    for edits in (0, 5, 20, 80, 300):
        changed = list(text)
        for _ in range(edits):
            changed[rng.randrange(len(changed))] = rng.choice("klmnop")
        shares.append(order_minhash.likeness(own, order_minhash.fingerprint("".join(changed))))
    assert shares[0] == 1 and all(a > b for a, b in zip(shares, shares[1:]))
    # Nearly the same k-mers in the opposite order: sets agree, fingerprints do not.
    backwards = " ".join(reversed(words))
    a, b = (set(order_minhash.kmers(t).tolist()) for t in (text, backwards))
    assert order_minhash.likeness(own, order_minhash.fingerprint(backwards)) < 0.7 * len(a & b) / len(a | b)


def neighbours(rows):
    """(doc_id, text, next text) as the operator orders rows; equal ids in any order, so they are given apart."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1])]


def expected(doc_id, text, following):
    o = order_minhash
    changed = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
    own, new, other = (o.fingerprint(t) for t in (text, changed, following))
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(),
            float((own == new).mean()), float((own == other).mean()))


def test_next_documents(spark, docs):
    single = [(i, t or "") for i, t in DOCS if i is not None and i < 157]
    got = order_minhash.with_next(docs.filter("doc_id < 157")).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*n) for n in neighbours(single))
    # Repeated and missing ids: a row for every row, each text with its own fingerprint, each beside a row of its kind.
    rows = order_minhash.with_next(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in rows) == collections.Counter(
        (i, order_minhash.fingerprint(t or "").tobytes().hex()) for i, t in DOCS)
    assert order_minhash.with_next(docs.limit(0)).count() == 0
    one = order_minhash.with_next(spark.createDataFrame([(4, "alone here")], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in one] == [expected(4, "alone here", "alone here")]
    assert {(r.doc_id, bytes(r.fingerprint).hex()) for r in order_minhash.fingerprints(docs).collect()} == {
        (r.doc_id, r.fingerprint) for r in rows}


# Alignment

def links_of(ids_a, ids_b, bytes_a, bytes_b):
    """All overlapping pairs of tokens, and the groups between common ends."""
    ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in ids_a]), np.cumsum([len(bytes_b[i]) for i in ids_b])
    starts_a, starts_b = ends_a - [len(bytes_a[i]) for i in ids_a], ends_b - [len(bytes_b[i]) for i in ids_b]
    links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b))
             if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
    groups, a, b = [], [], []
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for low, high in zip([0, *common[:-1]], common):
        a = [str(t) for t, e in zip(ids_a, ends_a) if low < e <= high]
        b = [str(t) for t, e in zip(ids_b, ends_b) if low < e <= high]
        groups.append(",".join(a) + "|" + ",".join(b))
    return links, groups


def aligned(rows):
    """Brute force by the libraries alone."""
    library, pieces = pretokens.load(BYTE, True), cross_tokens.PieceWords(PIECE).library
    bytes_a, bytes_b = pretokens.entries(BYTE), cross_tokens.PieceWords(PIECE).entries
    found, holders = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        ids_a = library.encode(" " + text, add_special_tokens=False).ids
        ids_b = pieces.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
            ids_a, ids_b = [], []
        links, groups = links_of(ids_a, ids_b, bytes_a, bytes_b)
        holders.update(set(links))
        found.append((doc_id, len(ids_a), len(ids_b), links, groups))
    highest = collections.Counter()
    for (a, _), n in holders.items():
        highest[a] = max(highest[a], n)
    out = [(doc_id, n_a, n_b, len(groups), len(links), sum(holders[x] == highest[x[0]] for x in links),
            sum(holders[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
           for doc_id, n_a, n_b, links, groups in found]
    return collections.Counter(out), holders, highest


def test_alignment(docs, monkeypatch):
    rows = [(i, t if t is not LONG else LONG[:3000]) for i, t in DOCS]
    monkeypatch.setattr(cross_tokens, "TEXT_BYTES", 300)
    short = docs.withColumn("text", docs["text"].substr(1, 3000))
    result, pairs = cross_tokens.align(short, BYTE, PIECE, chunk_bytes=900)
    wanted, holders, highest = aligned(rows)
    assert collections.Counter(map(tuple, result.collect())) == wanted
    assert {(r.a_id, r.b_id): (r["count"], r.is_best) for r in pairs.collect()} == {
        p: (n, n == highest[p[0]]) for p, n in holders.items()}
    empty, none = cross_tokens.align(docs.limit(0), BYTE, PIECE)
    assert empty.count() == 0 and none.count() == 0


def test_merge_paths():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (np.unique([rng.randint(1, 300) for _ in range(rng.randint(1, 150))] + [300]) for _ in range(2))
        left, right, both = cross_tokens.merged(a, b, rng.randint(1, 9))
        before = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if before[0][i] < b[j] and before[1][j] < a[i]]
        assert list(zip(left.tolist(), right.tolist())) == pairs
        assert both.tolist() == [bool(a[i] == b[j]) for i, j in pairs]


def test_pieces_have_equal_work():
    rng = np.random.default_rng(3)
    a, b = (np.cumsum(rng.integers(1, 9, n)) for n in (5000, 700))
    diagonals = np.arange(0, 5701, 100)
    from_a = cross_tokens.crossings(a, b, diagonals)
    merged = np.argsort(np.concatenate([a, b]), kind="stable")  # a first among equals
    assert from_a.tolist() == [int((merged[:d] < len(a)).sum()) for d in diagonals]


def test_words_give_the_librarys_ids_with_plain_specials():
    texts = odd_texts(3000, 11)
    words, library = pretokens.SpacedWords(BYTE, plain=True, spaced=True), pretokens.load(BYTE, True)
    ids, offsets = words(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [
        e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    texts = [t for t in texts if "▁" not in t]  # their bytes differ in any case
    pieces = cross_tokens.PieceWords(PIECE)
    ids, offsets = pieces(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == pieces.library.encode(texts)


@pytest.mark.parametrize("seed", range(3))
def test_words_give_the_librarys_ids_on_random_texts(seed):
    texts = odd_texts(4000, 20 + seed)
    for words, path in ((pretokens.LowerWords(public_tokenizers.path("word_bpe_49k.json")), "word_bpe_49k.json"),
                        (pretokens.SpacedWords(BYTE), "byte_bpe_50k.json")):
        ids, offsets = words(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [
            e.ids for e in pretokens.load(public_tokenizers.path(path)).encode_batch(texts, add_special_tokens=False)]
