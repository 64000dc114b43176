"""Near-duplicate documents by SetSketch registers.

A register keeps the smallest of a set's exponential hashes on a logarithmic scale, cut to 16 bits, so that sketches
merge by the maximum and two sets agree in a register about as often as their Jaccard similarity.

1. Every text gets its number of shingles, a hash of the whole set, and its registers. Equal sets become one class.
2. Bands of registers deal classes into buckets. Each member of a bucket is paired with the bucket's first class only.
3. Pairs whose similarity, estimated by maximum likelihood from all registers and both sizes, may reach the limit
   are confirmed on full sets; components of the confirmed links follow.
4. Buckets that still hold several components, the first class aside, are worked through exactly: members outside the
   largest component meet all members in tiles, as products of 0/1 matrices over full sets. So each two members of a
   bucket are either connected already or have been compared, whatever the bucket's size.

Null and empty texts have no shingles and are linked with nothing. Rows are told apart by their place in the input;
equal ids are no matter, and null ids come behind all others when a component's first document is chosen. Other
columns are not looked at. Very long texts are taken apart in whole, a block of shingles at a time. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches, words
from millrace.llm.components import components
from millrace.llm.content import HASHES, KEY, only, text_hashes, without
from millrace.session import written

#: Registers of a band, and bands: two sets of similarity 0.8 share no band with a probability below 1e-6.
ROWS, BANDS = 6, 46
REGISTERS = ROWS * BANDS
#: The scale of the registers: base, rate and limit.
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: An estimate may fall this many standard deviations below the limit before a pair is given up.
DEVIATIONS = 5.0
#: Pieces that a bucket's members are dealt into.
SALTS = 32
#: Members of one side of a tile.
TILE = 256
#: Bytes of text that are taken apart at once.
TEXT_BYTES = 2 << 20
#: Shingles whose hashes are worked out at once, and columns of a tile's matrices.
BLOCK, COLUMNS = 1024, 4096

_random = np.random.default_rng(20240611)
_XOR = _random.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_TIMES = (_random.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), BLOCK):
        y = x[None, a:a + BLOCK] ^ _XOR
        y *= _TIMES
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        np.minimum(least, y.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sketches (pairs x registers) of sets of known sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return (above * np.log(up + tiny) + below * np.log(down + tiny)
                + equal * np.log(np.maximum(1 - up - down, tiny)))

    low, high = np.zeros(len(u)), most.copy()
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(x) < likelihood(y)
        low, high = np.where(rising, x, low), np.where(rising, high, y)
    return (low + high) / 2


def sketches(docs: DataFrame, size: int, row: Column) -> DataFrame:
    """(doc_id, row, text_hash, text_hash_2, n_shingles, set_hash, registers) of every row; the last two are null where
    there is no set."""
    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = words.shingle_sets(batches.texts(batch), size)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "row", *HASHES)),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
             pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["doc_id", "row", *HASHES, "n_shingles", "set_hash", "registers"])

    return batches.map_batches(
        docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text", row.alias("row"),
                    *(h.alias(name) for name, h in zip(HASHES, text_hashes(F.col("text"))))), sketch,
        "doc_id bigint, row bigint, text_hash bigint, text_hash_2 bigint, n_shingles bigint, set_hash binary, "
        "registers binary", TEXT_BYTES)


def banded(classes: DataFrame) -> DataFrame:
    """(key, node): a row for every band of a class."""
    def bands(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(n, BANDS, ROWS)
        keys = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            keys = words.mixed(keys + values[:, :, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))],
            ["key", "node"])

    return batches.map_batches(classes.select("node", "registers"), bands, "key bigint, node bigint")


def likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose estimate may reach the limit."""
    limit = percent / 100
    least = limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / REGISTERS)
    for end in "ab":
        pairs = pairs.join(sketched.select(F.col("row").alias(end), F.col("n_shingles").alias(f"n_{end}"),
                                           F.col("registers").alias(f"r_{end}")), end)
    pairs = pairs.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def estimate(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("r_a", "r_b"))
        good = similarity(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
        return batch.select(["a", "b"]).filter(pa.array(good))

    return batches.map_batches(pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b"), estimate, "a bigint, b bigint")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for ``nodes`` (node, doc_id, text_hash, set_hash): their texts are read again and taken apart.

    Texts are found by id and hash, so that any number of rows without an id is no matter.
    """
    wanted = nodes.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "set_hash")
    read = (docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
            .join(wanted, (F.xxhash64("text") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
            .select("node", "set_hash", "text"))

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = words.shingle_sets(batches.texts(batch), size)
        # Another text under the same id is another set.
        mine = np.array([len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == h
                         for s, h in zip(sets, batch.column("set_hash").to_pylist())], bool)
        sets = [s for s, m in zip(sets, mine) if m]
        offsets = batches.offsets_of(np.array([len(s) for s in sets], np.int64))
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(mine)), batches.int_lists(flat, offsets)],
                                          ["node", "shingles"])

    return batches.map_batches(read, again, "node bigint, shingles array<bigint>", TEXT_BYTES).dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the limit on full sets."""
    for end in "ba":
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s_{end}")), end)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for a, b in zip(batch.column("s_a"), batch.column("s_b")):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * common >= percent * (len(a) + len(b) - common))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return batches.map_batches(pairs.select("a", "b", "s_a", "s_b"), compare, "a bigint, b bigint")


def tile_links(outside: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links between different components of a tile, one for each member outside and component."""
    left, right = (t.combine_chunks() for t in (outside, members))
    sets = [[s.values.to_numpy() for s in t["shingles"]] for t in (left, right)]
    common = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    if common.size:
        # Only shingles on both sides can be common.
        shared = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
        for a in range(0, len(shared), COLUMNS):
            part = shared[a:a + COLUMNS]
            ones = []
            for side in sets:
                m = np.zeros((len(side), len(part)), np.float32)
                for i, s in enumerate(side):
                    own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                    at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                    m[i, at[part[at] == own]] = 1
                ones.append(m)
            common += ones[0] @ ones[1].T
    sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
    whole = common.astype(np.int64)
    linked = 100 * whole >= percent * (sizes[0][:, None] + sizes[1][None, :] - whole)
    labels = [t["label"].to_numpy() for t in (left, right)]
    i, j = np.nonzero(linked & (labels[0][:, None] != labels[1][None, :]))
    one = np.unique(np.stack([i, labels[1][j]], axis=1), axis=0, return_index=True)[1] if len(i) else i
    return pa.table({"a": pa.array(left["node"].to_numpy()[i[one]], pa.int64()),
                     "b": pa.array(right["node"].to_numpy()[j[one]], pa.int64())})


def remaining_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, beyond the pairs with the bucket's first class.

    ``members`` is (key, node, center) of buckets of three classes or more.
    """
    own = (members.filter("node <> center").select("key", "node").join(labels, "node", "left")
           .withColumn("label", F.coalesce("label", "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))))
    by_label = own.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = (by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"),
                                         F.sum("n").alias("n"), F.max("n").alias("largest"))
             .filter("largest < n").select("key", "main", F.ceil(F.col("n") / TILE).alias("blocks"),
                                           F.ceil((F.col("n") - F.col("largest")) / TILE).alias("outer")))
    # A bucket of any size is dealt out before it meets what is known of it.
    salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    open_ = written(own.join(salted, ["key", "salt"]).drop("salt"), "open")
    deal = F.xxhash64("node")
    outside = (open_.filter("label <> main")
               .select("key", "node", "label", F.pmod(deal, "outer").alias("o"),
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("m"))
               .join(sets, "node"))
    inside = open_.select("key", "node", "label", F.pmod(deal, "blocks").alias("m"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outer") - 1)).alias("o")).join(sets, "node")

    def tile(table: pa.Table) -> pa.Table:
        return tile_links(table.filter(table["outer"]), table.filter(pc.invert(table["outer"])), percent)

    return (outside.withColumn("outer", F.lit(True)).unionByName(inside.withColumn("outer", F.lit(False)))
            .groupBy("key", "o", "m").applyInArrow(tile, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, row: Column | None = None) -> DataFrame:
    """(doc_id, row, text_hash, text_hash_2, n_shingles, component_id, kept): the component of every row and whether it is
    its first.

    The sketches are written once; rows are told apart by ``row`` in that table, a number of ``docs`` or else their place
    in the scan.
    """
    sketched = written(sketches(docs, size, F.monotonically_increasing_id() if row is None else row), "sketches")
    class_of = written(sketched.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("row").alias("node")), "classes")
    reps = sketched.join(class_of.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node")
    bands = banded(reps)
    shared = (bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"),
                                       F.count("*").alias("n"))
              .filter("center < last").select("key", "center", "n"))
    members = written(bands.join(shared, "key"), "members")
    pairs = members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(likely(pairs, sketched, percent), "likely")
    large = members.filter("n > 2").select("key", "node", "center")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    nodes = needed.join(sketched.select(F.col("row").alias("node"), "doc_id", "text_hash", "set_hash"), "node")
    sets = written(full_sets(docs, nodes, size), "sets")
    links = written(confirmed(pairs, sets, percent), "confirmed")
    labels = components(links)
    more = written(remaining_links(large, labels, sets, percent), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    names = ["doc_id", "row", *HASHES, "n_shingles"]
    slim = sketched.select(*names, "set_hash")
    rows = (slim.filter("n_shingles > 0").join(class_of, "set_hash").join(labels, "node", "left")
            .select(*names, F.coalesce("label", "node").alias("label"))
            # A row without a set is alone; its place can't be that of a class.
            .unionByName(slim.filter("n_shingles = 0").select(*names, F.col("row").alias("label"))))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = rows.groupBy("label").agg(F.min(order).alias("first"))
    return rows.join(firsts, "label").select(
        *names, F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component.

    Rows are told by id and text, which stay the same in every scan, so they need no numbers and no copy. Of rows with
    the same id and text, which are always of one component, any one stays if it is the first.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("value"))
    marks = written(near_duplicates(docs, size, percent).groupBy(*KEY).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "marks")
    out = without(rows, marks.select(*KEY))
    repeated = marks.filter("kept").select(*KEY)
    if repeated.isEmpty():
        return out.select("value.*")
    once = only(rows, repeated).withColumns(dict(zip(KEY, (F.col("value.doc_id").cast("bigint"),
                                                           *text_hashes(F.col("value.text")))))).dropDuplicates([*KEY])
    return out.unionByName(once.select("value")).select("value.*")
