"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed word shingles; equal sets are one class from then on, so copies are never paired. MinHash
bands of the classes give a candidate graph (bands' members point at the least member, never at each other); its connected
components are processed as cells of bounded size: a large component is dealt into chunks, and each pair of chunks is a
cell. In a cell, MinHash values are compared a few at a time; a pair is dropped once the posterior probability that its
similarity reaches the threshold, given the matches so far and a uniform prior, falls below a tolerance. All other pairs
are verified exactly on their sets. Cells return counts of links and spanning edges, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, drop_since, mark, pieces, release, small, text_batches, text_key, trimmed, words_of
from .graph import components

#: Words of a shingle and least Jaccard similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values, and how many of them make a band: at a similarity of 0.8, a pair shares no band with probability 5e-8.
VALUES, BAND = 128, 4
#: MinHash values compared at a time; a pair is dropped if it is a link with less than this probability.
STEP, TOLERANCE = 16, 1e-9
#: Classes in a chunk of a component at least, and bytes of sets at most (about).
CHUNK, CHUNK_BYTES = 128, 8 << 20
#: Names of the columns of ids and texts' keys in the table of rejected rows.
ID, KEY = "__tidemark_id", "__tidemark_key"
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000


class WordHashes(dict):
    """Remembers the hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words, but not none, is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    s = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 1 << 32, VALUES, np.uint32)[:, None], rng.integers(0, 1 << 32, VALUES, np.uint32)[:, None] | np.uint32(1)


def minhash(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low = (items >> np.uint64(17)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(best, ((low[None, at : at + 2048] ^ family[0]) * family[1]).min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    v = signature.reshape(-1, BAND).astype(np.uint64)
    key = np.arange(len(v), dtype=np.uint64) + np.uint64(1)
    for k in range(BAND):
        key = (key ^ v[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _headers(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, family = WordHashes(), _hash_family()
        for whole in batches:
            for batch in pieces(whole):
                digests, counts, bands = [], [], []
                for text in batch.column("text").to_pylist():
                    items = shingles(words_of(text), hashes, size)
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    counts.append(len(items))
                    bands.append(band_keys(minhash(items, family)) if len(items) else None)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "digest": pa.array(digests, pa.binary()), "n": pa.array(counts, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets and signatures of the members of candidate components; texts that share a member's id, but not its set, drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, family = WordHashes(), _hash_family()
        for whole in batches:
            for batch in pieces(whole):
                keep, digests, sets, signatures = [], [], [], []
                for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist())):
                    items = shingles(words_of(text), hashes, size)
                    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                    if len(items) and (wanted is None or wanted == digest):
                        keep.append(i)
                        digests.append(digest)
                        sets.append(items.tobytes())
                        signatures.append(minhash(items, family).tobytes())
                at = pa.array(keep, pa.int64())
                names = ["node", "copies", "root", "chunk", "chunks"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in names), pa.array(digests, pa.binary()), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())],
                    [*names, "digest", "items", "signature"],
                )

    return run


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For STEP, 2 STEP, ... VALUES compared values: the fewest matches at which a pair stays. With a uniform prior, the
    posterior probability of a similarity of at least t after m of n matches is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose sizes allow the threshold and that no comparison of MinHash values dropped."""
    x, y = np.nonzero(np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]) - 1e-9)
    same = np.zeros(len(x), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (a[x, part] == b[y, part]).sum(axis=1)
        ok = same >= need
        x, y, same = x[ok], y[ok], same[ok]
    return x, y


def overlaps(left: list[np.ndarray], right: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices over blocks of the items that both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    row_l, row_r = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(flat_l, flat_r)
    ends = []
    for flat, row in ((flat_l, row_l), (flat_r, row_r)):
        at = np.searchsorted(common, flat)
        ok = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        ends.append((at[ok][order], row[ok][order]))
    for low in range(0, len(common), block):
        high, sides = min(low + block, len(common)), []
        for (at, row), n in zip(ends, (len(left), len(right))):
            span = slice(*np.searchsorted(at, [low, high]))
            m = np.zeros((n, high - low), np.float32)
            m[row[span], at[span] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


CELL = T.StructType([T.StructField("node", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("links", T.LongType()),
                     T.StructField("class_links", T.LongType()), T.StructField("to", T.LongType())])


def _cell(threshold: float, tolerance: float) -> Callable[[pa.Table], pa.Table]:
    least = least_matches(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        small_columns = {c: table.column(c).to_pylist() for c in ("root", "i", "j", "chunk", "node", "copies", "digest")}
        root, first, second, chunk, node, copies, digest = small_columns.values()
        # Sets and signatures stay in Arrow's memory; arrays look into it.
        bytes_of = lambda c, k: np.frombuffer(table.column(c)[k].as_buffer(), np.uint64 if c == "items" else np.uint32)

        def pairs(left: list[int], right: list[int], same: bool) -> Iterator[tuple[int, int]]:
            sets_l, sets_r = [bytes_of("items", k) for k in left], [bytes_of("items", k) for k in right]
            n_l, n_r = np.array([len(x) for x in sets_l]), np.array([len(x) for x in sets_r])
            x, y = survivors(np.stack([bytes_of("signature", k) for k in left]), np.stack([bytes_of("signature", k) for k in right]), n_l, n_r, threshold, least)
            if same:
                x, y = x[x < y], y[x < y]
            if not len(x):
                return
            ux, uy = np.unique(x), np.unique(y)
            both = overlaps([sets_l[k] for k in ux], [sets_r[k] for k in uy])[np.searchsorted(ux, x), np.searchsorted(uy, y)].astype(np.float64)
            ok = both * (1 + threshold) >= threshold * (n_l[x] + n_r[y]) - 1e-6
            yield from zip([left[k] for k in x[ok]], [right[k] for k in y[ok]])

        cells: dict[tuple, dict[bytes, int]] = {}
        for k, cell in enumerate(zip(root, first, second)):  # rows that repeat count once
            cells.setdefault(cell, {}).setdefault(digest[k], k)
        found = []
        for (_, i, j), members in cells.items():
            own = [k for k in members.values() if chunk[k] == i]
            other = own if i == j else [k for k in members.values() if chunk[k] == j]
            if not own or not other:
                continue
            links: dict[int, int] = {}
            classes: dict[int, int] = {}
            head: dict[int, int] = {}

            def top(k: int) -> int:
                while head.get(k, k) != k:
                    head[k] = k = head.get(head[k], head[k])
                return k

            for a, b in pairs(own, other, i == j):
                for p, q in ((a, b), (b, a)):
                    links[p] = links.get(p, 0) + copies[q]
                    classes[p] = classes.get(p, 0) + 1
                p, q = top(a), top(b)
                if p != q:
                    p, q = (p, q) if node[p] <= node[q] else (q, p)
                    head[q] = p
            found += [(node[k], digest[k], links[k], classes[k], node[top(k)]) for k in links]
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        release()
        return pa.table({f.name: pa.array(list(c), k) for f, c, k in zip(CELL.fields, columns, kinds)})

    return run


def _linked(documents: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """heads: doc_id, key (of the text), digest (of the shingle set, null without words) of each row. facts: for each digest,
    rep and rep_key (of its first row, by id, null last, and key), copies, n_links, n_class_links, group (a component's
    number) and first (whether it is its group's first class, by rep)."""
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    kind = T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    heads = cut(docs.mapInArrow(trimmed(_headers(shingle)), kind))
    point = mark()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = heads.where("digest is not null").groupBy("digest", "n", "bands").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    # Classes get their numbers when they are written, so the numbers stay.
    classes = cut(classes.select("digest", "n", "bands", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("rep_key"), "copies", F.monotonically_increasing_id().alias("node")))
    n_classes = classes.count()
    n_keys = n_classes * VALUES // BAND
    keys = classes.select("node", F.explode("bands").alias("band"))
    leaders = cut(keys.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c"), n_keys // 2)
    parts = components(keys.join(leaders, "band").select(F.col("node").alias("u"), "v"), n_keys)
    members = cut(classes.join(parts, "node").select("digest", "n", "rep", "copies", "node", "root"), n_classes)
    n_members = members.count()
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("items"))
    chunks = F.greatest(F.ceil(F.col("size") / F.greatest(F.lit(float(CHUNK)), 2.5 * F.sqrt("size"))), F.ceil(F.col("items") * 8 / CHUNK_BYTES)).cast("long")
    sizes = cut(sizes.select("root", chunks.alias("chunks")), n_members)
    members = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("digest"), "chunks"))
    columns = ["node", "copies", "root", "chunk", "chunks"]
    named = docs.join(small(members.where("rep is not null").withColumnRenamed("rep", "doc_id"), n_members, BROADCAST_ROWS // 4), "doc_id").select("text", "digest", *columns)
    kinds = T.StructType([*(T.StructField(c, T.LongType()) for c in columns), *(T.StructField(c, T.BinaryType()) for c in ("digest", "items", "signature"))])
    sets = named.mapInArrow(trimmed(_sets(shingle)), kinds)
    if not members.where("rep is null").isEmpty():
        empty = docs.where("doc_id is null").select("text", F.lit(None).cast("binary").alias("digest"), *(F.lit(0).cast("long").alias(c) for c in columns))
        unnamed = empty.mapInArrow(trimmed(_sets(shingle)), kinds).select("digest", "items", "signature")
        sets = sets.unionByName(unnamed.join(members.where("rep is null").select("digest", *columns), "digest"))
    buckets = max(1, n_members // CHUNK)
    dealt = (
        sets.withColumn("k", F.explode(F.expr("sequence(0L, chunks - 1)")))
        .withColumn("i", F.least("chunk", "k")).withColumn("j", F.greatest("chunk", "k"))
        .withColumn("cell", F.when(F.col("chunks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets))))
    )
    found = cut(dealt.groupBy("cell").applyInArrow(_cell(threshold, tolerance), CELL))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    roots = cut(components(found.select(F.col("node").alias("u"), F.col("to").alias("v")), n_members), n_members)
    grouped = classes.select("rep", "node").join(roots, "node")
    lead = grouped.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least")).select(F.col("root").alias("group"), F.col("least.rep").alias("class_id"), F.col("least.node").alias("head"))
    facts = classes.select("digest", "rep", "rep_key", "copies", "node").join(links, "digest", "left").join(roots, "node", "left")
    facts = facts.join(lead, F.col("root") == F.col("group"), "left").select(
        "digest", "rep", "rep_key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_links", F.lit(0)).alias("n_class_links"),
        F.when(F.col("group").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.col("group").isNull() | (F.col("node") == F.col("head"))).alias("first"),
    )
    facts = cut(facts, n_classes)
    drop_since(spark, point)
    return heads, facts


def near_join(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, copy_id (least doc_id with the same shingle set), n_copies, n_links (other documents
    at or above the threshold, copies included), n_class_links (other classes of copies linked to its own) and class_id
    (least doc_id of its connected component).

    Words are lower-cased (A-Z only) runs of digits, ASCII letters and non-ASCII characters. A text of fewer than `shingle`
    words, but not none, is one shingle; a null, empty or wordless text links to nothing and is its own class. Every row is a
    document of its own, also where rows share an id or have none; a class of rows without ids alone has a null class_id.
    Further columns are not read, so they may have any name. Very long texts are compared whole; an empty table gives no
    rows. Shingles are compared by 64-bit hashes. No cap is set on partners or candidates.
    """
    heads, facts = _linked(documents, id_col, text_col, shingle, threshold, tolerance)
    out = heads.where("digest is not null").select("doc_id", "digest").join(facts, "digest")
    alone, zero = heads.where("digest is null").select("doc_id"), F.lit(0).cast("long")
    return out.select("doc_id", F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"), "n_links", "n_class_links", "class_id").unionByName(
        alone.select("doc_id", F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_links"), zero.alias("n_class_links"), F.col("doc_id").alias("class_id"))
    )


def keep_one(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One document of each class, all columns: the one with the least id, null ids last. Rows are judged by id and text, so
    rows that share an id or have none are documents like all others; of rows equal in both, one stays. Null, empty and
    wordless texts are near to nothing and stay; very long texts are compared whole; an empty table stays empty. Columns may
    have any name."""
    spark = documents.sparkSession
    point = mark()
    heads, facts = _linked(documents, id_col, text_col, shingle, threshold, tolerance)
    held = facts.where("copies > 1 or not first").select("digest", "first", "rep", "rep_key")
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep")) & F.col("key").eqNullSafe(F.col("rep_key"))
    rows = heads.select("doc_id", "key", "digest").join(held, "digest").select(F.col("doc_id").alias(ID), F.col("key").alias(KEY), stays.alias("__stays"))
    judged = cut(rows.groupBy(ID, KEY, "__stays").agg(F.count("*").alias("__n")))
    drop_since(spark, point)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(ID)) & text_key(text_col).eqNullSafe(F.col(KEY))
    gone, twice = judged.where("not __stays").select(ID, KEY), judged.where("__stays and __n > 1").select(ID, KEY)
    kept = documents.join(small(gone, gone.count(), BROADCAST_ROWS // 2), same, "left_anti")
    n_twice = twice.count()
    if not n_twice:
        return kept
    side = small(twice, n_twice, BROADCAST_ROWS // 2)
    one = kept.join(side, same, "left_semi").withColumns({ID: F.col(f"`{id_col}`").cast("long"), KEY: text_key(text_col)}).dropDuplicates([ID, KEY]).drop(ID, KEY)
    return kept.join(side, same, "left_anti").unionByName(one)
