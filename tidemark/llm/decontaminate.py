"""Benchmark decontamination with a distributed positional inverted index.

The training table is indexed once: each segment (some MB of documents) becomes one row of a stored table that holds its
terms and, for each term, its postings, i.e. the ascending positions of the term in the segment. Segments lie where their
documents lie, so indexing shuffles nothing and a frequent term's postings are spread over all segments. A test phrase is
searched in a segment by its posting lists alone: the list of its rarest term there gives the possible starts, and each
further list, rarer terms first and moved by the term's offset, is intersected with what is left (a binary search in that
list; give or take the slop for proximity). Test phrases are broadcast in blocks of a bounded size.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, drop_since, mark, pieces, small, text_batches, text_key, trimmed, words_of

#: Words a window has.
WINDOW = 10
#: Words that a proximity match may be off its place.
SLOP = 2
#: Words of test items that one broadcast block holds at most (a longer item makes a block of its own).
BLOCK_WORDS = 1_000_000
#: Bytes of text in a segment, about (a longer text makes a segment of its own).
SEGMENT = 2 << 20
#: Positions between documents of a segment; a window with its slop must be shorter.
GAP = 64
#: Windows whose terms are looked up at a time.
LOOKUPS = 1 << 16
#: Name of the column of texts' keys in the table of rejected ones.
KEY = "__tidemark_key"


class Phrases:
    """The windows of some test items as token ids, padded to one width with -1."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items = sorted({k for k, w in items if w}, key=str)
        rank = {k: i for i, k in enumerate(self.items)}
        seen: dict[tuple[int, ...], set[int]] = {}
        for key, words in items:
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                seen.setdefault(tuple(codes[at : at + window]), set()).add(rank[key])
        self.width = max((len(w) for w in seen), default=1)
        self.length = np.array([len(w) for w in seen], np.int64)
        self.terms = np.full((len(seen), self.width), -1, np.int64)
        for i, w in enumerate(seen):
            self.terms[i, : len(w)] = w
        self.owners = [sorted(x) for x in seen.values()]


class Codes(dict):
    """Numbers terms in order of their first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def segment(texts: list[bytes | None]) -> dict[str, bytes]:
    """The postings of some documents: `sizes` (words of each), `terms` (joined by blanks), `counts` (of each term) and
    `steps`, the differences of successive positions, term by term. Documents lie GAP positions apart."""
    parts = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = Codes()
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(parts)), np.int32, int(sizes.sum()))
    order = np.argsort(flat.astype(np.uint16) if len(codes) < 1 << 16 else flat, kind="stable")
    positions = (np.arange(len(flat)) + np.repeat(np.arange(len(parts)) * GAP, sizes))[order]
    return {
        "sizes": sizes.astype("<i4").tobytes(), "terms": b" ".join(codes), "counts": np.bincount(flat, minlength=len(codes)).astype("<i4").tobytes(),
        "steps": np.diff(positions, prepend=0).astype("<i4").tobytes(),
    }


class Segment:
    """A stored segment, read back."""

    def __init__(self, sizes: bytes, terms: bytes, counts: bytes, steps: bytes):
        self.sizes = np.frombuffer(sizes, "<i4").astype(np.int64)
        self.starts = np.cumsum(self.sizes + GAP) - self.sizes - GAP
        self.span = int(self.sizes.sum()) + GAP * (len(self.sizes) + 2)
        self.terms = terms.split(b" ") if terms else []
        self.counts = np.frombuffer(counts, "<i4").astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(steps, "<i4").astype(np.int64))

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


class Lists:
    """The posting lists that a segment has of the test terms, as one ascending array of (test term, position)."""

    def __init__(self, held: Segment, ids: dict[bytes, int]):
        code = np.fromiter((ids.get(t, -1) for t in held.terms), np.int64, len(held.terms))
        own = np.flatnonzero(code >= 0)
        own = own[np.argsort(code[own], kind="stable")]
        n, first = held.counts[own], (np.cumsum(held.counts) - held.counts)[own]
        self.span = held.span
        self.counts = np.zeros(len(ids) + 1, np.int64)
        self.counts[code[own]] = n
        self.first = np.cumsum(self.counts) - self.counts
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        self.keys = np.repeat(code[own], n) * self.span + held.positions[at]

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of a term holds a position from low to high (of which low may lie before the segment)."""
        base = term * self.span
        at = np.searchsorted(self.keys, base + np.maximum(low, 0))
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + high)


def starts_of(lists: Lists, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, position of its rarest term) of the phrases whose every term occurs at its offset from the start, give
    or take `slop` words."""
    found = []
    for low in range(0, len(phrases.terms) if len(lists.keys) else 0, LOOKUPS):
        terms = phrases.terms[low : low + LOOKUPS]
        count = np.where(terms >= 0, lists.counts[terms], np.iinfo(np.int64).max)
        live = np.flatnonzero(count.min(axis=1) > 0)  # windows whose every term has postings here
        if not len(live):
            continue
        terms, order = terms[live], np.argsort(count[live], axis=1, kind="stable")  # rarest term first
        rows = np.arange(len(live))
        rare = order[:, 0]
        term = terms[rows, rare]
        n = lists.counts[term]
        which = np.repeat(rows, n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lists.first[term], n)
        seen = lists.keys[posting] - term[which] * lists.span
        start = seen - rare[which]
        if slop:  # the rarest term may itself lie off its place
            start, which, seen = np.add.outer(np.arange(-slop, slop + 1), start).ravel(), np.tile(which, 2 * slop + 1), np.tile(seen, 2 * slop + 1)
        for k in range(1, phrases.width):
            at = order[which, k]
            wanted = terms[which, at]
            short = wanted < 0  # a window of fewer words
            ok = short | lists.has(np.where(short, 0, wanted), start + at - slop, start + at + slop)
            start, which, seen = start[ok], which[ok], seen[ok]
            if not len(start):
                break
        found.append((live[which] + low, start, seen))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none)  # type: ignore[return-value]


def matcher(packed: bytes, slop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Findings of one block of test phrases, for each document of stored segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = pickle.loads(packed)
        if phrases.width + 2 * slop >= GAP:
            raise ValueError(f"a window and twice the slop must be shorter than {GAP}")
        names = [str(k) for k in phrases.items]
        for batch in batches:
            for i in range(batch.num_rows):
                held = Segment(*(batch.column(c)[i].as_py() for c in ("sizes", "terms", "counts", "steps")))
                lists, n = Lists(held, phrases.ids), len(held.sizes)
                phrase, start, place = starts_of(lists, phrases)
                near, _, near_place = starts_of(lists, phrases, slop) if slop else (phrase, start, place)
                by_doc, by_near = ([set() for _ in range(n)] for _ in range(2))
                for found, p, s in ((by_doc, phrase, place), (by_near, near, near_place)):
                    for d, w in set(zip(held.document(s).tolist(), p.tolist())):
                        found[d].update(phrases.owners[w])
                # Overlapping windows are one run of hit words.
                by_start = np.argsort(start, kind="stable")
                low, high = start[by_start], np.maximum.accumulate((start + phrases.length[phrase])[by_start])
                new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.zeros(0, bool)
                low, high = low[new], high[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(high) - 1]])] if len(new) else high
                owner = held.document(low)
                n_hit = np.bincount(owner, high - low, n).astype(np.int64) if len(low) else np.zeros(n, np.int64)
                runs: list[list[dict[str, int]]] = [[] for _ in range(n)]
                for d, a, b in zip(owner.tolist(), (low - held.starts[owner]).tolist(), (high - held.starts[owner]).tolist()):
                    runs[d].append({"start": a, "end": b})
                docs = batch.column("docs")[i].values
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([batch.column("segment")[i].as_py()] * n, pa.binary()), "place": pa.array(range(n), pa.int64()), "doc_id": docs,
                    "n_words": pa.array(held.sizes, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                    "items": pa.array([[names[k] for k in sorted(x)] for x in by_doc], pa.list_(pa.string())),
                    "near_items": pa.array([[names[k] for k in sorted(x)] for x in by_near], pa.list_(pa.string())),
                    "spans": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                })

    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[bytes]:
    """The test items, streamed to the driver and packed into blocks of about BLOCK_WORDS words."""
    items, size = [], 0
    rows = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).where("k is not null")
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["t"]) if row["t"] is not None else None)
        if items and size + len(words) > BLOCK_WORDS:
            yield pickle.dumps(Phrases(items, window))
            items, size = [], 0
        items.append((row["k"], words))
        size += len(words)
    yield pickle.dumps(Phrases(items, window))


def build_index(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of a training table, one row per segment: segment, docs (ids), and what segment() gives.
    It serves any number of searches. Null, empty and wordless texts are documents without postings; a very long text is a
    segment of its own; rows that repeat are indexed one by one; null ids stay null; further columns are not read; an empty
    table gives an empty index."""
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = T.StructType([T.StructField("segment", T.BinaryType()), T.StructField("docs", T.ArrayType(docs.schema["doc_id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "terms", "counts", "steps"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=SEGMENT):
                ids = batch.column("doc_id")
                lists = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), ids)
                made = segment(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes]), lists, *(pa.array([v], pa.binary()) for v in made.values())], kind.fieldNames())

    # Segments are large rows: row groups are closed by their bytes, checked at each row.
    return cut(docs.mapInArrow(trimmed(run), kind), **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})


def search(index: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Exact and proximity matches of test items in an index; see matches()."""
    text_batches(index.sparkSession)
    kinds = [("segment", T.BinaryType()), ("place", T.LongType()), ("doc_id", index.schema["docs"].dataType.elementType), ("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("near_items", T.ArrayType(T.StringType())),
             ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    found = [index.mapInArrow(trimmed(matcher(b, slop)), schema) for b in blocks(benchmark, item_col, item_text_col, window)]
    if len(found) == 1:
        return found[0].drop("segment", "place")
    # More test words than one block holds: the index is read once for each block; a document's findings are then united.
    parts = found[0]
    for part in found[1:]:
        parts = parts.unionByName(part)
    merged = parts.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    hits = "array_distinct(flatten(transform(spans, s -> sequence(s.start, s.end - 1))))"
    return merged.select("doc_id", "n_words", F.size(F.expr(hits)).cast("long").alias("n_hit"), "items", "near_items", "spans")


def matches(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids with an exactly occurring window, as sorted strings),
    near_items (ids with a window that has a place where its every term lies within `slop` words of its offset; the exact
    ones if slop is 0) and spans (hit words, [start, end)).

    Words are lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters. An item of fewer than `window`
    words is one window. Null or empty texts have no words and never match; very long texts are indexed whole; items with a
    null id or without words are ignored; items that share an id count as one; repeated documents give a row each. Columns
    other than the named ones are not read, so clashing names don't matter. An empty benchmark leaves every document clean;
    an empty table gives no rows.
    """
    index = build_index(documents, id_col=id_col, text_col=text_col)
    return search(index, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, slop=slop)


def postings(index: DataFrame) -> DataFrame:
    """An index as rows: term, doc_id, positions in the document (ascending, from 0); one row per term and document row, so
    repeated ids give repeated rows and documents without words none."""
    kind = index.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Segment(*(batch.column(c)[i].as_py() for c in ("sizes", "terms", "counts", "steps")))
                if not len(held.positions):
                    continue
                code, doc = np.repeat(np.arange(len(held.terms)), held.counts), held.document(held.positions)
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
                ends = pa.array(np.append(first, len(code)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held.terms[c].decode("utf-8", "replace") for c in code[first]], pa.string()), batch.column("docs")[i].values.take(pa.array(doc[first])), pa.ListArray.from_arrays(ends, pa.array(held.positions - held.starts[doc]))],
                    ["term", "doc_id", "positions"],
                )

    return index.mapInArrow(run, T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", kind), T.StructField("positions", T.ArrayType(T.LongType()))]))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the exact matches: n_items, items_sha256 and contaminated in place of the lists."""
    ids = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents without a hit word, all columns. Rows are judged by their texts alone, so rows that share an id or have
    none are documents like all others, and equal texts fare alike. Null, empty and wordless texts stay; very long texts are
    searched whole; an empty benchmark lets all stay; an empty table stays empty. Columns may have any name."""
    point = mark()
    index = build_index(documents.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")), id_col="key")
    found = search(index, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, slop=0)
    gone = cut(found.where("n_hit > 0").select(F.col("doc_id").alias(KEY)).distinct())
    drop_since(documents.sparkSession, point)
    side = small(gone, gone.count(), BROADCAST_ROWS // 2)
    return documents.join(side, text_key(text_col) == F.col(KEY), "left_anti")


def sha256_of(items: list[str]) -> str:
    """items_sha256 of a list of ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
