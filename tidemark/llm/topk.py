"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Candidates are dealt by descending length into classes, and these into blocks of bounded size. The longest vectors of the
table, a seed of bounded size, give each query a score that its k-th hit reaches, and so the least length that a candidate
needs; a query travels to the blocks of the classes that reach it, and queries of like needs share blocks, so that short
candidates travel to few of them or to none. A query block and a candidate block that meet are a cell. It takes its
candidates by descending length and stops where length alone rules out the rest. Before that, the leading coordinates of the
SVD-rotated vectors give partial products; what the other coordinates can add is at most the product of the residual lengths,
so most candidates are dropped after a few coordinates. Survivors are scored exactly on integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.runtime import calm_blas

from .common import cut

#: Hits of a query, and the id step that makes a row a query.
K, EVERY = 5, 50
#: Factor that turns components into integers.
SCALE = 256
#: Numbers in a block of queries or candidates, about; and in the seed of longest vectors.
BLOCK_NUMBERS = 1 << 19
SEED_NUMBERS = 1 << 16
#: Classes of lengths, and groups of queries by the length they need, at most.
CLASSES, GROUPS = 64, 16
#: Error of the quantiles that part them, in ranks: one in so many.
ACCURACY = 10_000
#: Coordinates, and eighths of all of them, after which a candidate is judged; candidates judged together, pairs scored together.
STEPS, EIGHTHS, CHUNK, PAIRS = (4, 8, 16, 32), (4, 5, 6, 7), 512, 1 << 13
#: Beyond this, products of doubles are no longer exact, and Python integers take over.
EXACT = 2.0**52
LONG = (-(1 << 63), (1 << 63) - 1)

HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow column of lists of doubles, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), width))
    out[np.arange(width) < pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


def whole(x: float, scale: int) -> int:
    """scale * x for an x that is a multiple of 1 / scale, also where a double can't hold it."""
    return int(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def exact_scores(q: np.ndarray, c: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products of matching rows, times the squared scale; of Python integers where doubles would round."""
    top = scale * float(np.abs(q).max(initial=0)) * scale * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return np.einsum("ij,ij->i", q * scale, c * scale)
    return np.array([sum(whole(a, scale) * whole(b, scale) for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist())], object)


def as_float(n: object) -> float:
    try:
        return float(n)  # type: ignore[arg-type]
    except OverflowError:
        return np.inf if n > 0 else -np.inf  # type: ignore[operator]


def sortable(n: int) -> str:
    """A text that sorts as the integer does, of any size."""
    digits = str(abs(n))
    if n >= 0:
        return f"p{len(digits):04d}{digits}"
    return f"n{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


class Best:
    """The k best (score, vec_id) of each query so far; a vec_id counts once, with its best score."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [{} for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype != object:  # the k best of each query are enough; of an id, its best score
            order = np.lexsort((-scores, ids, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            if len(rows):
                new = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]))
                rows, ids, scores = rows[new], ids[new], scores[new]
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            rows, ids, scores = rows[best], ids[best], scores[best]
        else:
            order = np.argsort(rows, kind="stable")
            rows, ids, scores = rows[order], ids[order], scores[order]
        present, starts = np.unique(rows, return_index=True)
        for r, lo, hi in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            own = self.found[r]
            for i, s in zip(ids[lo:hi].tolist(), scores[lo:hi].tolist()):
                own[i] = max(own.get(i, s), s)
            kept = sorted(own.items(), key=lambda x: (-x[1], x[0]))[: self.k]
            self.found[r] = dict(kept)
            if len(kept) == self.k:
                self.least[r] = max(self.least[r], np.nextafter(as_float(kept[-1][1]), -np.inf))


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray, scale: int = SCALE) -> Best:
    """floor: for each query, a score that its k-th hit is known to reach. Bounds that overflow drop nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _search(queries, query_ids, vectors, ids, rotation, k, floor, scale)


def _search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray, scale: int) -> Best:
    best = Best(len(queries), k)
    best.least = floor.copy()
    length = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-length, kind="stable")
    vectors, ids, length = vectors[order], ids[order], length[order]
    unit = float(scale) ** 2  # bounds are in the unit of scores
    turned_q, turned_c = queries @ rotation, vectors @ rotation
    steps = sorted(s for s in {*STEPS, *(queries.shape[1] * e // 8 for e in EIGHTHS)} if 0 < s < queries.shape[1])
    rest = lambda m, s: np.sqrt(np.maximum((m[:, s:] ** 2).sum(1), 0))
    tail_q, tail_c = [unit * rest(turned_q, s) for s in steps], [rest(turned_c, s) for s in steps]
    size_q, turned_q = unit * np.sqrt((queries**2).sum(1)), unit * turned_q
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        live = np.flatnonzero(~(size_q * length[at] * (1 + 1e-9) < best.least))  # the longest vector of the chunk comes first
        if not len(live):
            if length[at] == 0 or (size_q * length[at] < best.least).all():
                break
            continue
        low = best.least[live, None]
        slack = 1e-9 * size_q[live, None] * length[None, part]
        alive = ~(size_q[live, None] * length[None, part] + slack < low)
        total, done = np.zeros(alive.shape), 0
        for s, tq, tc in zip(steps, tail_q, tail_c):
            total += turned_q[live, done:s] @ turned_c[part, done:s].T
            done = s
            alive &= ~(total + tq[live, None] * tc[None, part] + slack < low)
            if alive.sum() < alive.size // 64:
                break
        x, y = np.nonzero(alive & (query_ids[live, None] != ids[None, part]))
        for lo in range(0, len(x), PAIRS):
            qx, cy = live[x[lo : lo + PAIRS]], y[lo : lo + PAIRS] + at
            scores = exact_scores(queries[qx], vectors[cy], scale)
            ok = np.array([as_float(x) for x in scores]) >= best.least[qx] if scores.dtype == object else scores >= best.least[qx]
            best.add(qx[ok], ids[cy[ok]], scores[ok])
    return best


def _gram(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v"), width)
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1)  # the rotation alone needs it; scale doesn't matter
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    return run


def parting(df: DataFrame, column: str, parts: int) -> list[float]:
    """Ascending quantiles that part the column's values into about equal parts; fewer where values repeat."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sorted(set(df.agg(F.percentile_approx(column, shares, ACCURACY).alias("x")).first()["x"]))


def places(borders: list[float], column: str, beyond: Callable[[Column, Column], Column]) -> Column:
    """How many of the borders a value is beyond."""
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in borders]), lambda b: beyond(F.col(column), b)))


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of highest integer inner
    product among all others, ties to the smaller id.

    A component x counts as floor(scale * x) of the double x. Vectors that are null or hold null, NaN or infinite components,
    and rows with a null id, take no part. Shorter vectors are padded with zeros; an empty one scores 0. Rows that share an
    id are one vector's versions: the id is never its own hit, occurs once in a list and scores its best. Scores beyond 64
    bits are ranked exactly and shown as the nearest long. Fewer than k other rows give a shorter list; an empty table none.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fit = "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two, so that integers divided by it are doubles")
    # floor(scale * x) / scale; from 2**52 on, doubles are integers.
    whole = f"transform(v, x -> case when abs(x * {scale}) < 4503599627370496D then floor(x * {scale}) / {scale}D else x end)"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.expr(fit)).select("id", F.expr(whole).alias("v"))
    facts = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("v"))).first()
    n, n_queries, width = facts[0], facts[1], max(1, facts[2] or 1)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not n_queries:
        return spark.createDataFrame([], out)
    gram = np.zeros((width, width))
    sums = rows.select("v").mapInArrow(_gram(width), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    for r in sums.toLocalIterator():  # width squared rows, whatever the table holds
        gram[r["i"], r["j"]] = r["x"]
    calm_blas()
    rotation = np.linalg.svd(gram)[0]
    norm = F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))
    seed = rows.orderBy(norm.desc(), "id").limit(max(16, min(1024, SEED_NUMBERS // width))).collect()
    seed_ids, seed_vectors = np.array([r["id"] for r in seed], np.int64), matrix(pa.array([r["v"] for r in seed], pa.list_(pa.float64())), width)
    size = max(64, BLOCK_NUMBERS // width)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with a score that their k-th hit reaches, and the least length that a candidate needs for it."""
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            q = matrix(batch.column("v"), width)
            least = search(q, batch.column("id").to_numpy(), seed_vectors, seed_ids, rotation, k, np.full(len(q), -np.inf), scale).least
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                need = least / (float(scale) ** 2 * np.sqrt((q**2).sum(1))) * (1 - 1e-8)
            need[~(np.isfinite(need) & (need > 0))] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(need)], ["id", "v", "least", "need"])

    asked = cut(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(begun, T.StructType([*rows.schema.fields, T.StructField("least", T.DoubleType()), T.StructField("need", T.DoubleType())])))
    held = rows.select(F.col("id").alias("vec"), F.col("v").alias("w"), norm.alias("length"))
    borders = parting(held, "length", min(CLASSES, -(-n // size)))
    held = held.withColumn("class", places(borders, "length", lambda x, b: x < b))
    classes = held.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("top")).orderBy("class").collect()  # CLASSES rows at most
    borders = parting(asked, "need", min(GROUPS, -(-n_queries // size)))
    asked = asked.withColumn("group", places(borders, "need", lambda x, b: x >= b))
    groups = asked.groupBy("group").agg(F.count("*").alias("n"), F.min("need").alias("need")).orderBy("group").collect()  # GROUPS rows at most
    # Blocks are numbered by class and by group. The classes that a query reaches come first, and the groups that a class serves.
    class_ends, group_ends = (np.cumsum([-(-r["n"] // size) for r in t]).tolist() for t in (classes, groups))
    served = [sum(g["need"] <= c["top"] for g in groups) for c in classes]

    def block(ends: list[int], found: list[int], of: str, salt: int, key: str) -> Column:
        """A block of the class or group `of` (its number, one of `found`), by a hash."""
        spans = {number: (low, high) for number, low, high in zip(found, [0, *ends], ends)}
        low, high = (F.create_map(*[F.lit(x) for number, span in spans.items() for x in (number, span[i])])[F.col(of)] for i in (0, 1))
        return (low + F.pmod(F.xxhash64(F.lit(salt), key), (high - low).cast("long"))).cast("int")

    reach = F.size(F.filter(F.array(*[F.lit(float(c["top"])) for c in classes]), lambda top: top >= F.col("need")))
    asked = asked.withColumn("reach", F.greatest(reach, F.lit(1))).select(
        "id", "v", "least", block(group_ends, [g["group"] for g in groups], "group", 1, "id").alias("q"),
        F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, class_ends)), F.col("reach")) - 1)).alias("c"),
    )
    ends = F.create_map(*[F.lit(x) for c, s in zip(classes, served) for x in (c["class"], group_ends[s - 1] if s else 0)])[F.col("class")]
    held = held.withColumn("end", ends).where("end > 0").select(
        "vec", "w", block(class_ends, [c["class"] for c in classes], "class", 2, "vec").alias("c"), F.explode(F.sequence(F.lit(0), F.col("end") - 1)).alias("q")
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q_ids, ids = left.column("id").to_numpy(), right.column("vec").to_numpy()
            q, c = matrix(left.column("v"), width), matrix(right.column("w"), width)
            got = search(q, q_ids, c, ids, rotation, k, left.column("least").to_numpy(), scale)
            found = [(int(a), int(i), min(max(int(s), LONG[0]), LONG[1]), sortable(int(s))) for a, own in zip(q_ids, got.found) for i, s in own.items()]
        columns = list(zip(*found)) or [()] * 4
        return pa.table({"query_id": pa.array(list(columns[0]), pa.int64()), "vec_id": pa.array(list(columns[1]), pa.int64()), "score": pa.array(list(columns[2]), pa.int64()), "wide": pa.array(list(columns[3]), pa.string())})

    kind = T.StructType([*HIT.fields, T.StructField("wide", T.StringType())])
    hits = asked.groupBy("q", "c").cogroup(held.groupBy("q", "c")).applyInArrow(cell, kind)
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("wide").alias("wide"), F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("wide").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
