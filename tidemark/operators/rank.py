"""Top-k objects of each subject over factor tables, by dot product, cosine or Euclidean distance."""

from __future__ import annotations

from enum import Enum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.runtime import give_back, small
from tidemark.functions.scalar import ZERO_LENGTH
from tidemark.schema import Columns


class Distance(str, Enum):
    DOT = "dot"
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"


#: Numbers that a block of subjects' and of objects' factors holds, about. Objects' are larger, so that subjects travel less.
BLOCK_NUMBERS, OBJECT_NUMBERS = 1 << 21, 1 << 22
#: Subjects and objects that are multiplied at a time, pairs that are scored exactly at a time, and subjects that leave Arrow at a time.
ROWS, COLUMNS, PAIRS, SLICE_ROWS = 2_048, 1_024, 1 << 18, 1 << 15
#: Objects that a group of subjects is compared with before its bounds say which of the others can matter.
FIRST = 2 * COLUMNS
#: Objects, the best for the mean subject, whose scores tell every cell what a subject's list will reach at least.
SEEDS = 512


def _matrix(column: pa.ChunkedArray, width: int, places: np.ndarray | None = None) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros; at these places, if given. Chunks are copied one by one, never joined before, in the precision they have."""
    out, at = np.zeros((len(column), width), column.type.value_type.to_pandas_dtype()), 0
    for lists in column.chunks:
        to = slice(at, at + len(lists)) if places is None else places[at : at + len(lists)]
        if lists.null_count == 0 and (np.diff(lists.offsets.to_numpy()) == width).all():
            out[to] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        else:
            for i, v in zip(np.arange(len(column))[to], lists.to_pylist()):
                out[i] = v
        at += len(lists)
    return out


class Catalog:
    """Objects that are searched, in the order that decides ties. They stay as they came; what is multiplied is made of them block
    by block, so a search needs little more memory than the objects themselves."""

    def __init__(self, c: np.ndarray, distance: Distance):
        self.c, self.far, self.one = c, distance is Distance.EUCLIDEAN, distance is Distance.COSINE
        self.mean = c.mean(0, dtype=float) if self.far else np.zeros(c.shape[1])  # distances stay, and errors fall
        self.length = self.norm = np.concatenate([np.zeros(0), *(np.linalg.norm(c[at : at + SLICE_ROWS] - self.mean, axis=1) for at in range(0, len(c), SLICE_ROWS))])
        if self.one:
            self.norm = np.maximum(self.norm, ZERO_LENGTH)
            self.length = self.length / self.norm

    def along(self, center: np.ndarray, kind: type) -> np.ndarray:
        """Products of a direction with all rows, as searched."""
        out = np.empty(len(self.c), kind)
        for at in range(0, len(self.c), SLICE_ROWS):
            out[at : at + SLICE_ROWS] = self.c[at : at + SLICE_ROWS].astype(kind, copy=False) @ center.astype(kind)
        return out / self.norm if self.one else out

    def block(self, own: np.ndarray, kind: type) -> np.ndarray:
        x = self.c[own].astype(float, copy=False)
        if self.one:
            x /= self.norm[own, None]
        if self.far:  # the nearest have the greatest q c - c c / 2
            x = np.hstack([x - self.mean, -0.5 * (self.length[own, None] ** 2)])
        return x.astype(kind)

    def exact(self, q: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Scores, rounded to 12 digits."""
        out = np.empty(len(row))
        for s in range(0, len(row), PAIRS):
            a, b = q[row[s : s + PAIRS]], self.c[column[s : s + PAIRS]].astype(float, copy=False)
            if self.one:
                b /= self.norm[column[s : s + PAIRS], None]
            out[s : s + PAIRS] = -np.sqrt(((a - b) ** 2).sum(1)) if self.far else np.einsum("ij,ij->i", a, b)
        return np.round(out, 12)


def in_groups(q: np.ndarray, size: int) -> np.ndarray:
    """The rows of q in an order whose runs of `size` are much alike: halves along the direction in which they differ most, again and again."""
    out, waiting = [], [np.arange(len(q))]
    while waiting:
        own = waiting.pop()
        if len(own) <= size:
            out.append(own)
            continue
        x = q[own] - q[own].mean(0)
        at = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        half = size * -(-len(own) // (2 * size))
        by = np.argsort(at, kind="stable")
        waiting += [np.sort(own[by[half:]]), np.sort(own[by[:half]])]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def nearest(q: np.ndarray, c: np.ndarray | Catalog, k: int, distance: Distance, hidden: np.ndarray, hidden_counts: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q, places in c and scores (rounded to 12 digits) of the k best rows of c for each row of q, best first, ties to
    the earlier row of c. hidden: ascending `row of q * len(c) + row of c` of pairs that are left out, and how many each row has.
    floor: scores below which nothing is wanted, for each row of q.

    Products in single precision find whatever may be among the best, within a bound of their error; those pairs are scored in
    double precision, many at a time. But for Euclidean distances, rows of q of much the same direction are searched
    together: no product of a direction at most r from the group's mean exceeds the mean's by more than r times the length of the
    row of c. In descending order of these bounds, or of the row's length where that is less, a row of q is done when its length
    times the bound cannot reach its k-th best score."""
    objects = c if isinstance(c, Catalog) else Catalog(c, distance)
    far, long_c = objects.far, objects.length
    n, m, width = len(q), len(long_c), q.shape[1]
    q = q.astype(float, copy=False)
    if objects.one:
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), ZERO_LENGTH)
    left = q - objects.mean if far else q
    long_q = np.linalg.norm(left, axis=1)
    single = max(long_q.max(initial=0), long_c.max(initial=0)) < 1e9  # else squares might not fit
    kind = np.float32 if single else np.float64
    unit = (width + 8) * (1.2e-7 if single else 2.3e-16)
    room = np.empty(min(ROWS, n) * min(COLUMNS, m), kind)
    rows_out, columns_out, scores_out = [], [], []
    by_likeness = np.arange(n) if far or not single else in_groups(q / np.maximum(long_q, ZERO_LENGTH)[:, None], ROWS)
    if not far:
        slim_c = np.nextafter(long_c.astype(kind), kind(np.inf))

    def settled(names: np.ndarray, size: int, best: tuple, waiting: list, least: np.ndarray) -> tuple:
        """The k best of what was best and of the waiting pairs; raises `least`."""
        row, column = (np.concatenate(x) for x in zip(*waiting))
        if len(hidden):
            keys = names[row] * m + column
            kept = hidden[np.minimum(np.searchsorted(hidden, keys), len(hidden) - 1)] != keys
            row, column = row[kept], column[kept]
        score = objects.exact(q, names[row], column)
        kept = score >= least[row]
        row, column, score = (np.r_[a, b[kept]] for a, b in zip(best, (row, column, score)))
        by = np.lexsort((column, -score, row))
        row, column, score = row[by], column[by], score[by]
        first = np.searchsorted(row, np.arange(size + 1))
        kept = np.arange(len(row)) - first[row] < k
        full = np.flatnonzero(np.diff(first) >= k)
        least[full] = score[first[full] + k - 1]
        return row[kept], column[kept], score[kept]

    for lo in range(0, n, ROWS):
        names = by_likeness[lo : lo + ROWS]
        size = len(names)
        own_q, length = left[names].astype(kind), long_q[names]
        if far:
            own_q = np.hstack([own_q, np.ones((size, 1), kind)])
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(size, -np.inf) if floor is None else floor[names]  # the k-th best score so far; distances are negative
        open_ = np.arange(size)
        waiting, n_waiting = [], 0  # pairs to be scored exactly
        if not far:  # without length all scores are 0: the first rows are the best
            none = np.flatnonzero(length == 0)
            open_ = np.flatnonzero(length > 0)
            for i in none:
                gone = hidden[np.searchsorted(hidden, names[i] * m) : np.searchsorted(hidden, (names[i] + 1) * m)] - names[i] * m
                at = np.setdiff1d(np.arange(min(m, k + len(gone))), gone)[:k]
                best = np.r_[best[0], np.full(len(at), i)], np.r_[best[1], at], np.r_[best[2], np.zeros(len(at))]
            if not len(open_):
                order, reach = np.zeros(0, np.int64), slim_c
            else:
                directions = left[names[open_]] / length[open_, None]
                center = directions.mean(0)
                radius = np.linalg.norm(directions - center, axis=1).max()
                # A little more, for what single precision loses.
                reach = np.full(m, np.inf) if not np.isfinite(radius) else np.minimum(objects.along(center, kind) + kind(radius + 2 * unit * (np.linalg.norm(center) + radius)) * slim_c, kind(1 + 2 * unit) * slim_c)
                order = np.argpartition(-reach, FIRST)[:FIRST] if m > FIRST else np.arange(m)
                order = order[np.argsort(-reach[order], kind="stable")]
        else:
            order = np.arange(m)
        mine, at = own_q[open_], 0
        while at < m:
            if not far and at == FIRST:  # those of the others whose bound reaches what a row has
                if n_waiting:
                    best, waiting, n_waiting = settled(names, size, best, waiting, least), [], 0
                rest = np.ones(m, bool)
                rest[order] = False
                bottom = ((least[open_] - unit * length[open_] * long_c.max(initial=0) - 1e-11) / length[open_]).min(initial=np.inf)
                rest = np.flatnonzero(rest & (reach >= bottom))
                order = np.concatenate([order, rest[np.argsort(-reach[rest], kind="stable")]])
            if at >= len(order):
                break
            own = order[at : at + COLUMNS]
            top = long_c[own].max()
            error = unit * (length * top + (top**2 + length**2 if far else 0)) + 1e-11
            if not far:
                still = length[open_] * reach[own[0]] >= least[open_] - error[open_]
                if not still.all():
                    open_ = open_[still]
                    mine = own_q[open_]
            if not len(open_):
                break
            at += COLUMNS
            block = objects.block(own, kind)
            found = np.matmul(mine, block.T, out=room[: len(open_) * len(block)].reshape(len(open_), len(block)))
            bound = (length**2 - least**2) / 2 - 1e-11 * np.where(np.isfinite(least), -least, 0) if far else least
            bound = np.where(np.isfinite(least), bound, -np.inf)[open_]
            fresh = np.flatnonzero(~np.isfinite(bound))
            if len(fresh):  # what the k best of this block reach, hidden ones aside
                asked = k + hidden_counts[names[open_[fresh]]]
                can = asked <= len(block)
                if can.any():
                    kth = np.unique(len(block) - asked[can])
                    part = np.partition(found[fresh[can]], kth, axis=1)
                    bound[fresh[can]] = part[np.arange(len(part)), len(block) - asked[can]] - error[open_[fresh[can]]]
            bound = (bound - error[open_]).astype(kind)
            bound = np.nextafter(bound, kind(-np.inf))
            some = np.flatnonzero(found.max(1) >= bound)
            if len(some):
                flat = np.flatnonzero(found[some] >= bound[some, None])
                waiting.append((open_[some[flat // len(block)]], own[flat % len(block)]))
                n_waiting += len(flat)
            if n_waiting and (len(fresh) or 2 * n_waiting > k * size):
                best, waiting, n_waiting = settled(names, size, best, waiting, least), [], 0
        best_row, best_column, best_score = settled(names, size, best, waiting, least) if n_waiting else best
        by = np.argsort(best_row, kind="stable")
        rows_out.append(names[best_row[by]])
        columns_out.append(best_column[by])
        scores_out.append(best_score[by])
    row, column, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows_out, np.int64), (columns_out, np.int64), (scores_out, float)))
    by = np.argsort(row, kind="stable")
    return row[by], column[by], score[by]


class VectorRanker:
    """subjects: id, factors; objects: id, factors (both array<double>)."""

    def __init__(self, distance: Distance | str, subjects: DataFrame, objects: DataFrame):
        self.distance = Distance(distance)
        self.subjects, self.objects = subjects, objects

    def rank(self, k: int, filter_pairs: DataFrame | None = None, whitelist: DataFrame | None = None, exclude_self: bool = False, as_float: bool = True, alike: bool = False) -> DataFrame:
        """subject, object, score, rank. Best first: high scores, but small Euclidean distances; ties to the smaller object.

        Subjects and objects are dealt into blocks, every pair of blocks is one task's cell, and a cell returns at most k rows
        a subject. Scores are floats, or, on request, the doubles they are computed in. filter_pairs (subject, object) never come back; whitelist limits the objects before scoring.
        alike: of objects with the same factors, only so many are compared, the smallest ones, as a subject's list could hold: the
        others tie with these and come after them.
        """
        if k <= 0:
            raise ValueError("`k` must be positive")
        spark = self.subjects.sparkSession
        objects = self.objects.select("id", F.col("factors").cast("array<double>").alias("factors"))
        if whitelist is not None:
            objects = objects.join(small(whitelist.select(F.col(whitelist.columns[0]).alias("id")).distinct()), "id", "left_semi")
        if alike:
            most = k + exclude_self
            if filter_pairs is not None:
                most += filter_pairs.groupBy(filter_pairs.columns[0]).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
            place = F.row_number().over(Window.partitionBy("factors").orderBy("id"))
            objects = objects.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
        subjects = self.subjects.select("id", F.col("factors").cast("array<double>").alias("factors"))
        # Factors that are single precision anyway travel as such.
        plain = F.coalesce(F.bool_and(F.forall("factors", lambda x: x.cast("float").cast("double").eqNullSafe(x))), F.lit(True))
        n_objects, width, plain_objects = objects.agg(F.count("*"), F.coalesce(F.max(F.size("factors")), F.lit(1)), plain).first()
        seeded = self.distance is Distance.DOT and filter_pairs is None and not exclude_self and width <= 1_024 and n_objects > SEEDS
        n_subjects, plain_subjects, *center = subjects.agg(F.count("*"), plain, *[F.avg(F.get("factors", F.lit(i))) for i in range(width * seeded)]).first()
        seeds = None
        if seeded and n_subjects and None not in center:
            along = F.aggregate(F.zip_with("factors", F.array(*[F.lit(x) for x in center]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            best = objects.select("factors", along.alias("__x")).where(F.size("factors") == width).orderBy(F.desc("__x")).limit(SEEDS).collect()
            seeds = np.array([r["factors"] for r in best], float).reshape(-1, width)
        objects, subjects = (t.withColumn("factors", F.col("factors").cast("array<float>")) if one else t for t, one in ((objects, plain_objects), (subjects, plain_subjects)))
        parallel = spark.sparkContext.defaultParallelism
        rows_o = max(1, -(-n_objects // max(256, OBJECT_NUMBERS // max(1, width))))
        rows_s = max(1, min(max(-(-n_subjects // max(256, BLOCK_NUMBERS // max(1, width))), -(-2 * parallel // rows_o)), n_subjects // 64))
        s_id, o_id = subjects.schema["id"].dataType, objects.schema["id"].dataType
        hidden = F.lit(None).cast(T.ArrayType(o_id))
        if filter_pairs is not None:
            seen = filter_pairs.select(F.col(filter_pairs.columns[0]).alias("id"), F.col(filter_pairs.columns[1]).alias("o")).groupBy("id").agg(F.collect_set("o").alias("seen"))
            subjects = subjects.join(seen, "id", "left")
        else:
            subjects = subjects.withColumn("seen", hidden)
        left = subjects.select(F.col("id").alias("s"), "factors", "seen", F.pmod(F.xxhash64("id"), F.lit(rows_s)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(rows_o - 1))).alias("b"))
        right = objects.select(F.col("id").alias("o"), F.col("factors").alias("w"), F.pmod(F.xxhash64("id"), F.lit(rows_o)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows_s - 1).cast("long"))).alias("a"))
        distance, k_cell = self.distance, k
        ids = {"s": s_id, "o": o_id}
        schema = T.StructType([T.StructField("s", ids["s"]), T.StructField("o", ids["o"]), T.StructField("score", T.DoubleType())])

        def cell(subjects: pa.Table, objects: pa.Table) -> pa.Table:
            if not (subjects.num_rows and objects.num_rows):
                return pa.table({f.name: pa.array([], _arrow(f.dataType)) for f in schema.fields})
            give_back()
            by = pc.sort_indices(objects, [("o", "ascending")]).to_numpy()
            places = np.empty(len(by), np.int64)
            places[by] = np.arange(len(by))
            others, c = objects.column("o").take(pa.array(by)).combine_chunks(), Catalog(_matrix(objects.column("w"), width, places), distance)
            found, known = [], None if seeds is None else Catalog(seeds, distance)
            for lo in range(0, subjects.num_rows, SLICE_ROWS):
                own = subjects.slice(lo, SLICE_ROWS)
                names, lists = own.column("s").combine_chunks(), own.column("seen").combine_chunks()
                gone = [(pc.list_parent_indices(lists), lists.flatten())]
                if exclude_self:
                    gone.append((pa.array(range(len(names)), pa.int64()), names))
                keys = []
                for rows, hid in gone:
                    at = pc.index_in(hid.cast(others.type), value_set=others)
                    there = at.is_valid().to_numpy(zero_copy_only=False)
                    keys.append(rows.to_numpy(zero_copy_only=False).astype(np.int64)[there] * len(others) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)[there])
                hidden = np.unique(np.concatenate(keys))
                q, floor = _matrix(own.column("factors"), width), None
                if known is not None:
                    row, _, score = nearest(q, known, k_cell, distance, np.zeros(0, np.int64), np.zeros(len(q), np.int64))
                    n_found = np.bincount(row, minlength=len(q))
                    floor = np.full(len(q), -np.inf)
                    floor[n_found == k_cell] = score[np.cumsum(n_found)[n_found == k_cell] - 1] - 1e-11
                row, column, score = nearest(q, c, k_cell, distance, hidden, np.bincount(hidden // len(others), minlength=len(names)), floor)
                found.append(pa.table({"s": names.take(pa.array(row)).cast(_arrow(ids["s"])), "o": others.take(pa.array(column)).cast(_arrow(ids["o"])), "score": pa.array(-score if distance is Distance.EUCLIDEAN else score)}))
            return pa.concat_tables(found)

        hits = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(cell, schema)
        best = F.col("score").asc() if self.distance is Distance.EUCLIDEAN else F.col("score").desc()
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(best, "o")))
        return ranked.where(F.col("rank") <= k).select(F.col("s").alias("subject"), F.col("o").alias("object"), F.col("score").cast("float" if as_float else "double").alias("score"), F.col("rank").cast("int").alias("rank"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fold_biases(table: DataFrame, distance: Distance | str, subject: bool) -> DataFrame:
    """Factor tables with a `bias` turned into plain ones: for dot products [bias, 1, *factors] against [1, bias, *factors];
    for the other distances the bias is one more coordinate."""
    b, one = F.col("bias").cast("double"), F.lit(1.0)
    head = F.array(b) if Distance(distance) is not Distance.DOT else F.array(b, one) if subject else F.array(one, b)
    return table.select("id", F.concat(head, F.col("factors").cast("array<double>")).alias("factors"))


def recommend_from_scores(scores: DataFrame, k: int, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None, ascending: bool = False) -> DataFrame:
    """Top k of a table item_id, score, ties to the smaller item."""
    if k <= 0:
        raise ValueError("`k` must be positive")
    if whitelist is not None:
        scores = scores.join(whitelist.select(Columns.Item).distinct(), Columns.Item, "left_semi")
    if blacklist is not None:
        scores = scores.join(blacklist.select(Columns.Item).distinct(), Columns.Item, "left_anti")
    return scores.orderBy(F.col(Columns.Score).asc() if ascending else F.col(Columns.Score).desc(), Columns.Item).limit(k)


def with_rank(reco: DataFrame, target: str = Columns.User, k: int | None = None) -> DataFrame:
    """Adds the rank within each target: score descending, ties to the smaller item."""
    ranked = reco.withColumn(Columns.Rank, F.row_number().over(Window.partitionBy(target).orderBy(F.col(Columns.Score).desc(), Columns.Item)).cast("int"))
    return ranked if k is None else ranked.where(F.col(Columns.Rank) <= k)
