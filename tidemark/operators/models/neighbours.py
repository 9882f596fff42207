"""Item-item models: nearest neighbours by weighted co-occurrence, and the closed-form linear autoencoder (EASE)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.runtime import small, store
from tidemark.operators.products import coded, top_products
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset
from tidemark.sources.interactions import user_item_matrix

from .base import ModelBase


#: Items of a user beyond which the pairs of their items are dealt to several tasks.
HEAVY = 2_000


def item_pairs(matrix: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right, two tables of the matrix's cells by user, joined on the user. A heavy user's left cells are dealt into
    shares of about HEAVY, by a hash of the row, and the right ones go to each share, so that no task makes all their pairs."""
    heavy = matrix.groupBy(Columns.User).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select(Columns.User, F.ceil(F.col("n") / HEAVY).cast("int").alias("__shares"))
    if heavy.isEmpty():
        return left.join(right, Columns.User)
    heavy = small(heavy)
    shares = F.coalesce("__shares", F.lit(1))
    dealt = left.join(heavy, Columns.User, "left").withColumn("__share", F.pmod(F.xxhash64(*left.columns), shares).cast("int")).drop("__shares")
    copied = right.join(heavy, Columns.User, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return dealt.join(copied, [Columns.User, "__share"]).drop("__share")


def to_codes(df: DataFrame, column: str, codes: DataFrame | None) -> DataFrame:
    """df with longs for the ids of a column (see coded)."""
    if codes is None:
        return df.withColumn(column, F.col(column).cast("long"))
    return df.join(small(codes), column).withColumn(column, F.col("__code")).drop("__code")


def of_codes(df: DataFrame, column: str, codes: DataFrame | None, kind: T.DataType, named: str | None = None) -> DataFrame:
    """The ids again. named: the column's name in the table of codes."""
    if codes is None:
        return df.withColumn(column, F.col(column).cast(kind))
    back = small(codes.select(F.col("__code").alias(column), F.col(named or column).alias("__name")))
    return df.join(back, column).withColumn(column, F.col("__name")).drop("__name")


class ItemKNNModel(ModelBase):
    """Top-K neighbours (an item itself among them) by the dot product of weighted item columns.

    weighting: 'plain' (as they are), 'cosine' (unit columns), 'tfidf' (sqrt(x) * (ln n_items - ln(1 + items of the user)),
    unit columns) or 'bm25' (K1, B). Ties at the K-th neighbour go to the larger item, as in the library behind the
    reference values. The similarity table is a product of the matrix with itself (top_products).
    """

    def __init__(self, weighting: str = "tfidf", K: int = 20, K1: float = 1.2, B: float = 0.75, verbose: int = 0):
        super().__init__()
        if weighting not in ("plain", "cosine", "tfidf", "bm25"):
            raise ValueError("`weighting` must be one of 'plain', 'cosine', 'tfidf', 'bm25'")
        self.weighting, self.K, self.K1, self.B, self.verbose = weighting, K, K1, B, verbose

    def weighted(self, matrix: DataFrame) -> DataFrame:
        """The matrix with the weighting applied to its cells."""
        if self.weighting == "plain":
            return matrix
        x = F.col(Columns.Weight)
        if self.weighting in ("tfidf", "bm25"):
            users = matrix.groupBy(Columns.User).agg(F.count("*").alias("__items"))
            total = matrix.agg(F.countDistinct(Columns.Item).alias("__n"))
            matrix = matrix.join(users, Columns.User).crossJoin(F.broadcast(total))  # one row
            idf = F.log("__n") - F.log(F.lit(1.0) + F.col("__items"))
            if self.weighting == "tfidf":
                value = F.sqrt(x) * idf
            else:
                sums = matrix.groupBy(Columns.Item).agg(F.sum(x).alias("__sum"))
                mean = sums.agg(F.avg("__sum").alias("__mean"))
                matrix = matrix.join(sums, Columns.Item).crossJoin(F.broadcast(mean))  # one row
                length = (1.0 - self.B) + self.B * F.col("__sum") / F.col("__mean")
                value = x * (self.K1 + 1.0) / (self.K1 * length + x) * idf
            matrix = matrix.select(*Columns.UserItem, value.alias(Columns.Weight))
        if self.weighting == "bm25":
            return matrix
        norms = matrix.groupBy(Columns.Item).agg(F.sqrt(F.sum(F.col(Columns.Weight) ** 2)).alias("__norm"))
        unit = F.when(F.col("__norm") > 0, F.col(Columns.Weight) / F.col("__norm")).otherwise(0.0)
        return matrix.join(norms, Columns.Item).select(*Columns.UserItem, unit.alias(Columns.Weight))

    def _fit(self, dataset: Dataset) -> None:
        matrix, forget_matrix = store(user_item_matrix(dataset.raw.where(F.col(Columns.User).isNotNull() & F.col(Columns.Item).isNotNull())))
        names = coded(matrix, Columns.Item)
        cells = to_codes(self.weighted(matrix), Columns.Item, names)
        lists = cells.groupBy(Columns.User).agg(F.collect_list(F.struct(Columns.Item, Columns.Weight)).alias("l"))
        ids, w = F.col(f"l.{Columns.Item}"), F.col(f"l.{Columns.Weight}")
        table, forget = store(lists.select(F.xxhash64(Columns.User).alias("mid"), ids.alias("rows"), w.alias("a"), ids.alias("ids"), w.alias("w")))
        forget_matrix()
        found = top_products(table, self.K, 12, largest=True)
        forget()
        similar = found.select(F.col("row").alias(Columns.TargetItem), F.col("id").alias(Columns.Item), F.col("value").alias(Columns.Score))
        kind = dataset.raw.schema[Columns.Item].dataType
        similar = of_codes(of_codes(similar, Columns.TargetItem, names, kind, Columns.Item), Columns.Item, names, kind)
        # Scores have 12 digits, so that the order of summation cannot decide a tie.
        self.tables = {"similar": similar.select(Columns.TargetItem, Columns.Item, F.round(Columns.Score, 12).alias(Columns.Score)), "matrix": user_item_matrix(dataset.raw)}

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        """Items of a user against their neighbours, as a product of two sparse matrices; what a user has seen is left out there."""
        rows, forget_rows = store(user_item_matrix(dataset.raw.join(users, Columns.User, "left_semi")))
        similar = self.tables["similar"] if items is None else self.tables["similar"].join(items, Columns.Item, "left_semi")
        known, others = coded(rows, Columns.User), coded(similar.select(Columns.Item).unionByName(rows.select(Columns.Item)), Columns.Item)
        left = to_codes(to_codes(rows, Columns.User, known), Columns.Item, others)
        right = to_codes(to_codes(similar, Columns.Item, others), Columns.TargetItem, None if others is None else others.withColumnRenamed(Columns.Item, Columns.TargetItem))
        left = left.groupBy(F.col(Columns.Item).alias("mid")).agg(F.collect_list(F.struct(Columns.User, Columns.Weight)).alias("l"))
        right = right.groupBy(F.col(Columns.TargetItem).alias("mid")).agg(F.collect_list(F.struct(Columns.Item, Columns.Score)).alias("r"))
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
        both = left.join(right, "mid", "left").select("mid", F.col(f"l.{Columns.User}").alias("rows"), F.col(f"l.{Columns.Weight}").alias("a"), none(f"r.{Columns.Item}", "long").alias("ids"), none(f"r.{Columns.Score}", "double").alias("w"))
        table, forget = store(both)
        forget_rows()
        found = top_products(table, k, 9, largest=False, skip_mids=filter_viewed)
        forget()
        reco = found.select(F.col("row").alias(Columns.User), F.col("id").alias(Columns.Item), F.round("value", 9).alias(Columns.Score))
        reco = of_codes(of_codes(reco, Columns.User, known, users.schema[Columns.User].dataType), Columns.Item, others, dataset.raw.schema[Columns.Item].dataType)
        return reco.where(F.col(Columns.Score) != 0).select(*Columns.UserItem, Columns.Score)

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        reco = self.tables["similar"].join(small(targets), Columns.TargetItem, "left_semi")
        return reco if items is None else reco.join(items, Columns.Item, "left_semi")


#: Items up to which the dense inverse is formed on the driver (0.8 GB of doubles).
MOST_ITEMS = 10_000


class EASEModel(ModelBase):
    """W = P / -diag(P) with P = inverse(X'X + regularization * I) and a zero diagonal. The Gram matrix is an aggregate; only
    it, whose size is the square of the catalog and is checked, goes to the driver."""

    def __init__(self, regularization: float = 500.0, verbose: int = 0):
        super().__init__()
        self.regularization, self.verbose = regularization, verbose

    def _fit(self, dataset: Dataset) -> None:
        matrix = user_item_matrix(dataset.raw)
        names = [r[0] for r in matrix.select(Columns.Item).distinct().orderBy(Columns.Item).limit(MOST_ITEMS + 1).collect()]
        if len(names) > MOST_ITEMS:
            raise ValueError(f"EASE needs a dense inverse; more than {MOST_ITEMS} items don't fit")
        place = {n: i for i, n in enumerate(names)}
        left = matrix.select(Columns.User, F.col(Columns.Item).alias("i"), F.col(Columns.Weight).alias("a"))
        right = matrix.select(Columns.User, F.col(Columns.Item).alias("j"), F.col(Columns.Weight).alias("b"))
        cells = item_pairs(matrix, left, right).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"))
        gram = np.zeros((len(names), len(names)))
        for r in cells.toLocalIterator():
            i, j = place[r["i"]], place[r["j"]]
            gram[i, j] = gram[j, i] = r["x"]
        np.fill_diagonal(gram, gram.diagonal() + self.regularization)
        inverse = np.linalg.inv(gram) if len(names) else gram
        weights = inverse / -inverse.diagonal()
        np.fill_diagonal(weights, 0.0)
        spark = dataset.raw.sparkSession
        kind = matrix.schema[Columns.Item].dataType
        schema = T.StructType([T.StructField(Columns.TargetItem, kind), T.StructField("weights", T.ArrayType(T.DoubleType()))])
        self.names = names
        self.tables = {"rows": spark.createDataFrame([(n, weights[i].tolist()) for i, n in enumerate(names)], schema)}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables
        self.names = [r[0] for r in tables["rows"].select(Columns.TargetItem).orderBy(Columns.TargetItem).collect()]

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        """Scores are X W', as the ranker takes rows of W for item vectors: of each user, a dense row, cut to its best k before
        anything is shuffled again."""
        names, weights = self.names, np.array([r[1] for r in self.tables["rows"].orderBy(Columns.TargetItem).collect()]).reshape(len(self.names), -1)
        place = {n: i for i, n in enumerate(names)}
        allowed = np.ones(len(names), bool)
        if items is not None:
            wanted = {r[0] for r in items.join(self.tables["rows"].select(F.col(Columns.TargetItem).alias(Columns.Item)), Columns.Item, "left_semi").collect()}
            allowed = np.array([n in wanted for n in names], bool)
        rows = user_item_matrix(dataset.raw.join(users, Columns.User, "left_semi"))
        lists = rows.groupBy(Columns.User).agg(F.collect_list(F.struct(Columns.Item, Columns.Weight)).alias("h"))
        item_kind, user_kind = rows.schema[Columns.Item].dataType, rows.schema[Columns.User].dataType
        schema = T.StructType([T.StructField(Columns.User, user_kind), T.StructField(Columns.Item, item_kind), T.StructField(Columns.Score, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for user, history in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = [place[h[Columns.Item]] for h in history if h[Columns.Item] in place]
                    x = np.array([h[Columns.Weight] for h in history if h[Columns.Item] in place])
                    score = weights[:, at] @ x if at else np.zeros(len(names))
                    score = np.where(allowed, np.round(score, 12), -np.inf)
                    if filter_viewed:
                        score[at] = -np.inf
                    n = min(k, int(np.isfinite(score).sum()))
                    best = np.argsort(-score, kind="stable")[:n]
                    out[0].extend([user] * n)
                    out[1].extend(names[i] for i in best)
                    out[2].extend(score[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], batch.column(1).type.value_type.field(0).type), pa.array(out[2], pa.float64())], schema.fieldNames())

        return lists.mapInArrow(run, schema)

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        rows = self.tables["rows"].join(targets, Columns.TargetItem, "left_semi").select(Columns.TargetItem, F.posexplode("weights").alias("j", Columns.Score))
        spark = targets.sparkSession
        kind = self.tables["rows"].schema[0].dataType
        names = spark.createDataFrame(list(enumerate(self.names)), T.StructType([T.StructField("j", T.IntegerType()), T.StructField(Columns.Item, kind)]))
        reco = rows.join(F.broadcast(names), "j").select(Columns.TargetItem, Columns.Item, Columns.Score)
        return reco if items is None else reco.join(items, Columns.Item, "left_semi")
