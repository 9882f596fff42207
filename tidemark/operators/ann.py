"""Neighbour lists over item vectors: items for users, items for items.

The index is the exact blocked ranker under cosine similarity, which at its best an approximate one equals; index_top_k, the
number of candidates asked for beyond top_n before truncation, is kept, as lists cut by availability depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.runtime import table_of
from tidemark.operators.rank import Distance, VectorRanker


class _Recommender:
    def __init__(self, item_vectors: DataFrame, index_top_k: int = 0, distance: Distance | str = Distance.COSINE):
        self.item_vectors, self.index_top_k, self.distance = item_vectors.select("id", "factors"), index_top_k, distance

    def fit(self) -> _Recommender:
        return self

    def _nearest(self, subjects: DataFrame, top_n: int) -> DataFrame:
        reco = VectorRanker(self.distance, subjects, self.item_vectors).rank(top_n + self.index_top_k, as_float=False)
        return reco.select(F.col("subject").alias("target"), F.col("object").alias("item_id"), "rank")

    @staticmethod
    def _truncate(candidates: DataFrame, top_n: int) -> DataFrame:
        kept = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("rank")))
        return kept.where(F.col("rank") <= top_n).select("target", "item_id", "rank")


class ItemToItemAnnRecommender(_Recommender):
    def get_item_list_for_item_batch(self, items: object, top_n: int, available_items: DataFrame | None = None) -> DataFrame:
        """target, item_id, rank. An item is not its own neighbour. With available_items (target, item_id), lists hold those
        alone, and none of the batch's own items."""
        wanted = table_of(self.item_vectors.sparkSession, items, "id").distinct()
        found = self._nearest(self.item_vectors.join(wanted, "id", "left_semi"), top_n)
        if available_items is not None:
            found = found.join(available_items.select("target", "item_id").distinct(), ["target", "item_id"], "left_semi")
            found = found.join(wanted.withColumnRenamed("id", "item_id"), "item_id", "left_anti")
        else:
            found = found.where(F.col("target") != F.col("item_id"))
        return self._truncate(found, top_n)

    def get_item_list_for_item(self, item: object, top_n: int, available_items: list | None = None) -> list:
        spark = self.item_vectors.sparkSession
        allowed = None if available_items is None else table_of(spark, available_items, "item_id").crossJoin(F.broadcast(table_of(spark, [item], "target")))  # one row
        return [r["item_id"] for r in self.get_item_list_for_item_batch([item], top_n, allowed).orderBy("rank").collect()]


class UserToItemAnnRecommender(_Recommender):
    def __init__(self, user_vectors: DataFrame, item_vectors: DataFrame, index_top_k: int = 0, distance: Distance | str = Distance.COSINE):
        super().__init__(item_vectors, index_top_k, distance)
        self.user_vectors = user_vectors.select("id", "factors")

    def get_item_list_for_user_batch(self, users: object, top_n: int, available_items: DataFrame | None = None) -> DataFrame:
        wanted = table_of(self.user_vectors.sparkSession, users, "id").distinct()
        found = self._nearest(self.user_vectors.join(wanted, "id", "left_semi"), top_n)
        if available_items is not None:
            found = found.join(available_items.select("target", "item_id").distinct(), ["target", "item_id"], "left_semi")
        return self._truncate(found, top_n)

    def get_item_list_for_user(self, user: object, top_n: int, available_items: list | None = None) -> list:
        spark = self.item_vectors.sparkSession
        allowed = None if available_items is None else table_of(spark, available_items, "item_id").crossJoin(F.broadcast(table_of(spark, [user], "target")))  # one row
        return [r["item_id"] for r in self.get_item_list_for_user_batch([user], top_n, allowed).orderBy("rank").collect()]
