"""Shared intermediates of metrics: merges, per-user hit lists, debiasing."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.runtime import md5_long
from tidemark.schema import Columns, require


@dataclass(frozen=True)
class DebiasConfig:
    """Items beyond Q3 + iqr_coef * IQR of users per item keep that many rows."""

    iqr_coef: float = 1.5
    random_state: int | None = None


@dataclass(frozen=True)
class MetricAtK:
    """A metric over the first k recommendations of each user."""

    k: int

    #: What calc() takes after the recommendations, in order.
    inputs: ClassVar[tuple[str, ...]] = ("interactions",)

    def __post_init__(self) -> None:
        if not isinstance(self.k, int) or self.k <= 0:
            raise ValueError("`k` must be a positive integer")

    def _named(self, args: tuple, kwargs: dict) -> dict:
        return dict(zip(self.inputs, args, strict=False)) | kwargs

    def calc(self, reco: DataFrame, *args: object, **kwargs: object) -> float:
        """The metric's value: the mean over users, where it has values by user."""
        from tidemark.plans.metrics import calc_metrics

        return next(iter(calc_metrics({"value": self}, reco, **self._named(args, kwargs)).values()))

    def calc_per_user(self, reco: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        """user_id, value."""
        from tidemark.plans.metrics import calc_per_user

        return calc_per_user({"value": self}, reco, **self._named(args, kwargs))


def check_reco(reco: DataFrame) -> None:
    require(reco.columns, [*Columns.UserItem, Columns.Rank])


def merge_reco(reco: DataFrame, interactions: DataFrame) -> DataFrame:
    """Test interactions with the rank of their recommendation, null if there is none; nothing is de-duplicated."""
    check_reco(reco)
    require(interactions.columns, Columns.UserItem)
    return interactions.select(*Columns.UserItem).join(reco.select(*Columns.UserItem, Columns.Rank), Columns.UserItem, "left")


def outer_merge_reco(reco: DataFrame, interactions: DataFrame) -> DataFrame:
    """Distinct test pairs and the recommendations of test users, with rows for the ranks that a user's list leaves out."""
    check_reco(reco)
    test = interactions.select(*Columns.UserItem).distinct().withColumn("__test_positive", F.lit(True))
    own = reco.select(*Columns.UserItem, Columns.Rank).join(test.select(Columns.User).distinct(), Columns.User, "left_semi")
    both = test.join(own, Columns.UserItem, "full_outer")
    ranks = own.groupBy(Columns.User).agg(F.max(Columns.Rank).cast("int").alias("m")).select(Columns.User, F.explode(F.expr("sequence(1, m)")).alias(Columns.Rank))
    return both.join(ranks, [Columns.User, Columns.Rank], "full_outer").withColumn("__test_positive", F.coalesce("__test_positive", F.lit(False)))


def debias_border(interactions: DataFrame, config: DebiasConfig) -> DataFrame:
    """One row: the most rows an item keeps, from exact quartiles of its number of users."""
    users = interactions.groupBy(Columns.Item).agg(F.countDistinct(Columns.User).alias("n"))
    quartiles = users.agg(F.expr("percentile(n, 0.25)").alias("q1"), F.expr("percentile(n, 0.75)").alias("q3"))
    return quartiles.select(F.floor(F.col("q3") + config.iqr_coef * (F.col("q3") - F.col("q1"))).alias("border"))


def debias_interactions(interactions: DataFrame, config: DebiasConfig) -> DataFrame:
    """Rows of items with more users than the border allows are drawn by a seeded hash until `border` of them are left."""
    users = interactions.groupBy(Columns.Item).agg(F.countDistinct(Columns.User).alias("__n"))
    over = users.crossJoin(F.broadcast(debias_border(interactions, config))).where(F.col("__n") > F.col("border")).select(Columns.Item, F.col("border").alias("__border"))  # the border is one row
    columns = interactions.columns
    key = md5_long(F.lit(config.random_state or 0), *Columns.UserItem)
    joined = interactions.join(over, Columns.Item, "left")
    rank = F.row_number().over(Window.partitionBy(Columns.Item).orderBy(key, Columns.User, *[c for c in columns if c not in Columns.UserItem]))
    # Only rows of items beyond the border are sorted.
    cut = joined.where(F.col("__border").isNotNull()).withColumn("__r", rank).where(F.col("__r") <= F.col("__border"))
    return joined.where(F.col("__border").isNull()).select(*columns).unionByName(cut.select(*columns))


def hit_lists(reco: DataFrame, interactions: DataFrame, k_max: int) -> DataFrame:
    """One row a test user: hits (ascending ranks up to k_max of test rows, repeated ones too), n_relevant (test rows)."""
    return hit_lists_of(merge_reco(reco.where(F.col(Columns.Rank) <= k_max), interactions), k_max)


def hit_lists_of(merged: DataFrame, k_max: int) -> DataFrame:
    """The same from merged rows; ranks beyond k_max are left out of the lists."""
    return merged.withColumn(Columns.Rank, F.when(F.col(Columns.Rank) <= k_max, F.col(Columns.Rank))).groupBy(Columns.User).agg(
        F.sort_array(F.collect_list(F.round(Columns.Rank).cast("int"))).alias("hits"), F.count("*").alias("n_relevant")
    )


def auc_lists(reco: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row a test user: positives (ascending ranks of distinct hits), n_pos (distinct test items), max_rank.

    All ranks from 1 to max_rank that are no hit count as false positives, whether the list holds them or leaves them out."""
    test = interactions.select(*Columns.UserItem).distinct()
    own = reco.select(*Columns.UserItem, F.col(Columns.Rank).cast("int").alias(Columns.Rank))
    both = test.withColumn("t", F.lit(1)).unionByName(own, allowMissingColumns=True)
    pairs = both.groupBy(*Columns.UserItem).agg(F.max("t").alias("t"), F.min(Columns.Rank).alias(Columns.Rank))
    hit = F.col("t").isNotNull()
    return (
        pairs.groupBy(Columns.User)
        .agg(F.sort_array(F.collect_list(F.when(hit, F.col(Columns.Rank)))).alias("positives"), F.count("t").alias("n_pos"), F.coalesce(F.max(Columns.Rank), F.lit(0)).alias("max_rank"))
        .where("n_pos > 0")
    )


def count_to(array: str, k: int) -> Column:
    return F.expr(f"size(filter({array}, x -> x <= {k}))")


def calc_confusions(merged: DataFrame, k: int) -> DataFrame:
    """user_id, liked, tp, fp, fn of merged rows. False positives count up to k, however few items were recommended."""
    lists = hit_lists_of(merged, k).select(Columns.User, F.col("n_relevant").alias("liked"), F.size("hits").alias("tp"))
    return lists.withColumns({"fp": F.lit(k) - F.col("tp"), "fn": F.col("liked") - F.col("tp")})


def make_confusions(reco: DataFrame, interactions: DataFrame, k: int) -> DataFrame:
    return calc_confusions(merge_reco(reco, interactions), k)
