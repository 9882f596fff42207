"""Popularity models: one list for all users, one list a category, and random lists.

A list of items is ordered once; what a user gets is a set of places in it. A user's viewed items become an array of places,
and the first k places that it leaves out are found by array functions: one aggregate over the history of the users asked
for, and no join of users with items.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.runtime import BROADCAST_ROWS, cut, dense_index, md5_long, small
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset

from .base import ModelBase


class Popularity(str, Enum):
    N_USERS = "n_users"
    N_INTERACTIONS = "n_interactions"
    MEAN_WEIGHT = "mean_weight"
    SUM_WEIGHT = "sum_weight"


#: Lists that are no longer than this are ordered in one task; longer ones by ranges.
SHORT_LIST = 2_000_000


def popularity_column(kind: Popularity) -> Column:
    return {
        Popularity.N_USERS: F.countDistinct(Columns.User), Popularity.N_INTERACTIONS: F.count("*"), Popularity.MEAN_WEIGHT: F.avg(Columns.Weight), Popularity.SUM_WEIGHT: F.sum(Columns.Weight),
    }[kind].cast("double")


def in_period(df: DataFrame, period: timedelta | None, begin_from: datetime | None) -> DataFrame:
    when = F.col(Columns.Datetime)
    if begin_from is not None:
        return df.where(when >= F.lit(begin_from.isoformat(" ")).cast(df.schema[Columns.Datetime].dataType))
    if period is None:
        return df
    last = df.agg(F.max(Columns.Datetime).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(when >= F.col("__last") - F.lit(period)).drop("__last")  # one row


def check_period(period: timedelta | None, begin_from: datetime | None) -> None:
    if period is not None and begin_from is not None:
        raise ValueError("Only one of `period` and `begin_from` can be set")


def places(order: DataFrame, inverse: bool, length: int | None) -> DataFrame:
    """item_id, score, place: the first `length` items (all if None), places from 1."""
    keys = [F.col(Columns.Score).asc(), F.col(Columns.Item).desc()] if inverse else [F.col(Columns.Score).desc(), F.col(Columns.Item).asc()]
    if length is not None:
        order = order.orderBy(*keys).limit(length)  # a distributed top-k: the window sees what is left
    return order.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def first_free(users: DataFrame, taken: DataFrame | None, k: int, n: Column | int, *, by: str = Columns.User) -> DataFrame:
    """by, place, rank: each user's first k places in 1..n that `taken` (by, place) lacks."""
    limit = F.lit(n) if isinstance(n, int) else n
    if taken is None:
        ranks = users.withColumn("p", F.sequence(F.lit(1), F.least(F.lit(k), limit)))
    else:
        seen = taken.groupBy(by).agg(F.collect_set("place").alias("seen"))
        ranks = users.join(seen, by, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
        ranks = ranks.withColumn("p", F.slice(F.array_except(F.sequence(F.lit(1), F.least(F.lit(k) + F.size("seen"), limit)), F.col("seen")), 1, k))
    ranks = ranks.where(limit > 0) if not isinstance(n, int) else ranks.where(F.lit(n > 0))
    return ranks.select(by, F.posexplode("p").alias("i", "place")).select(by, "place", (F.col("i") + 1).alias(Columns.Rank))


class PopularModel(ModelBase):
    recommends_for_cold = True

    def __init__(self, popularity: str | Popularity = Popularity.N_USERS, period: timedelta | None = None, begin_from: datetime | None = None, add_cold: bool = False, inverse: bool = False, verbose: int = 0):
        super().__init__()
        check_period(period, begin_from)
        self.popularity, self.period, self.begin_from, self.add_cold, self.inverse, self.verbose = Popularity(popularity), period, begin_from, add_cold, inverse, verbose

    def scores_of(self, interactions: DataFrame) -> DataFrame:
        return interactions.groupBy(Columns.Item).agg(popularity_column(self.popularity).alias(Columns.Score))

    def _fit(self, dataset: Dataset) -> None:
        scores = self.scores_of(in_period(dataset.raw, self.period, self.begin_from))
        if self.add_cold:
            everything = dataset.item_id_map.table.select(F.col("external").alias(Columns.Item))
            scores = scores.unionByName(everything.join(scores, Columns.Item, "left_anti").withColumn(Columns.Score, F.lit(0.0)))
        self.tables = {"scores": scores}

    def _scores(self, items: DataFrame | None) -> DataFrame:
        scores = self.tables["scores"]
        return scores if items is None else scores.join(items, Columns.Item, "left_semi")

    def _order(self, items: DataFrame | None, length: int | None) -> DataFrame:
        return places(self._scores(items), self.inverse, length)

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        if not filter_viewed:
            return self._cold(users, Columns.User, dataset, k, items)
        history = dataset.raw.join(users, Columns.User, "left_semi").select(*Columns.UserItem)
        scores = cut(self._scores(items))
        n, length = scores.count(), None
        if n > SHORT_LIST:
            # No user needs places beyond k + (items he viewed).
            length = k + history.groupBy(Columns.User).agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
            n = min(n, length)
        order = places(scores, self.inverse, length)
        order = F.broadcast(order) if n <= BROADCAST_ROWS else order
        free = first_free(users, history.join(order.select(Columns.Item, "place"), Columns.Item), k, n)
        return free.join(order, "place").select(Columns.User, Columns.Item, Columns.Score, Columns.Rank)

    def _cold(self, targets: DataFrame, column: str, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        order = self._order(items, k)
        rows = order.agg(F.collect_list(F.struct("place", Columns.Item, Columns.Score)).alias("l"))  # k items
        listed = targets.crossJoin(F.broadcast(rows)).select(column, F.inline("l"))  # the list is one row
        return listed.select(column, Columns.Item, Columns.Score, F.col("place").alias(Columns.Rank))

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        return self._cold(targets, Columns.TargetItem, dataset, k, items)


class RandomModel(ModelBase):
    """Items without replacement, uniformly, scores k..1. Every user has a permutation of the item list (place * a + b modulo
    the next prime, a and b drawn by MD5 from seed, call and user), so no list is shuffled. Calls differ; a call repeats."""

    recommends_for_cold = True

    def __init__(self, random_state: int | None = None, verbose: int = 0):
        super().__init__()
        self.random_state, self.verbose, self.calls = random_state, verbose, 0

    def _fit(self, dataset: Dataset) -> None:
        self.tables = {"items": dataset.hot(Columns.Item)}

    def _lists(self, targets: DataFrame, column: str, k: int, items: DataFrame | None, taken: DataFrame | None) -> DataFrame:
        pool = self.tables["items"]
        if items is not None:
            pool = pool.join(items, Columns.Item, "left_semi")
        n = pool.count()
        if n == 0:
            return targets.where(F.lit(False)).select(column, F.lit(None).cast(pool.schema[0].dataType).alias(Columns.Item), F.lit(0.0).alias(Columns.Score), F.lit(0).alias(Columns.Rank))
        numbered = places(pool.withColumn(Columns.Score, F.lit(0.0)), False, None) if n <= SHORT_LIST else dense_index(pool.withColumn("z", F.shiftright(md5_long(Columns.Item), 30)), "z", [Columns.Item], "place", 1)
        numbered = small(numbered.select(Columns.Item, F.col("place").cast("long").alias("place")))
        p = next(x for x in range(n, 2 * n + 3) if x > 1 and all(x % d for d in range(2, int(x**0.5) + 1)))
        seed, call = F.lit(self.random_state or 0), F.lit(self.calls)
        self.calls += 1
        a = F.pmod(md5_long(seed, call, F.lit("a"), column), F.lit(p - 1)) + 1
        b = F.pmod(md5_long(seed, call, F.lit("b"), column), F.lit(p))
        own = targets.withColumns({"a": a, "b": b})
        if taken is not None:
            seen = taken.join(numbered, Columns.Item).groupBy(column).agg(F.collect_set("place").alias("seen"))
            own = own.join(seen, column, "left")
        else:
            own = own.withColumn("seen", F.lit(None).cast("array<bigint>"))
        own = own.withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
        # p - n places of the permutation lie beyond the list, and viewed ones are passed over.
        drawn = f"transform(sequence(0, least(cast({p} as int), {k + p - n} + size(seen)) - 1), i -> (cast(i as bigint) * a + b) % {p} + 1)"
        own = own.withColumn("p", F.expr(f"slice(array_except(filter({drawn}, x -> x <= {n}), seen), 1, {k})"))
        listed = own.select(column, F.size("p").alias("m"), F.posexplode("p").alias("i", "place"))
        return listed.join(numbered, "place").select(column, Columns.Item, (F.col("m") - F.col("i")).cast("double").alias(Columns.Score), (F.col("i") + 1).alias(Columns.Rank))

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        taken = dataset.raw.join(users, Columns.User, "left_semi").select(*Columns.UserItem) if filter_viewed else None
        return self._lists(users, Columns.User, k, items, taken)

    def _cold(self, targets: DataFrame, column: str, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        return self._lists(targets, column, k, items, None)

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        return self._lists(targets, Columns.TargetItem, k, items, None)


class MixingStrategy(str, Enum):
    ROTATE = "rotate"
    GROUP = "group"


class RatioStrategy(str, Enum):
    PROPORTIONAL = "proportional"
    EQUAL = "equal"


class PopularInCategoryModel(ModelBase):
    """Lists by the values of one categorical item feature; k is shared out among the categories by their popularity."""

    recommends_for_cold = True

    def __init__(
        self, category_feature: str, n_categories: int | None = None, mixing_strategy: str | MixingStrategy = MixingStrategy.ROTATE, ratio_strategy: str | RatioStrategy = RatioStrategy.PROPORTIONAL,
        popularity: str | Popularity = Popularity.N_USERS, period: timedelta | None = None, begin_from: datetime | None = None, add_cold: bool = False, inverse: bool = False, verbose: int = 0,
    ):
        super().__init__()
        check_period(period, begin_from)
        if n_categories is not None and n_categories <= 0:
            raise ValueError("`n_categories` must be a positive integer")
        self.category_feature, self.n_categories = category_feature, n_categories
        self.mixing_strategy, self.ratio_strategy = MixingStrategy(mixing_strategy), RatioStrategy(ratio_strategy)
        self.popularity, self.period, self.begin_from, self.add_cold, self.inverse, self.verbose = Popularity(popularity), period, begin_from, add_cold, inverse, verbose

    def _fit(self, dataset: Dataset) -> None:
        frame = dataset.frames[Columns.Item]
        if frame is None:
            raise ValueError("Dataset must have `item_features_df` for PopularInCategoryModel")
        if dataset.dense[Columns.Item]:
            raise TypeError("Only sparse features are supported for PopularInCategoryModel")
        if self.category_feature not in dataset.cats[Columns.Item]:
            raise ValueError("`category_feature` must be present in `cat_item_features` when creating Dataset")
        id_col = dataset._id_col(frame, Columns.Item)
        pairs = frame.where(F.col("feature") == self.category_feature).select(F.col(id_col).alias(Columns.Item), F.col("value").cast("string").alias("category")).distinct()
        rows = in_period(dataset.raw, self.period, self.begin_from).join(small(pairs), Columns.Item)
        totals = rows.groupBy("category").agg(popularity_column(self.popularity).alias("total")).orderBy(F.col("total").desc(), "category").collect()  # one row a category
        if not totals:
            raise ValueError("`category_feature` must be present in `cat_item_features` when creating Dataset")
        kept = totals[: self.n_categories]
        self.state = {"categories": [r["category"] for r in kept], "totals": [r["total"] for r in kept]}
        scores = rows.where(F.col("category").isin(self.state["categories"])).groupBy("category", Columns.Item).agg(popularity_column(self.popularity).alias(Columns.Score))
        if self.add_cold:
            # Each category's list goes on with all items outside of it.
            everything = dataset.item_id_map.table.select(F.col("external").alias(Columns.Item), F.explode(F.array(*map(F.lit, self.state["categories"]))).alias("category"))
            scores = scores.unionByName(everything.join(scores, ["category", Columns.Item], "left_anti").withColumn(Columns.Score, F.lit(0.0)))
        self.tables = {"scores": scores}

    def quotas(self, k: int) -> list[int]:
        """Recommendations of each category, best category first."""
        totals = self.state["totals"]
        n = len(totals)
        if self.ratio_strategy is RatioStrategy.EQUAL:
            out = [k // n] * n
        else:
            whole = sum(totals)
            out = [int(k * t / whole + 1e-12) for t in totals]
        rest = k - sum(out)
        out = [x + (i < rest) for i, x in enumerate(out)]
        if self.ratio_strategy is RatioStrategy.PROPORTIONAL:
            empty, rich = [i for i, x in enumerate(out) if x == 0], [i for i, x in enumerate(out) if x > 1]
            moves = min(len(empty), len(rich))
            for i in empty[:moves]:
                out[i] = 1
            for i in rich[len(rich) - moves :]:
                out[i] -= 1
        return out

    def _mix(self, targets: DataFrame, column: str, k: int, items: DataFrame | None, history: DataFrame | None) -> DataFrame:
        quotas = self.quotas(k)
        scores = self.tables["scores"]
        if items is not None:
            scores = scores.join(items, Columns.Item, "left_semi")
        entries = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("priority"), F.lit(q).alias("quota")) for i, (c, q) in enumerate(zip(self.state["categories"], quotas))])
        keys = [F.col(Columns.Score).asc(), F.col(Columns.Item).desc()] if self.inverse else [F.col(Columns.Score).desc(), F.col(Columns.Item).asc()]
        listed = scores.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*keys)))
        sizes = listed.groupBy("category").agg(F.max("place").alias("n"))
        by_category = targets.select(column, F.inline(entries)).join(F.broadcast(sizes), "category")  # one row a category
        key = F.struct(F.col(column), F.col("category"))
        asked = by_category.withColumn("key", key)
        if history is not None:
            listed = cut(listed)
            n = listed.count()
            if n > SHORT_LIST:
                most = history.groupBy(column).agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
                listed = listed.where(F.col("place") <= k + most)
            listed = F.broadcast(listed) if n <= BROADCAST_ROWS else listed
            taken = history.join(listed, Columns.Item).withColumn("key", key).select("key", "place").distinct()
            seen = taken.groupBy("key").agg(F.collect_set("place").alias("seen"))
            asked = asked.join(seen, "key", "left")
        else:
            listed = listed.where(F.col("place") <= k)
            asked = asked.withColumn("seen", F.lit(None).cast("array<int>"))
        asked = asked.withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
        asked = asked.withColumn("p", F.slice(F.array_except(F.sequence(F.lit(1), F.least(F.lit(k) + F.size("seen"), F.col("n"))), F.col("seen")), 1, k))
        rows = asked.select(column, "category", "priority", "quota", F.posexplode("p").alias("category_rank", "place"))
        rows = rows.join(listed, ["category", "place"])
        rows = rows.withColumn("main", F.col("category_rank") < F.col("quota"))
        # An item counts once: its main row of the best category, or else its fallback row of the best category.
        once = Window.partitionBy(column, Columns.Item).orderBy(F.col("main").desc(), "priority")
        rows = rows.withColumn("__o", F.row_number().over(once)).where("__o = 1")
        chosen = Window.partitionBy(column).orderBy(F.col("main").desc(), "category_rank", "priority")
        rows = rows.withColumn("__k", F.row_number().over(chosen)).where(F.col("__k") <= k)
        if self.mixing_strategy is MixingStrategy.GROUP:
            final = Window.partitionBy(column).orderBy("priority", "category_rank")
        else:
            # Main rows of a category keep their order; fallback rows come after them, as they do in the choice.
            rows = rows.withColumn("category_rank", F.row_number().over(Window.partitionBy(column, "priority").orderBy(F.col("main").desc(), "category_rank")))
            final = Window.partitionBy(column).orderBy("category_rank", "priority")
        return rows.withColumn(Columns.Rank, F.row_number().over(final)).select(column, Columns.Item, Columns.Score, Columns.Rank)

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        history = dataset.raw.join(users, Columns.User, "left_semi").select(*Columns.UserItem) if filter_viewed else None
        return self._mix(users, Columns.User, k, items, history)

    def _cold(self, targets: DataFrame, column: str, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        one = targets.sparkSession.range(1).select(F.lit(0).alias("__all"))
        listed = self._mix(one, "__all", k, items, None).agg(F.collect_list(F.struct(Columns.Item, Columns.Score, Columns.Rank)).alias("l"))
        return targets.crossJoin(F.broadcast(listed)).select(column, F.inline("l"))  # the list is one row

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        return self._cold(targets, Columns.TargetItem, dataset, k, items)
