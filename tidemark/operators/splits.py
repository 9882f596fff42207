"""Splits of interactions into train and test folds, without leaks.

A fold is two lazy tables of the same interactions; nothing is indexed by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.runtime import dense_index, md5_long
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset
from tidemark.sources.interactions import typed, with_row_order


#: Rows up to which a random order is found in one task.
SHORT = 1 << 22


@dataclass
class Fold:
    train: DataFrame
    test: DataFrame
    info: dict

    def stats(self) -> dict:
        """info with the sizes of both sides: two aggregates, run on demand."""
        out = dict(self.info)
        for name, df in (("train", self.train), ("test", self.test)):
            row = df.agg(F.count("*"), F.countDistinct(Columns.User), F.countDistinct(Columns.Item)).first()
            out |= {name: row[0], f"{name}_users": row[1], f"{name}_items": row[2]}
        return out

    def stats_table(self) -> DataFrame:
        """The same as a one-row table, lazily."""
        sides = [df.agg(F.count("*").alias(n), F.countDistinct(Columns.User).alias(f"{n}_users"), F.countDistinct(Columns.Item).alias(f"{n}_items")) for n, df in (("train", self.train), ("test", self.test))]
        return sides[0].crossJoin(sides[1]).withColumn(Columns.Split, F.lit(self.info[Columns.Split]))  # one row each


def get_not_seen(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose (user, item) pair train lacks."""
    return test.join(train.select(*Columns.UserItem).distinct(), Columns.UserItem, "left_anti")


class Splitter:
    def __init__(self, filter_cold_users: bool = True, filter_cold_items: bool = True, filter_already_seen: bool = True):
        self.filter_cold_users, self.filter_cold_items, self.filter_already_seen = filter_cold_users, filter_cold_items, filter_already_seen

    def filter(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Cold users, then cold items, then seen pairs leave the test rows; the first two are judged by all train rows."""
        if self.filter_cold_users:
            test = test.join(train.select(Columns.User).distinct(), Columns.User, "left_semi")
        if self.filter_cold_items:
            test = test.join(train.select(Columns.Item).distinct(), Columns.Item, "left_semi")
        return get_not_seen(train, test) if self.filter_already_seen else test

    def _folds(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, dict]]:
        raise NotImplementedError

    def split(self, interactions: DataFrame | Dataset) -> Iterator[Fold]:
        """Folds, oldest first."""
        df = interactions.raw if isinstance(interactions, Dataset) else typed(with_row_order(interactions))
        for i, (train, test, info) in enumerate(self._folds(df)):
            columns = df.columns
            yield Fold(train.select(*columns), self.filter(train, test).select(*columns), {Columns.Split: i, **info})


class TimeRangeSplitter(Splitter):
    """n_splits test windows of test_size ('7D', '12H') that end with the last full unit; train is all before a window."""

    def __init__(self, test_size: str, n_splits: int = 1, filter_cold_users: bool = True, filter_cold_items: bool = True, filter_already_seen: bool = True):
        super().__init__(filter_cold_users, filter_cold_items, filter_already_seen)
        if not re.fullmatch(r"[1-9]\d*[DH]", test_size):
            raise ValueError("`test_size` must be like '7D' or '12H'")
        if n_splits <= 0:
            raise ValueError("`n_splits` must be positive")
        self.test_size, self.n_splits = test_size, n_splits

    def get_test_fold_borders(self, df: DataFrame) -> list[tuple[datetime, datetime]]:
        """[start, end) of the windows, oldest first. A last moment that lies on a border opens a further unit."""
        size, unit = int(self.test_size[:-1]), self.test_size[-1]
        # Texts and not Python times cross over, so the session's time zone need not be the driver's.
        text = df.agg(F.date_format(F.date_trunc("day" if unit == "D" else "hour", F.max(Columns.Datetime)), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if text is None:
            return []
        last = datetime.fromisoformat(text)
        step = timedelta(days=1) if unit == "D" else timedelta(hours=1)
        end = last + step
        return [(end - step * size * (i + 1), end - step * size * i) for i in reversed(range(self.n_splits))]

    def _folds(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, dict]]:
        for start, end in self.get_test_fold_borders(df):
            when, kind = F.col(Columns.Datetime), df.schema[Columns.Datetime].dataType
            low, high = (F.lit(x.isoformat(" ")).cast(kind) for x in (start, end))
            yield df.where(when < low), df.where((when >= low) & (when < high)), {"start": start, "end": end}


class LastNSplitter(Splitter):
    """Fold i tests the n interactions of each user that i * n later ones follow; train is all before them."""

    def __init__(self, n: int, n_splits: int = 1, filter_cold_users: bool = True, filter_cold_items: bool = True, filter_already_seen: bool = True):
        super().__init__(filter_cold_users, filter_cold_items, filter_already_seen)
        if n <= 0 or n_splits <= 0:
            raise ValueError("`n` and `n_splits` must be positive")
        self.n, self.n_splits = n, n_splits

    def _folds(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, dict]]:
        late = "_datetime_ns" if "_datetime_ns" in df.columns else Columns.Datetime
        order = Window.partitionBy(Columns.User).orderBy(F.col(late).desc(), F.col(Columns.Row).desc(), F.col(Columns.Item).desc(), F.col(Columns.Weight).desc())
        ranked = df.withColumn("__last", F.row_number().over(order))
        for i in reversed(range(self.n_splits)):
            yield ranked.where(F.col("__last") > (i + 1) * self.n), ranked.where((F.col("__last") > i * self.n) & (F.col("__last") <= (i + 1) * self.n)), {}


class RandomSplitter(Splitter):
    """Disjoint test folds of round(test_fold_frac * rows), drawn by a seeded hash of the row order."""

    def __init__(self, test_fold_frac: float, n_splits: int = 1, random_state: int | None = None, filter_cold_users: bool = True, filter_cold_items: bool = True, filter_already_seen: bool = True):
        super().__init__(filter_cold_users, filter_cold_items, filter_already_seen)
        if not 0.0 < test_fold_frac < 1.0:
            raise ValueError("`test_fold_frac` must be between 0 and 1")
        if n_splits <= 0:
            raise ValueError("`n_splits` must be positive")
        if test_fold_frac * n_splits > 1:
            raise ValueError("The folds hold more than all interactions")
        self.test_fold_frac, self.n_splits, self.random_state = test_fold_frac, n_splits, random_state

    def _folds(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, dict]]:
        n = df.count()
        size = round(self.test_fold_frac * n)
        if size == 0:
            raise ValueError("The test folds would be empty")
        drawn = df.withColumn("__key", md5_long(F.lit(self.random_state or 0), Columns.Row, *Columns.UserItem))
        ties = ["__key", Columns.Row, *Columns.UserItem, Columns.Weight]
        if n > SHORT:
            # The hash, scaled to the number of rows, cuts them into even ranges that are ordered in parallel.
            drawn = dense_index(drawn.withColumn("__range", (F.col("__key") / float(1 << 60) * n).cast("long")), "__range", ties, "__place")
        else:
            drawn = drawn.withColumn("__place", F.row_number().over(Window.orderBy(*ties)) - 1)
        for i in range(self.n_splits):
            test = (F.col("__place") >= i * size) & (F.col("__place") < (i + 1) * size)
            yield drawn.where(~test), drawn.where(test), {}


def leave_one_out(interactions: DataFrame, val_users: int | list | DataFrame | None = None, seed: int = 32) -> DataFrame:
    """The last interaction of each user: of all, of given ones, or of a given number of users drawn by hash."""
    df = with_row_order(interactions)
    if isinstance(val_users, DataFrame):
        df = df.join(val_users.select(Columns.User).distinct(), Columns.User, "left_semi")
    elif isinstance(val_users, list):
        df = df.where(F.col(Columns.User).isin(val_users))
    elif val_users is not None:
        chosen = df.select(Columns.User).distinct().orderBy(md5_long(F.lit(seed), Columns.User), Columns.User).limit(val_users)
        df = df.join(chosen, Columns.User, "left_semi")
    key = F.struct(*[F.col(c) for c in (Columns.Datetime, Columns.Row, Columns.Item)], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.groupBy(Columns.User).agg(F.max(key).alias("k")).select("k.row.*")
