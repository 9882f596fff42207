"""The contract of all models: fit, recommend for users, recommend for items, configs and persistence."""

from __future__ import annotations

import inspect
import json
import warnings
from collections.abc import Iterable
from datetime import datetime, timedelta
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.runtime import calm_blas, table_of
from tidemark.functions.scalar import full_path, import_object, make_dict_flat, unflatten_dict
from tidemark.operators.rank import with_rank
from tidemark.schema import Columns, NotFittedError
from tidemark.sources.dataset import Dataset

Ids = DataFrame | Iterable


def _plain(value: Any) -> Any:
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, timedelta):
        return {"days": value.days, "seconds": value.seconds, "microseconds": value.microseconds}
    if isinstance(value, datetime):
        return value.isoformat()
    if inspect.isfunction(value):
        return full_path(value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


class ModelBase:
    """Subclasses take their parameters in __init__ under the names of their attributes, and implement the _ methods over
    tables with external ids: _u2i(users, dataset, k, filter_viewed, items), _i2i(targets, dataset, k, items), and where
    supported _u2i_warm, _i2i_warm and _cold(targets, column, dataset, k, items). They return column, item_id, score and,
    if the order is not by score, rank."""

    recommends_for_warm = False
    recommends_for_cold = False
    verbose = 0

    def __init__(self) -> None:
        self.is_fitted = False

    # Configs.

    @classmethod
    def _parameters(cls) -> list[str]:
        return [p for p in inspect.signature(cls.__init__).parameters if p not in ("self", "verbose")]

    def get_config(self, simple_types: bool = False) -> dict[str, Any]:
        out: dict[str, Any] = {"cls": full_path(type(self)) if simple_types else type(self)}
        for p in self._parameters():
            value = getattr(self, p)
            out[p] = _plain(value) if simple_types else value
        return out | {"verbose": self.verbose}

    def get_params(self, simple_types: bool = False, sep: str = ".") -> dict[str, Any]:
        return make_dict_flat(self.get_config(simple_types), sep)

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> ModelBase:
        config = dict(config)
        named = config.pop("cls", None)
        named = import_object(named) if isinstance(named, str) else named
        if named is not None and named is not cls:
            raise TypeError(f"`{cls.__name__}` can't be made from a config of `{named.__name__}`")
        unknown = set(config) - {*cls._parameters(), "verbose"}
        if unknown:
            raise ValueError(f"Unknown config keys {sorted(unknown)}")
        verbose = config.pop("verbose", 0)
        period, begin = config.get("period"), config.get("begin_from")
        if isinstance(period, dict):
            config["period"] = timedelta(**period)
        if isinstance(begin, str):
            config["begin_from"] = datetime.fromisoformat(begin)
        model = cls(**config)
        model.verbose = verbose
        return model

    @classmethod
    def from_params(cls, params: dict[str, Any], sep: str = ".") -> ModelBase:
        return cls.from_config(unflatten_dict(params, sep))

    # Persistence: a folder with config.json and a Parquet table for each fitted table.

    def _tables(self) -> dict[str, DataFrame]:
        """The fitted state."""
        return dict(getattr(self, "tables", {}))

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        session = spark or SparkSession.getActiveSession()
        assert session is not None
        names = sorted(self._tables())
        head = json.dumps({"config": self.get_config(simple_types=True), "tables": names, "fitted": self.is_fitted, "state": getattr(self, "state", {})})
        session.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
        for name in names:
            self._tables()[name].write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> ModelBase:
        model = load_model(path, spark)
        if not isinstance(model, cls):
            raise TypeError(f"The file holds a {type(model).__name__}")
        return model

    # Fitting and recommending.

    def fit(self, dataset: Dataset, *args: Any, **kwargs: Any) -> ModelBase:
        calm_blas()
        self._fit(dataset, *args, **kwargs)
        self.is_fitted = True
        return self

    def fit_partial(self, dataset: Dataset, *args: Any, **kwargs: Any) -> ModelBase:
        """Continues a fit where the model supports it."""
        calm_blas()
        self._fit_partial(dataset, *args, **kwargs)
        self.is_fitted = True
        return self

    def _fit(self, dataset: Dataset) -> None:
        raise NotImplementedError

    def _fit_partial(self, dataset: Dataset, *args: Any, **kwargs: Any) -> None:
        raise NotImplementedError(f"Partial fitting is not supported in {type(self).__name__}")

    def _check(self, k: int) -> None:
        if not self.is_fitted:
            raise NotFittedError(type(self).__name__)
        if k <= 0:
            raise ValueError("`k` must be positive integer")

    def _supported(self, targets: DataFrame, name: str, dataset: Dataset, policy: str) -> dict[str, DataFrame]:
        """Targets by temperature: hot ones occur in interactions, warm ones have features alone, cold ones neither."""
        if policy not in ("raise", "warn", "ignore"):
            raise ValueError("`on_unsupported_targets` must be one of 'raise', 'warn', 'ignore'")
        hot_ids, warm_ids = dataset.hot(name), dataset.warm(name)
        out = {"hot": targets.join(hot_ids, name, "left_semi")}
        rest = targets.join(hot_ids, name, "left_anti")
        if warm_ids is not None:
            warm = rest.join(warm_ids, name, "left_semi")
            rest = rest.join(warm_ids, name, "left_anti")
            if self.recommends_for_warm:
                out["warm"] = warm
            elif self.recommends_for_cold:
                rest = rest.unionByName(warm)
            else:
                self._refuse(warm, "warm", name, policy)
        if self.recommends_for_cold:
            out["cold"] = rest
        else:
            self._refuse(rest, "cold", name, policy)
        return out

    def _refuse(self, targets: DataFrame, kind: str, name: str, policy: str) -> None:
        if policy == "ignore" or targets.isEmpty():
            return
        message = f"Model `{type(self).__name__}` doesn't support recommendations for {kind} targets in {name}, but some are given"
        if policy == "raise":
            raise ValueError(message)
        warnings.warn(message, stacklevel=3)

    def _finish(self, parts: list[DataFrame], target: str, k: int, add_rank_col: bool) -> DataFrame:
        ranked = []
        for p in parts:
            p = p if Columns.Rank in p.columns else with_rank(p, target, k)
            ranked.append(p.select(target, Columns.Item, F.col(Columns.Score).cast("float").alias(Columns.Score), F.col(Columns.Rank).cast("int").alias(Columns.Rank)))
        out = ranked[0]
        for p in ranked[1:]:
            out = out.unionByName(p)
        out = out.where(F.col(Columns.Rank) <= k)
        return out if add_rank_col else out.drop(Columns.Rank)

    def recommend(
        self, users: Ids, dataset: Dataset, k: int, filter_viewed: bool, items_to_recommend: Ids | None = None, add_rank_col: bool = True, on_unsupported_targets: str = "raise",
        context: DataFrame | None = None,
    ) -> DataFrame:
        """user_id, item_id, score, rank: up to k items a user; ties to the smaller item."""
        self._check(k)
        spark = dataset.raw.sparkSession
        wanted = table_of(spark, users, Columns.User).distinct()
        items = None if items_to_recommend is None else table_of(spark, items_to_recommend, Columns.Item).distinct()
        if context is not None:
            self.context = context
        groups = self._supported(wanted, Columns.User, dataset, on_unsupported_targets)
        parts = [self._u2i(groups["hot"], dataset, k, filter_viewed, items)]
        if "warm" in groups:
            parts.append(self._u2i_warm(groups["warm"], dataset, k, items))
        if "cold" in groups:
            parts.append(self._cold(groups["cold"], Columns.User, dataset, k, items))
        return self._finish(parts, Columns.User, k, add_rank_col)

    def recommend_to_items(
        self, target_items: Ids, dataset: Dataset, k: int, filter_itself: bool = True, items_to_recommend: Ids | None = None, add_rank_col: bool = True, on_unsupported_targets: str = "raise"
    ) -> DataFrame:
        """target_item_id, item_id, score, rank: up to k items like each target."""
        self._check(k)
        spark = dataset.raw.sparkSession
        wanted = table_of(spark, target_items, Columns.Item).distinct()
        items = None if items_to_recommend is None else table_of(spark, items_to_recommend, Columns.Item).distinct()
        groups = self._supported(wanted, Columns.Item, dataset, on_unsupported_targets)
        target, more = Columns.TargetItem, k + 1 if filter_itself else k
        named = {n: g.withColumnRenamed(Columns.Item, target) for n, g in groups.items()}
        parts = [self._i2i(named["hot"], dataset, more, items)]
        if "warm" in named:
            parts.append(self._i2i_warm(named["warm"], dataset, more, items))
        if filter_itself:
            parts = [self._without_itself(p) for p in parts]
        if "cold" in named:
            parts.append(self._cold(named["cold"], target, dataset, k, items))
        return self._finish(parts, target, k, add_rank_col)

    @staticmethod
    def _without_itself(reco: DataFrame) -> DataFrame:
        other = reco.where(F.col(Columns.TargetItem) != F.col(Columns.Item))
        if Columns.Rank in reco.columns:
            own = reco.where(F.col(Columns.TargetItem) == F.col(Columns.Item)).select(Columns.TargetItem, F.col(Columns.Rank).alias("__own"))
            other = other.join(own, Columns.TargetItem, "left").withColumn(Columns.Rank, F.col(Columns.Rank) - F.coalesce((F.col("__own") < F.col(Columns.Rank)).cast("int"), F.lit(0))).drop("__own")
        return other

    def _u2i(self, users: DataFrame, dataset: Dataset, k: int, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    def _i2i(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    def _u2i_warm(self, users: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    def _i2i_warm(self, targets: DataFrame, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    def _cold(self, targets: DataFrame, column: str, dataset: Dataset, k: int, items: DataFrame | None) -> DataFrame:
        raise NotImplementedError


def model_from_config(config: dict[str, Any]) -> ModelBase:
    cls = config["cls"]
    return (import_object(cls) if isinstance(cls, str) else cls).from_config(config)


def model_from_params(params: dict[str, Any], sep: str = ".") -> ModelBase:
    return model_from_config(unflatten_dict(params, sep))


def load_model(path: str, spark: SparkSession | None = None) -> ModelBase:
    session = spark or SparkSession.getActiveSession()
    assert session is not None
    head = json.loads(session.read.text(f"{path}/config").first()[0])
    model = model_from_config(head["config"])
    model.state = head["state"]  # type: ignore[attr-defined]
    model._restore({n: session.read.parquet(f"{path}/{n}") for n in head["tables"]})
    model.is_fitted = head["fitted"]
    return model


def viewed(dataset: Dataset, users: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs of the users."""
    return dataset.raw.join(users, Columns.User, "left_semi").select(*Columns.UserItem).distinct()


def scored(reco: DataFrame, users: DataFrame, dataset: Dataset, filter_viewed: bool, items: DataFrame | None) -> DataFrame:
    """Applies whitelist and viewed filter to scored pairs before they are ranked."""
    if items is not None:
        reco = reco.join(items, Columns.Item, "left_semi")
    if filter_viewed:
        reco = reco.join(viewed(dataset, users), Columns.UserItem, "left_anti")
    return reco
