"""Dataset: interactions, id maps and features of users and items.

Models read interactions with external ids, so nothing is numbered unless a caller asks for internal ids: the id maps and
the internal view are lazy plans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import Columns, require

from .features import DenseFeatures, Features, SparseFeatures
from .idmap import IdMap
from .interactions import Interactions, typed, user_item_matrix, with_row_order


class Dataset:
    def __init__(
        self, raw: DataFrame, user_features_df: DataFrame | None = None, item_features_df: DataFrame | None = None, cat_user_features: tuple[str, ...] = (),
        cat_item_features: tuple[str, ...] = (), make_dense_user_features: bool = False, make_dense_item_features: bool = False, keep_extra_cols: bool = False,
        user_id_map: IdMap | None = None, item_id_map: IdMap | None = None,
    ):
        require(raw.columns, Columns.Interactions)
        raw = typed(with_row_order(raw))
        hidden = [c for c in raw.columns if c.startswith("_")]
        self.extra_cols = [c for c in raw.columns if c not in Columns.Interactions and c not in hidden] if keep_extra_cols else []
        #: Interactions with external ids.
        self.raw = raw.select(*Columns.Interactions, *self.extra_cols, *hidden)
        self.frames = {Columns.User: user_features_df, Columns.Item: item_features_df}
        self.cats = {Columns.User: tuple(cat_user_features), Columns.Item: tuple(cat_item_features)}
        self.dense = {Columns.User: make_dense_user_features, Columns.Item: make_dense_item_features}
        self._maps = {Columns.User: user_id_map, Columns.Item: item_id_map}

    @classmethod
    def construct(
        cls, interactions_df: DataFrame, user_features_df: DataFrame | None = None, cat_user_features: tuple[str, ...] = (), make_dense_user_features: bool = False,
        item_features_df: DataFrame | None = None, cat_item_features: tuple[str, ...] = (), make_dense_item_features: bool = False, keep_extra_cols: bool = False,
    ) -> Dataset:
        return cls(interactions_df, user_features_df, item_features_df, cat_user_features, cat_item_features, make_dense_user_features, make_dense_item_features, keep_extra_cols)

    @staticmethod
    def _id_col(df: DataFrame, name: str) -> str:
        return name if name in df.columns else "id"

    def _id_map(self, name: str) -> IdMap:
        if (given := self._maps[name]) is not None:
            return given
        ids = IdMap.from_values(self.raw, name, Columns.Row)
        frame = self.frames[name]
        if frame is not None:
            frame = with_row_order(frame)
            ids = ids.add_ids(frame, self._id_col(frame, name), Columns.Row)
        return ids

    @cached_property
    def user_id_map(self) -> IdMap:
        return self._id_map(Columns.User)

    @cached_property
    def item_id_map(self) -> IdMap:
        return self._id_map(Columns.Item)

    def ids(self, name: str, rows: DataFrame) -> DataFrame:
        """The external ids of the id map, in no order; rows: the ids of the interactions, in a column of that name."""
        if (given := self._maps[name]) is not None:
            return given.table.select(F.col("external").alias(name))
        ids, frame = rows.select(name), self.frames[name]
        if frame is not None:
            ids = ids.unionAll(frame.select(F.col(self._id_col(frame, name)).alias(name)))
        return ids.where(F.col(name).isNotNull()).distinct()

    def features_of(self, name: str, ids: IdMap) -> Features | None:
        """Features under the ids of any map."""
        frame = self.frames[name]
        if frame is None:
            return None
        id_col = self._id_col(frame, name)
        if self.dense[name]:
            return DenseFeatures.from_dataframe(frame, ids, id_col)
        return SparseFeatures.from_flatten(frame, ids, self.cats[name], id_col)

    @cached_property
    def user_features(self) -> Features | None:
        return self.features_of(Columns.User, self.user_id_map)

    @cached_property
    def item_features(self) -> Features | None:
        return self.features_of(Columns.Item, self.item_id_map)

    @cached_property
    def interactions(self) -> Interactions:
        return Interactions.from_raw(self.raw, self.user_id_map, self.item_id_map, keep_extra_cols=True, strict=False)

    def hot(self, name: str) -> DataFrame:
        """External ids that occur in interactions."""
        return self.raw.select(name).distinct()

    def warm(self, name: str) -> DataFrame | None:
        """External ids with features alone."""
        frame = self.frames[name]
        if frame is None:
            return None
        return frame.select(F.col(self._id_col(frame, name)).alias(name)).distinct().join(self.hot(name), name, "left_anti")

    @property
    def n_hot_users(self) -> int:
        return self.hot(Columns.User).count()

    @property
    def n_hot_items(self) -> int:
        return self.hot(Columns.Item).count()

    def get_hot_user_features(self) -> Features | None:
        return None if self.user_features is None else self.user_features.take(self.user_id_map.table.where(F.col("internal") < self.n_hot_users).select("internal"))

    def get_hot_item_features(self) -> Features | None:
        return None if self.item_features is None else self.item_features.take(self.item_id_map.table.where(F.col("internal") < self.n_hot_items).select("internal"))

    def get_user_item_matrix(self, include_weights: bool = True, include_warm_users: bool = False, include_warm_items: bool = False) -> tuple[DataFrame, tuple[int, int]]:
        """Coordinates with internal ids, and the shape, which warm ids extend."""
        shape = (self.user_id_map.size if include_warm_users else self.n_hot_users, self.item_id_map.size if include_warm_items else self.n_hot_items)
        return user_item_matrix(self.interactions.df, include_weights), shape

    def get_raw_interactions(self, include_weight: bool = True, include_datetime: bool = True, include_extra_cols: bool | list[str] = True) -> DataFrame:
        extra = self.extra_cols if include_extra_cols is True else [] if include_extra_cols is False else include_extra_cols
        return self.raw.select(*Columns.UserItem, *[Columns.Weight] * include_weight, *[Columns.Datetime] * include_datetime, *extra)

    def with_interactions(self, raw: DataFrame, keep_features_for_removed_entities: bool = True) -> Dataset:
        """The dataset over other rows of the same table; ids are mapped anew."""
        frames = dict(self.frames)
        if not keep_features_for_removed_entities:
            for name, frame in frames.items():
                if frame is not None:
                    frames[name] = frame.join(raw.select(F.col(name).alias(self._id_col(frame, name))).distinct(), self._id_col(frame, name), "left_semi")
        return Dataset(raw, frames[Columns.User], frames[Columns.Item], self.cats[Columns.User], self.cats[Columns.Item], self.dense[Columns.User], self.dense[Columns.Item], bool(self.extra_cols))

    def filter_interactions(self, row_indexes_to_keep: DataFrame, keep_external_ids: bool = True, keep_features_for_removed_entities: bool = True) -> Dataset:
        """Keeps the rows whose hidden row order is in the given table. Without external ids, the ids of the new dataset are
        the internal ids of this one."""
        ids = row_indexes_to_keep.select(F.col(row_indexes_to_keep.columns[0]).cast("long").alias(Columns.Row))
        source = self.raw if keep_external_ids else self.interactions.df
        kept = source.join(ids, Columns.Row, "left_semi")
        if keep_external_ids:
            return self.with_interactions(kept, keep_features_for_removed_entities)
        frames = {}
        for name, ids_map in ((Columns.User, self.user_id_map), (Columns.Item, self.item_id_map)):
            frame = self.frames[name]
            frames[name] = None if frame is None else ids_map.convert_to_internal(frame, self._id_col(frame, name), strict=False)
        other = Dataset(kept, frames[Columns.User], frames[Columns.Item], self.cats[Columns.User], self.cats[Columns.Item], self.dense[Columns.User], self.dense[Columns.Item], bool(self.extra_cols))
        return other.with_interactions(other.raw, keep_features_for_removed_entities)

    def get_schema(self) -> dict:
        """Sizes, id types and feature names; JSON safe."""

        def entity(name: str, n_hot: int, ids: IdMap, features: Features | None) -> dict:
            out: dict = {"n_hot": n_hot, "id_map": {"size": ids.size, "dtype": ids.external_dtype}, "features": None}
            if isinstance(features, DenseFeatures):
                out["features"] = {"kind": "dense", "names": list(features.names)}
            elif isinstance(features, SparseFeatures):
                names = features.names.orderBy("col").collect()
                out["features"] = {
                    "kind": "sparse", "names": [[r["feature"], r["value"]] for r in names], "cat_feature_indices": features.cat_feature_indices,
                    "cat_n_stored_values": features.get_cat_features().table.count(),
                }
            return out

        return {
            "n_interactions": self.raw.count(),
            "users": entity(Columns.User, self.n_hot_users, self.user_id_map, self.user_features),
            "items": entity(Columns.Item, self.n_hot_items, self.item_id_map, self.item_features),
        }
