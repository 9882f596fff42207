"""User and item features, dense (an array a row) or sparse (long rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.runtime import small
from tidemark.schema import AbsentIdError, UnknownIdError, require

from .idmap import IdMap
from .interactions import with_row_order

#: Second part of a direct feature's name.
DIRECT_FEATURE_VALUE = "__is_direct_feature"


class DenseFeatures:
    """Table id, values (array<float>) and the names of the values."""

    def __init__(self, table: DataFrame, names: tuple[str, ...]):
        self.table, self.names = table, names

    @classmethod
    def from_dataframe(cls, df: DataFrame, id_map: IdMap, id_col: str = "id") -> DenseFeatures:
        require(df.columns, [id_col])
        names = tuple(c for c in df.columns if c != id_col)
        ids = df.select(F.col(id_col).alias("external"))
        if not ids.groupBy("external").count().where("count > 1").isEmpty():
            raise ValueError("Ids must be unique")
        if not ids.join(id_map.table, "external", "left_anti").isEmpty():
            raise UnknownIdError("Features hold ids that the id map lacks")
        if not id_map.table.join(ids, "external", "left_anti").isEmpty():
            raise AbsentIdError("Some ids of the id map have no features")
        rows = df.select(F.col(id_col).alias("external"), F.array(*[F.col(c).cast("float") for c in names]).alias("values"))
        return cls(rows.join(small(id_map.table), "external").select(F.col("internal").alias("id"), "values"), names)

    @classmethod
    def from_iterables(cls, table: DataFrame, names: list[str]) -> DenseFeatures:
        return cls(table.select("id", F.col("values").cast("array<float>").alias("values")), tuple(names))

    def get_dense(self) -> DataFrame:
        return self.table

    def get_sparse(self) -> DataFrame:
        """Long rows id, col, value without zeros."""
        long = self.table.select("id", F.posexplode("values").alias("col", "value"))
        return long.where("value <> 0")

    def take(self, ids: DataFrame) -> DenseFeatures:
        return DenseFeatures(self.table.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi"), self.names)

    def __len__(self) -> int:
        return self.table.count()


class SparseFeatures:
    """Long table id, col, value (zeros left out) and the table of names col, feature, value."""

    def __init__(self, table: DataFrame, names: DataFrame, ids: DataFrame | None = None):
        self.table, self.names, self.ids = table, names, ids

    @classmethod
    def from_iterables(cls, table: DataFrame, names: DataFrame) -> SparseFeatures:
        return cls(table.groupBy("id", "col").agg(F.sum("value").alias("value")), names)

    @classmethod
    def from_flatten(
        cls, df: DataFrame, id_map: IdMap, cat_features: list[str] | tuple[str, ...] = (), id_col: str = "id", feature_col: str = "feature", value_col: str = "value",
        weight_col: str = "weight", strict: bool = True,
    ) -> SparseFeatures:
        """Direct features: sum(value * weight) for each id and feature. Categorical ones: a column for each value, sum(weight)
        in it. Columns stand in order of first appearance, direct ones first."""
        require(df.columns, [id_col, feature_col, value_col])
        rows = with_row_order(df).select(
            F.col(id_col).alias("external"), F.col(feature_col).cast("string").alias("feature"), F.col(value_col).cast("string").alias("value"),
            (F.col(weight_col).cast("double") if weight_col in df.columns else F.lit(1.0)).alias("weight"), "_row_id",
        )
        if strict and not rows.join(id_map.table, "external", "left_anti").isEmpty():
            raise UnknownIdError("Features hold ids that the id map lacks")
        rows = rows.join(small(id_map.table), "external").withColumnRenamed("internal", "id")
        is_cat = F.col("feature").isin(*cat_features) if cat_features else F.lit(False)
        rows = rows.withColumn("number", F.when(is_cat, F.lit(1.0)).otherwise(F.expr("try_cast(value as double)")))
        if strict and not rows.where(F.col("number").isNull()).isEmpty():
            raise TypeError("Values of direct features must be numeric")
        keyed = rows.withColumns({"cat": is_cat, "value": F.when(is_cat, F.col("value")).otherwise(F.lit(DIRECT_FEATURE_VALUE))})
        block = F.when(F.col("cat"), F.array_position(F.array(*[F.lit(c) for c in cat_features]) if cat_features else F.array().cast("array<string>"), F.col("feature"))).otherwise(0)
        firsts = keyed.withColumn("block", block).groupBy("feature", "value", "block").agg(F.min("_row_id").alias("first"))
        # As many rows as feature columns, a property of the schema.
        names = firsts.withColumn("col", (F.row_number().over(Window.orderBy("block", "first", "feature", "value")) - 1).cast("long")).select("col", "feature", "value")
        cells = keyed.withColumn("cell", F.col("number") * F.col("weight")).groupBy("id", "feature", "value").agg(F.sum("cell").alias("cell"))
        table = cells.join(small(names), ["feature", "value"]).select("id", "col", F.col("cell").alias("value"))
        return cls(table, names, id_map.table.select(F.col("internal").alias("id")))

    def get_sparse(self) -> DataFrame:
        return self.table

    def get_dense(self) -> DataFrame:
        """id, values: one array over all columns; meant for few of them."""
        n = self.names.count()
        filled = self.table.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
        if self.ids is not None:
            filled = self.ids.join(filled, "id", "left")
        zero = F.create_map().cast(T.MapType(T.LongType(), T.DoubleType()))
        values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.coalesce("m", zero), i), F.lit(0.0)).cast("float"))
        return filled.select("id", values.alias("values"))

    def take(self, ids: DataFrame) -> SparseFeatures:
        keep = ids.select(F.col(ids.columns[0]).alias("id"))
        return SparseFeatures(self.table.join(keep, "id", "left_semi"), self.names, keep)

    @property
    def cat_names(self) -> DataFrame:
        return self.names.where(F.col("value") != DIRECT_FEATURE_VALUE)

    @property
    def cat_feature_indices(self) -> list[int]:
        return [r["col"] for r in self.cat_names.orderBy("col").collect()]

    def get_cat_features(self) -> SparseFeatures:
        names = self.cat_names
        return SparseFeatures(self.table.join(small(names.select("col")), "col", "left_semi").select("id", "col", "value"), names, self.ids)

    def __len__(self) -> int:
        return self.ids.count() if self.ids is not None else self.table.select("id").distinct().count()


Features = DenseFeatures | SparseFeatures
