"""Distances between items, as joins over feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.runtime import small
from tidemark.schema import Columns
from tidemark.sources.features import SparseFeatures
from tidemark.sources.idmap import IdMap


class PairwiseDistanceCalculator:
    """Extension point: distances(pairs) adds `distance` to a table item_a, item_b; null if an item has no features."""

    def distances(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError


class PairwiseHammingDistanceCalculator(PairwiseDistanceCalculator):
    """Number of feature columns in which two items differ; null if either lacks a value."""

    def __init__(self, item_features_df: DataFrame):
        self.names = [c for c in item_features_df.columns if c != Columns.Item]
        self.table = item_features_df

    def distances(self, pairs: DataFrame) -> DataFrame:
        side = lambda end: small(self.table.select(F.col(Columns.Item).alias(f"item_{end}"), F.struct(*self.names).alias(f"f_{end}")))
        both = pairs.join(side("a"), "item_a", "left").join(side("b"), "item_b", "left")
        differing = F.lit(0)
        for c in self.names:
            differing = differing + (F.col(f"f_a.{c}") != F.col(f"f_b.{c}")).cast("int")
        return both.withColumn("distance", differing.cast("double")).select(*pairs.columns, "distance")


class SparsePairwiseHammingDistanceCalculator(PairwiseDistanceCalculator):
    """Number of differing cells of sparse feature rows; null for ids that the id map lacks."""

    def __init__(self, features: SparseFeatures, id_map: IdMap):
        cells = features.table.where("value <> 0").groupBy("id").agg(F.collect_list(F.struct("col", "value")).alias("cells"))
        empty = F.array().cast(cells.schema["cells"].dataType)
        self.table = id_map.table.join(cells, id_map.table["internal"] == cells["id"], "left").select(F.col("external").alias(Columns.Item), F.coalesce("cells", empty).alias("cells"))

    def distances(self, pairs: DataFrame) -> DataFrame:
        side = lambda end: small(self.table.select(F.col(Columns.Item).alias(f"item_{end}"), F.col("cells").alias(f"c_{end}")))
        both = pairs.join(side("a"), "item_a", "left").join(side("b"), "item_b", "left")
        # Columns of either side, less those in which the cells agree.
        columns = F.expr("size(array_union(transform(c_a, x -> x.col), transform(c_b, x -> x.col))) - size(array_intersect(c_a, c_b))")
        known = F.col("c_a").isNotNull() & F.col("c_b").isNotNull()
        return both.withColumn("distance", F.when(known, columns.cast("double"))).select(*pairs.columns, "distance")
