"""Bijection between external ids and dense internal ones, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.runtime import dense_index, small


class IdMap:
    """Columns external, internal; internal ids are 0..n-1. Joins with it broadcast while its size allows."""

    def __init__(self, table: DataFrame):
        self.table = table.select("external", "internal")

    @classmethod
    def from_values(cls, df: DataFrame, column: str, row: str | None = None) -> IdMap:
        """Ids in order of their first appearance by `row` (ties by value), or by value where no row order is named."""
        first = F.min(F.col(row) if row else F.lit(0).cast("long")).alias("__first")
        firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("external")).agg(first)
        return cls(dense_index(firsts, "__first", ["external"]))

    @classmethod
    def from_dict(cls, spark: SparkSession, mapping: dict) -> IdMap:
        if sorted(mapping.values()) != list(range(len(mapping))):
            raise ValueError("Internal ids must be integers from 0 to n_objects-1")
        kind = "string" if any(isinstance(k, str) for k in mapping) else "long"
        return cls(spark.createDataFrame(list(mapping.items()), f"external {kind}, internal long"))

    @property
    def size(self) -> int:
        return self.table.count()

    @property
    def external_dtype(self) -> str:
        return self.table.schema["external"].dataType.simpleString()

    @property
    def internal_ids(self) -> DataFrame:
        return self.table.select("internal")

    @property
    def to_internal(self) -> DataFrame:
        return self.table

    @property
    def to_external(self) -> DataFrame:
        return self.table.select("internal", "external")

    def get_external_sorted_by_internal(self) -> DataFrame:
        return self.table.orderBy("internal").select("external")

    def get_sorted_internal(self) -> DataFrame:
        return self.table.select("internal").orderBy("internal")

    def _convert(self, df: DataFrame, column: str, source: str, target: str, strict: bool, return_missing: bool) -> DataFrame | tuple[DataFrame, DataFrame]:
        if strict and return_missing:
            raise ValueError("You can't use `strict` and `return_missing` together")
        side = small(self.table.select(F.col(source).alias(column), F.col(target).alias("__to")))
        if strict and not df.join(side, column, "left_anti").isEmpty():
            raise KeyError("Some ids don't exist in the map")
        others = [c for c in df.columns if c != column]
        found = df.join(side, column).select(*others, F.col("__to").alias(column)).select(*df.columns)
        return (found, df.join(side, column, "left_anti").select(column)) if return_missing else found

    def convert_to_internal(self, df: DataFrame, column: str, strict: bool = True, return_missing: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        """df with the column's external ids replaced; unknown ones raise (strict), are dropped, or come back in a second table."""
        return self._convert(df, column, "external", "internal", strict, return_missing)

    def convert_to_external(self, df: DataFrame, column: str, strict: bool = True, return_missing: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        return self._convert(df, column, "internal", "external", strict, return_missing)

    def add_ids(self, df: DataFrame, column: str, row: str | None = None, raise_if_already_present: bool = False) -> IdMap:
        """The map with unseen ids appended in order of appearance."""
        side = self.table.withColumnRenamed("external", column)
        if raise_if_already_present and not df.join(side, column, "left_semi").isEmpty():
            raise ValueError("Some of the ids already exist in the map")
        fresh = IdMap.from_values(df.join(side, column, "left_anti"), column, row).table
        last = self.table.agg((F.coalesce(F.max("internal"), F.lit(-1)) + 1).alias("__n"))
        shifted = fresh.crossJoin(F.broadcast(last)).select("external", (F.col("internal") + F.col("__n")).alias("internal"))  # one row
        return IdMap(self.table.unionByName(shifted))
