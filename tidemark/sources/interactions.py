"""Interaction tables: one row an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import Columns, require

from .idmap import IdMap


def with_row_order(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """Adds the hidden row order: a given long column, or else the order in which Spark reads the table."""
    if Columns.Row in df.columns:
        return df
    return df.withColumn(Columns.Row, F.col(order).cast("long") if isinstance(order, str) else F.monotonically_increasing_id())


def typed(df: DataFrame) -> DataFrame:
    """weight as double and datetime as timestamp; other types raise TypeError. Integer datetimes are nanoseconds since the
    epoch; they keep their full order in the hidden `_datetime_ns`."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    weight, when = kinds[Columns.Weight], kinds[Columns.Datetime]
    if not isinstance(weight, T.NumericType):
        raise TypeError("Column 'weight' must be numeric")
    out: dict[str, Column] = {Columns.Weight: F.col(Columns.Weight).cast("double")}
    if isinstance(when, T.IntegralType):
        out["_datetime_ns"] = F.col(Columns.Datetime).cast("long")
        out[Columns.Datetime] = F.timestamp_micros(F.floor(F.col(Columns.Datetime) / 1000).cast("long"))
    elif isinstance(when, (T.DateType, T.StringType)):
        out[Columns.Datetime] = F.col(Columns.Datetime).cast("timestamp")
    elif not isinstance(when, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError("Column 'datetime' must be castable to a timestamp")
    return df.withColumns(out)


class Interactions:
    """Interactions with internal ids: user_id, item_id, weight, datetime, extras."""

    def __init__(self, df: DataFrame, validate: bool = False):
        require(df.columns, Columns.Interactions)
        for c in Columns.UserItem:
            if not isinstance(df.schema[c].dataType, T.IntegralType):
                raise TypeError(f"Column {c!r} must be integer")
        if validate and not df.where((F.col(Columns.User) < 0) | (F.col(Columns.Item) < 0)).isEmpty():
            raise ValueError("Ids must be non-negative")
        self.df = typed(df)

    @classmethod
    def from_raw(cls, df: DataFrame, user_id_map: IdMap, item_id_map: IdMap, keep_extra_cols: bool = False, strict: bool = True) -> Interactions:
        require(df.columns, Columns.Interactions)
        df = with_row_order(df)
        if not keep_extra_cols:
            df = df.select(*Columns.Interactions, Columns.Row)
        df = user_id_map.convert_to_internal(df, Columns.User, strict)  # type: ignore[assignment]
        return cls(item_id_map.convert_to_internal(df, Columns.Item, strict))  # type: ignore[arg-type]

    @property
    def extra_cols(self) -> list[str]:
        return [c for c in self.df.columns if c not in Columns.Interactions and not c.startswith("_")]

    def get_user_item_matrix(self, include_weights: bool = True) -> DataFrame:
        """The sparse matrix as coordinates user_id, item_id, weight: duplicates are summed, or counted without weights."""
        return user_item_matrix(self.df, include_weights)

    def to_external(self, user_id_map: IdMap, item_id_map: IdMap, include_weight: bool = True, include_datetime: bool = True, include_extra_cols: bool | list[str] = True) -> DataFrame:
        extra = self.extra_cols if include_extra_cols is True else [] if include_extra_cols is False else include_extra_cols
        kept = [*Columns.UserItem, *[Columns.Weight] * include_weight, *[Columns.Datetime] * include_datetime, *extra]
        df = user_id_map.convert_to_external(self.df, Columns.User)
        return item_id_map.convert_to_external(df, Columns.Item).select(*kept)  # type: ignore[arg-type,union-attr]


def user_item_matrix(df: DataFrame, include_weights: bool = True) -> DataFrame:
    cell = F.sum(Columns.Weight) if include_weights else F.count("*").cast("double")
    return df.groupBy(*Columns.UserItem).agg(cell.alias(Columns.Weight))


def get_context(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The earliest row of each user, without its item; a missing weight is 1."""
    require(df.columns, [Columns.User, Columns.Datetime])
    if Columns.Weight not in df.columns:
        df = df.withColumn(Columns.Weight, F.lit(1.0))
    df = with_row_order(df)
    others = [c for c in df.columns if c not in (Columns.Item, Columns.User, Columns.Row)]
    # min() of a struct is a partial aggregate: no user's rows are sorted or gathered.
    order_by = [Columns.Datetime, *(order or [Columns.Row])]
    key = F.struct(*order_by, *[F.col(c).alias(f"__{c}") for c in others])
    first = df.groupBy(Columns.User).agg(F.min(key).alias("__first"))
    return first.select(Columns.User, *[F.col(f"__first.__{c}").alias(c) for c in others])
