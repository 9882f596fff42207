"""Scalar and vector expressions, and the small Python helpers of the API."""

from __future__ import annotations

import importlib
import math
from collections.abc import Iterable, Iterator
from itertools import tee
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the length of a zero vector in cosine distances.
ZERO_LENGTH = 1e-10


def log_at_base(x: Column | float, base: float) -> Column | float:
    """Logarithm to a base."""
    return F.log(x) / math.log(base) if isinstance(x, Column) else math.log(x) / math.log(base)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    length = lambda v: F.when(norm(v) == 0, F.lit(ZERO_LENGTH)).otherwise(norm(v))
    return dot(a, b) / (length(a) * length(b))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


# Set operations over DataFrames: the relational form of array membership tests.


def isin(elements: DataFrame, test_elements: DataFrame, on: list[str], invert: bool = False) -> DataFrame:
    """Rows of `elements` whose key occurs (or, inverted, doesn't) in `test_elements`."""
    return elements.join(test_elements.select(*on).distinct(), on, "left_anti" if invert else "left_semi")


def unique_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def element_ids(elements: DataFrame, test_elements: DataFrame, on: str, strict: bool = True) -> DataFrame:
    """Position of each element in `test_elements` (columns: on, position); a missing one is an error if strict."""
    out = elements.join(test_elements.select(on, "position"), on, "left")
    if strict and not out.where(F.col("position").isNull()).isEmpty():
        raise ValueError("All `elements` must be in `test_elements`")
    return out


# Driver-side helpers.


def pairwise(values: Iterable[Any]) -> Iterator[tuple[Any, Any]]:
    a, b = tee(values)
    next(b, None)
    return zip(a, b)


def is_instance(obj: object, types: Any) -> bool:
    try:
        return isinstance(obj, types)
    except TypeError:
        return any(is_instance(obj, t) for t in getattr(types, "__args__", ()))


def select_by_type(objects: dict[str, Any], types: Any) -> dict[str, Any]:
    return {k: v for k, v in objects.items() if is_instance(v, types)}


def import_object(path: str) -> Any:
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def full_path(obj: Any) -> str:
    return f"{obj.__module__}.{obj.__qualname__}"


def make_dict_flat(d: dict[str, Any], sep: str = ".", parent_key: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in d.items():
        key = f"{parent_key}{sep}{k}" if parent_key else k
        out |= make_dict_flat(v, sep, key) if isinstance(v, dict) else {key: v}
    return out


def unflatten_dict(d: dict[str, Any], sep: str = ".") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in d.items():
        *path, last = key.split(sep)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out
