"""Containers, id maps, features and splits on the reference fixtures' facts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import runtime, scalar
from tidemark.functions.runtime import dense_index
from tidemark.operators import splits
from tidemark.operators.splits import LastNSplitter, RandomSplitter, TimeRangeSplitter, leave_one_out
from tidemark.schema import AbsentIdError, Columns, UnknownIdError
from tidemark.sources.dataset import Dataset
from tidemark.sources.features import DIRECT_FEATURE_VALUE, DenseFeatures, SparseFeatures
from tidemark.sources.idmap import IdMap
from tidemark.sources.interactions import Interactions, get_context
from tidemark.streaming.popularity import run_once

KINDS = "user_id string, item_id string, weight double, datetime string, extra_col int, _row_id long"
ROWS = [("u1", "i1", 2.0, "2021-09-09", 0), ("u1", "i2", 3.0, "2021-09-05", 0), ("u2", "i1", 6.0, "2021-08-20", 1), ("u2", "i2", 7.0, "2021-09-05", 1), ("u1", "i1", 6.0, "2021-09-05", 1), ("u3", "i5", 6.0, "2021-09-05", 1)]


@pytest.fixture(scope="module")
def raw(spark):  # noqa: ANN001
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], KINDS)


def pairs(df, *columns: str) -> dict:  # noqa: ANN001
    return {tuple(r)[0] if len(columns) == 2 else tuple(r)[:-1]: r[-1] for r in df.select(*columns).collect()}


def test_id_map(spark, raw):  # noqa: ANN001
    ids = IdMap.from_values(raw, "user_id", Columns.Row)
    assert pairs(ids.table, "external", "internal") == {"u1": 0, "u2": 1, "u3": 2} and ids.size == 3
    more = spark.createDataFrame([("u9", 0), ("u2", 1), ("u0", 2)], "id string, row long")
    assert pairs(ids.add_ids(more, "id", "row").table, "external", "internal") == {"u1": 0, "u2": 1, "u3": 2, "u9": 3, "u0": 4}
    with pytest.raises(ValueError):
        ids.add_ids(more, "id", "row", raise_if_already_present=True)
    with pytest.raises(KeyError):
        ids.convert_to_internal(more, "id")
    with pytest.raises(ValueError):
        ids.convert_to_internal(more, "id", strict=True, return_missing=True)
    found, missing = ids.convert_to_internal(more, "id", strict=False, return_missing=True)
    assert [r["id"] for r in found.collect()] == [1] and sorted(r["id"] for r in missing.collect()) == ["u0", "u9"]
    with pytest.raises(ValueError):
        IdMap.from_dict(spark, {"a": 0, "b": 2})
    assert IdMap.from_dict(spark, {"b": 0, "a": 1}).get_external_sorted_by_internal().collect()[0][0] == "b"


def test_dense_index_over_ranges(spark):  # noqa: ANN001
    df = spark.createDataFrame([(k << 18, str(i)) for i, k in enumerate([9, 1, 5, 5, 40, 0, 17])], "key long, name string")
    got = {r["name"]: r["internal"] for r in dense_index(df, "key", ["name"]).collect()}
    assert got == {"5": 0, "1": 1, "2": 2, "3": 3, "0": 4, "6": 5, "4": 6}


def test_interactions(spark, raw):  # noqa: ANN001
    ds = Dataset.construct(raw, keep_extra_cols=True)
    assert ds.interactions.extra_cols == ["extra_col"]
    matrix, shape = ds.get_user_item_matrix()
    assert pairs(matrix, "user_id", "item_id", "weight") == {(0, 0): 8.0, (0, 1): 3.0, (1, 0): 6.0, (1, 1): 7.0, (2, 2): 6.0} and shape == (3, 3)
    counts, _ = ds.get_user_item_matrix(include_weights=False)
    assert pairs(counts, "user_id", "item_id", "weight")[0, 0] == 2.0
    back = ds.interactions.to_external(ds.user_id_map, ds.item_id_map, include_datetime=False, include_extra_cols=["extra_col"])
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], r[2], r[4]) for r in ROWS)
    with pytest.raises(KeyError):
        Dataset.construct(raw.drop("weight"))
    with pytest.raises(TypeError):
        Dataset.construct(raw.withColumn("weight", F.lit("x")))
    with pytest.raises(TypeError):
        Interactions(raw)
    bad = spark.createDataFrame([(-1, 0, 1.0, datetime(2021, 1, 1))], "user_id long, item_id long, weight double, datetime timestamp")
    with pytest.raises(ValueError):
        Interactions(bad, validate=True)


def test_integer_datetimes_are_nanoseconds(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, 1, 1.0, 101, 0), (1, 2, 1.0, 103, 1), (1, 3, 1.0, 102, 2)], "user_id long, item_id long, weight double, datetime long, _row_id long")
    fold = next(iter(LastNSplitter(1, filter_cold_items=False).split(Dataset.construct(df))))
    assert [r["item_id"] for r in fold.test.collect()] == [2]


def test_filter_interactions_maps_ids_anew(spark, raw):  # noqa: ANN001
    features = spark.createDataFrame([("u1", "f", "1"), ("u3", "f", "2")], "id string, feature string, value string")
    ds = Dataset.construct(raw, features)
    keep = spark.createDataFrame([(3,), (5,)], "row long")
    own = ds.filter_interactions(keep)
    assert pairs(own.user_id_map.table, "external", "internal") == {"u2": 0, "u3": 1, "u1": 2}
    assert ds.filter_interactions(keep, keep_features_for_removed_entities=False).user_id_map.size == 2
    inner = ds.filter_interactions(keep, keep_external_ids=False)
    assert {r["external"] for r in inner.user_id_map.table.collect()} == {0, 1, 2}
    assert own.get_schema()["users"]["n_hot"] == 2


def test_schema(spark, raw):  # noqa: ANN001
    items = spark.createDataFrame([("i2", "f1", "3"), ("i2", "f2", "20"), ("i5", "f2", "20"), ("i5", "f2", "30"), ("i9", "f1", "4")], "id string, feature string, value string")
    got = Dataset.construct(raw, item_features_df=items, cat_item_features=("f2",)).get_schema()
    assert got["n_interactions"] == 6 and got["users"]["features"] is None
    assert got["items"]["n_hot"] == 3 and got["items"]["id_map"] == {"size": 4, "dtype": "string"}
    assert got["items"]["features"] == {"kind": "sparse", "names": [["f1", DIRECT_FEATURE_VALUE], ["f2", "20"], ["f2", "30"]], "cat_feature_indices": [1, 2], "cat_n_stored_values": 3}


def test_context(spark):  # noqa: ANN001
    rows = [(0, 0, 1.0, "2021-09-01", 1, 0), (0, 1, 2.0, "2021-09-02", 2, 1), (1, 5, 3.0, "2021-09-03", 3, 2), (1, 6, 4.0, "2021-09-03", 4, 3)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, weight double, datetime string, extra int, _row_id long")
    got = {r["user_id"]: (r["weight"], r["extra"]) for r in get_context(df).collect()}
    assert got == {0: (1.0, 1), 1: (3.0, 3)} and "item_id" not in get_context(df).columns
    assert get_context(df.drop("weight")).first()["weight"] == 1.0


def test_dense_features(spark):  # noqa: ANN001
    ids = IdMap.from_dict(spark, {"a": 0, "b": 1})
    make = lambda rows: DenseFeatures.from_dataframe(spark.createDataFrame(rows, "id string, f1 double, f2 double"), ids)
    features = make([("b", 1.0, 2.0), ("a", 3.0, 0.0)])
    assert features.names == ("f1", "f2") and pairs(features.get_dense(), "id", "values") == {0: [3.0, 0.0], 1: [1.0, 2.0]}
    assert sorted(map(tuple, features.get_sparse().collect())) == [(0, 0, 3.0), (1, 0, 1.0), (1, 1, 2.0)] and len(features.take(spark.range(1))) == 1
    with pytest.raises(ValueError):
        make([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0)])
    with pytest.raises(UnknownIdError):
        make([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0)])
    with pytest.raises(AbsentIdError):
        make([("a", 1.0, 1.0)])


FLAT = [(10, "f1", "3"), (11, "f2", "100"), (10, "f2", "200"), (10, "f1", "1"), (11, "f2", "100"), (12, "f3", "7"), (12, "f2", "200")]


def test_sparse_features(spark):  # noqa: ANN001
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(FLAT)], "id long, feature string, value string, _row_id long")
    ids = IdMap.from_dict(spark, {10: 0, 11: 1, 12: 2})
    got = SparseFeatures.from_flatten(df, ids, ("f2",))
    assert [(r["feature"], r["value"]) for r in got.names.orderBy("col").collect()] == [("f1", DIRECT_FEATURE_VALUE), ("f3", DIRECT_FEATURE_VALUE), ("f2", "100"), ("f2", "200")]
    assert pairs(got.get_dense(), "id", "values") == {0: [4.0, 0.0, 0.0, 1.0], 1: [0.0, 0.0, 2.0, 0.0], 2: [0.0, 7.0, 0.0, 1.0]}
    assert got.cat_feature_indices == [2, 3] and got.get_cat_features().table.count() == 3 and len(got) == 3
    weighted = SparseFeatures.from_flatten(df.withColumn("weight", F.lit(2.0)), ids, ("f2",))
    assert pairs(weighted.get_dense(), "id", "values")[0] == [8.0, 0.0, 0.0, 2.0]
    with pytest.raises(TypeError):
        SparseFeatures.from_flatten(df.withColumn("value", F.lit("x")), ids)
    with pytest.raises(UnknownIdError):
        SparseFeatures.from_flatten(df, IdMap.from_dict(spark, {10: 0}), ("f2",))


TIMES = [
    (1, 1, "2021-09-01"), (1, 2, "2021-09-02"), (2, 1, "2021-09-02"), (2, 2, "2021-09-03"), (3, 2, "2021-09-03"), (3, 3, "2021-09-03"), (3, 4, "2021-09-04"), (1, 2, "2021-09-04"), (3, 1, "2021-09-05"),
    (4, 2, "2021-09-05"), (3, 3, "2021-09-06 18:05"),
]


@pytest.fixture(scope="module")
def timed(spark):  # noqa: ANN001
    return spark.createDataFrame([(u, i, 1.0, t, k) for k, (u, i, t) in enumerate(TIMES)], "user_id long, item_id long, weight double, datetime string, _row_id long")


def kept(df) -> list[int]:  # noqa: ANN001
    return sorted(r[Columns.Row] for r in df.select(Columns.Row).collect())


def test_time_range_split(timed):  # noqa: ANN001
    plain = {"filter_cold_users": False, "filter_cold_items": False, "filter_already_seen": False}
    folds = list(TimeRangeSplitter("2D", 2, **plain).split(timed))
    assert [(f.info["start"], f.info["end"]) for f in folds] == [(datetime(2021, 9, 3), datetime(2021, 9, 5)), (datetime(2021, 9, 5), datetime(2021, 9, 7))]
    assert (kept(folds[0].train), kept(folds[0].test)) == ([0, 1, 2], [3, 4, 5, 6, 7])
    assert (kept(folds[1].train), kept(folds[1].test)) == (list(range(8)), [8, 9, 10])
    assert kept(list(TimeRangeSplitter("2D", 2).split(timed))[0].test) == [3]
    assert kept(list(TimeRangeSplitter("2D", 2).split(timed))[1].test) == [8]
    only = lambda **on: kept(list(TimeRangeSplitter("2D", 1, **(plain | on)).split(timed))[0].test)
    assert only(filter_cold_users=True) == [8, 10] and only(filter_already_seen=True) == [8, 9]
    stats = folds[1].stats()
    assert (stats["train"], stats["train_users"], stats["train_items"], stats["test"], stats["test_users"], stats["test_items"]) == (8, 3, 4, 3, 2, 3)
    hours = list(TimeRangeSplitter("18H", 1, **plain).split(timed))[0]
    assert (hours.info["start"], hours.info["end"]) == (datetime(2021, 9, 6, 1), datetime(2021, 9, 6, 19))
    border = list(TimeRangeSplitter("1D", 1, **plain).split(timed.where(F.col(Columns.Row) < 10)))[0]
    assert border.info["end"] == datetime(2021, 9, 6)  # the last moment lies on a border
    for bad in ("D", "0D", "1M", "1.5D"):
        with pytest.raises(ValueError):
            TimeRangeSplitter(bad)


def test_last_n_split(timed):  # noqa: ANN001
    plain = {"filter_cold_users": False, "filter_cold_items": False, "filter_already_seen": False}
    folds = list(LastNSplitter(1, 2, **plain).split(timed))
    assert kept(folds[1].test) == [3, 7, 9, 10] and kept(folds[0].test) == [1, 2, 8]
    assert kept(folds[0].train) == [0, 4, 5, 6]
    ties = list(LastNSplitter(2, 1, **plain).split(timed.withColumn("datetime", F.lit("2021-01-01"))))[0]
    assert kept(ties.test) == [1, 2, 3, 7, 8, 9, 10]  # of equal times, the later row is the last
    with pytest.raises(ValueError):
        LastNSplitter(0)


def test_random_split(timed):  # noqa: ANN001
    plain = {"filter_cold_users": False, "filter_cold_items": False, "filter_already_seen": False}
    one, two = (list(RandomSplitter(0.3, 3, 5, **plain).split(timed)) for _ in range(2))
    assert [kept(f.test) for f in one] == [kept(f.test) for f in two]
    assert all(len(kept(f.test)) == 3 and len(kept(f.train)) == 8 for f in one)
    assert len({r for f in one for r in kept(f.test)}) == 9
    for bad in ((0.0, 1), (1.0, 1), (0.6, 2)):
        with pytest.raises(ValueError):
            RandomSplitter(*bad)
    with pytest.raises(ValueError):
        next(iter(RandomSplitter(0.01).split(timed)))


def test_random_split_by_ranges(spark, monkeypatch):  # noqa: ANN001
    plain = {"filter_cold_users": False, "filter_cold_items": False, "filter_already_seen": False}
    df = spark.range(5000).select((F.col("id") % 70).alias("user_id"), (F.col("id") % 90).alias("item_id"), F.lit(1.0).alias("weight"), F.lit("2021-01-01").alias("datetime"), F.col("id").alias("_row_id"))
    short = [kept(f.test) for f in RandomSplitter(0.2, 2, 3, **plain).split(df)]
    monkeypatch.setattr(splits, "SHORT", 0)
    monkeypatch.setattr(runtime, "RANGE_BITS", 8)
    assert [kept(f.test) for f in RandomSplitter(0.2, 2, 3, **plain).split(df)] == short


def test_leave_one_out(timed):  # noqa: ANN001
    assert kept(leave_one_out(timed)) == [3, 7, 9, 10]
    assert kept(leave_one_out(timed, [1, 3])) == [7, 10] and leave_one_out(timed, 2).count() == 2


def test_scalars(spark):  # noqa: ANN001
    row = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        scalar.dot(F.col("a"), F.col("b")), scalar.cosine(F.col("a"), F.col("b")), scalar.euclid(F.col("a"), F.col("b")), scalar.cosine(F.col("a"), F.col("z"))
    ).first()
    assert row[0] == 1.0 and abs(row[1] - 1 / 50**0.5) < 1e-12 and abs(row[2] - 13**0.5) < 1e-12 and row[3] == 0.0
    flat = scalar.make_dict_flat({"a": {"b": 1, "c": {"d": 2}}, "e": 3})
    assert flat == {"a.b": 1, "a.c.d": 2, "e": 3} and scalar.unflatten_dict(flat) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert list(scalar.pairwise([1, 2, 3])) == [(1, 2), (2, 3)] and scalar.select_by_type({"a": 1, "b": "x"}, int) == {"a": 1}
    assert scalar.import_object("datetime.timedelta") is timedelta and abs(scalar.log_at_base(9, 3) - 2) < 1e-12
    places = spark.createDataFrame([("x", 0)], "v string, position long")
    with pytest.raises(ValueError):
        scalar.element_ids(spark.createDataFrame([("y",)], "v string"), places, "v")


def test_streamed_popularity(spark, tmp_path):  # noqa: ANN001
    """The states of the last batch that touched a window count; a stream that is started again goes on where it was."""
    rows = [("view", 1.0, datetime(2021, 1, 1, 3)), ("view", 2.0, datetime(2021, 1, 1, 4)), ("buy", 5.0, datetime(2021, 1, 1, 5)), ("view", 1.0, datetime(2021, 1, 2, 1)), (None, None, datetime(2021, 1, 2, 2))]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_type string, value double, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(path)
    day = lambda n: datetime(2021, 1, n)
    for _ in range(2):
        got = {(r["window_start"], r["item_id"]): (r["n_interactions"], r["sum_weight"]) for r in run_once(spark, path, "streamed").collect()}
        assert got == {(day(1), "view"): (2, 3.0), (day(1), "buy"): (1, 5.0), (day(2), "view"): (1, 1.0), (day(2), None): (1, None)}
