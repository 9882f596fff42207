"""Models, rankers, validation and two-stage ranking on the reference fixtures' facts."""

from __future__ import annotations

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import autograd as ag
from tidemark.functions.autograd import Tensor
from tidemark.operators import metrics as M
from tidemark.operators import models as O
from tidemark.operators.ann import ItemToItemAnnRecommender, UserToItemAnnRecommender
from tidemark.operators.models import factors, neighbours, sequential, sgd
from tidemark.operators.models.factors import gram_of
from tidemark.operators.models.sequential import Network, left_padded, loss_of, sessions, time_buckets
from tidemark.operators.models.sgd import kth_best
from tidemark.operators import products, rank
from tidemark.functions.runtime import in_order, vectors_of
from tidemark.operators.rank import Catalog, Distance, VectorRanker, nearest, recommend_from_scores
from tidemark.operators.sampling import triplets
from tidemark.operators.splits import LastNSplitter, leave_one_out
from tidemark.plans.cross_validate import cross_validate
from tidemark.plans.report import MetricsReport, ReportStorage
from tidemark.plans.two_stage import CandidateFeatureCollector, CandidateGenerator, CandidateRankingModel, PerUserNegativeSampler, Reranker
from tidemark.schema import NotFittedError, NotFittedForStageError
from tidemark.sources.dataset import Dataset
from tidemark.sources.idmap import IdMap

KINDS = "user_id long, item_id long, weight double, datetime string, _row_id long"
SHARED = [(10, 11), (10, 12), (10, 14), (20, 11), (20, 12), (20, 13), (30, 11), (30, 12), (30, 14), (30, 15), (40, 11), (40, 15), (40, 17)]
POPULAR = [
    (70, 11, 1, "2021-11-30"), (70, 12, 1, "2021-11-30"), (10, 11, 1, "2021-11-30"), (10, 12, 1, "2021-11-29"), (10, 13, 9, "2021-11-28"), (20, 11, 1, "2021-11-27"), (20, 14, 2, "2021-11-26"),
    *[(20, 14, 1, "2021-11-25")] * 5, (30, 11, 1, "2021-11-24"), (30, 12, 1, "2021-11-23"), (30, 14, 1, "2021-11-23"), (30, 15, 5, "2021-11-21"), (30, 15, 5, "2021-11-21"), (40, 11, 1, "2021-11-20"),
    (40, 12, 1, "2021-11-19"), (50, 12, 1, "2021-11-19"), (60, 12, 1, "2021-11-19"),
]


@pytest.fixture(scope="module")
def shared(spark):  # noqa: ANN001
    return Dataset.construct(spark.createDataFrame([(u, i, 1.0, "2021-09-09", k) for k, (u, i) in enumerate(SHARED)], KINDS))


def rows_of(spark, rows: list) -> object:  # noqa: ANN001
    return spark.createDataFrame([(u, i, float(w), t, k) for k, (u, i, w, t) in enumerate(rows)], KINDS)


@pytest.fixture(scope="module")
def popular(spark):  # noqa: ANN001
    items = IdMap.from_dict(spark, {x: i for i, x in enumerate((11, 12, 13, 14, 15, 16))})
    return Dataset(rows_of(spark, POPULAR), item_id_map=items)


def lists(reco, target: str = "user_id") -> dict:  # noqa: ANN001
    out: dict = {}
    for r in reco.orderBy(target, "rank").collect():
        own = out.setdefault(r[target], [])
        own.append((r["item_id"], round(r["score"], 4)))
        assert r["rank"] == len(own)
    return out


def ids(found: dict) -> dict:
    return {k: [i for i, _ in v] for k, v in found.items()}


WEEK = timedelta(days=7)
# Models and the lists of users 10 and 80.
CASES = [
    ({}, [14, 15], [2, 1], [12, 11, 14], [6, 5, 2]), ({"popularity": "n_interactions"}, [14, 15], [7, 2], [14, 12, 11], [7, 6, 5]), ({"popularity": "mean_weight"}, [15, 14], [5, 8 / 7], [13, 15, 14], [9, 5, 8 / 7]),
    ({"popularity": "sum_weight"}, [15, 14], [10, 8], [15, 13, 14], [10, 9, 8]), ({"period": WEEK}, [14], [2], [11, 12, 14], [4, 3, 2]), ({"begin_from": datetime(2021, 11, 23)}, [14], [2], [11, 12, 14], [4, 3, 2]),
    ({"add_cold": True}, [14, 15, 16], [2, 1, 0], [12, 11, 14], [6, 5, 2]), ({"period": WEEK, "add_cold": True}, [14, 15, 16], [2, 0, 0], [11, 12, 14], [4, 3, 2]),
    ({"inverse": True, "period": WEEK}, [14], [2], [13, 14, 12], [1, 2, 3]), ({"add_cold": True, "inverse": True, "period": WEEK}, [16, 15, 14], [0, 0, 2], [16, 15, 13], [0, 0, 1]),
]


@pytest.mark.parametrize("case", CASES)
def test_popular(popular, case):  # noqa: ANN001
    options, items_10, scores_10, items_80, scores_80 = case
    got = lists(O.PopularModel(**options).fit(popular).recommend([10, 80], popular, 3, True))
    pack = lambda i, s: list(zip(i, [round(x, 4) for x in s]))
    assert got == {10: pack(items_10, scores_10), 80: pack(items_80, scores_80)}


def test_popular_whitelist_and_items(popular):  # noqa: ANN001
    model = O.PopularModel().fit(popular)
    assert ids(lists(model.recommend([10, 80], popular, 3, True, items_to_recommend=[11, 15, 14, 999]))) == {10: [14, 15], 80: [11, 14, 15]}
    assert ids(lists(model.recommend([10, 80], popular, 3, False))) == {10: [12, 11, 14], 80: [12, 11, 14]}
    assert ids(lists(model.recommend_to_items([11, 13, 16], popular, 2), "target_item_id")) == {11: [12, 14], 13: [12, 11], 16: [12, 11]}
    assert "rank" not in model.recommend([10], popular, 1, False, add_rank_col=False).columns
    with pytest.raises(ValueError):
        O.PopularModel(popularity="strange")
    with pytest.raises(ValueError):
        O.PopularModel(period=WEEK, begin_from=datetime(2021, 1, 1))
    with pytest.raises(ValueError):
        model.recommend([10], popular, 0, False)
    with pytest.raises(NotFittedError):
        O.PopularModel().recommend([10], popular, 1, False)


@pytest.fixture(scope="module")
def categories(spark):  # noqa: ANN001
    features = spark.createDataFrame(list(zip([11, 11, 12, 12, 13, 13, 14, 14, 14], ["f1", "f2", "f1", "f2", "f1", "f2", "f1", "f2", "f3"], ["100", "a", "100", "b", "100", "b", "200", "c", "1"])), "id long, feature string, value string")
    return Dataset.construct(rows_of(spark, [r for r in POPULAR if r[1] != 15]), item_features_df=features, cat_item_features=("f2", "f1"))


def test_category_quotas():
    model = O.PopularInCategoryModel("f2")
    model.state = {"categories": ["b", "a", "c"], "totals": [6, 5, 2]}
    assert [model.quotas(k) for k in (13, 10, 3, 2)] == [[6, 5, 2], [5, 4, 1], [1, 1, 1], [1, 1, 0]]
    model.ratio_strategy = O.RatioStrategy.EQUAL
    assert [model.quotas(k) for k in (13, 3)] == [[5, 4, 4], [1, 1, 1]]


@pytest.mark.parametrize(("mixing", "expected"), [("group", [13, 12, 14, 11]), ("rotate", [13, 14, 11, 12])])
def test_categories_without_filter(categories, mixing, expected):  # noqa: ANN001
    model = O.PopularInCategoryModel("f2", popularity="mean_weight", mixing_strategy=mixing).fit(categories)
    assert ids(lists(model.recommend([10, 30, 80], categories, 4, False))) == {10: expected, 30: expected, 80: expected}


@pytest.mark.parametrize(("options", "k", "expected"), [
    ({"popularity": "n_interactions", "begin_from": datetime(2021, 11, 28)}, 2, {20: [12, 13], 40: [13], 50: [13, 11], 80: [12, 11]}),
    ({"popularity": "n_interactions", "period": timedelta(days=2)}, 2, {20: [12, 13], 40: [13], 50: [13, 11], 80: [12, 11]}),
    ({}, 4, {10: [14], 20: [12, 13], 40: [13, 14], 50: [13, 11, 14], 80: [12, 13, 11, 14]}), ({}, 1, {10: [14], 20: [12], 40: [13], 50: [13], 80: [12]}),
])
def test_categories_with_filter(categories, options, k, expected):  # noqa: ANN001
    model = O.PopularInCategoryModel("f2", mixing_strategy="group", ratio_strategy="equal", **options).fit(categories)
    assert ids(lists(model.recommend([10, 20, 40, 50, 80], categories, k, True))) == expected


def test_categories_errors(spark, categories, shared):  # noqa: ANN001
    white = O.PopularInCategoryModel("f2", mixing_strategy="group", ratio_strategy="equal").fit(categories)
    assert ids(lists(white.recommend([10, 20, 40, 50, 80], categories, 2, True, items_to_recommend=[12, 13]))) == {20: [12, 13], 40: [13], 50: [13], 80: [12, 13]}
    for options in ({"popularity": "x"}, {"n_categories": -1}, {"mixing_strategy": "x"}, {"ratio_strategy": "x"}):
        with pytest.raises(ValueError):
            O.PopularInCategoryModel("f2", **options)
    for name in ("strange", "f3"):
        with pytest.raises(ValueError):
            O.PopularInCategoryModel(name).fit(categories)
    with pytest.raises(ValueError):
        O.PopularInCategoryModel("f2").fit(shared)
    dense = Dataset.construct(shared.raw, item_features_df=spark.createDataFrame([(11, 1.0)], "id long, f2 double"), cat_item_features=("f2",), make_dense_item_features=True)
    with pytest.raises(TypeError):
        O.PopularInCategoryModel("f2").fit(dense)


def test_random(shared):  # noqa: ANN001
    model = O.RandomModel(random_state=3).fit(shared)
    found = lists(model.recommend([10, 20, 30, 40, 99], shared, 4, True))
    seen = {u: {i for v, i in SHARED if v == u} for u in (10, 20, 30, 40)}
    assert all(not set(ids(found)[u]) & seen[u] and len(found[u]) == min(4, 6 - len(seen[u])) for u in seen) and len(found[99]) == 4
    assert [s for _, s in found[99]] == [4, 3, 2, 1]
    again, other = O.RandomModel(random_state=3).fit(shared), lists(model.recommend([99], shared, 6, False))
    assert ids(lists(again.recommend([10, 20, 30, 40, 99], shared, 4, True))) == ids(found)
    assert sorted(ids(other)[99]) == [11, 12, 13, 14, 15, 17]


@pytest.mark.parametrize(("filter_viewed", "expected"), [
    (True, {10: [(15, 0.905), (13, 0.674)], 20: [(14, 1.352), (15, 0.737)]}), (False, {10: [(12, 2.568), (11, 2.442)], 20: [(12, 2.503), (11, 2.388)]}),
])
def test_knn(shared, filter_viewed, expected):  # noqa: ANN001
    got = lists(O.ItemKNNModel("tfidf", K=5).fit(shared).recommend([10, 20], shared, 2, filter_viewed))
    assert ids(got) == ids(expected)
    assert all(abs(a - b) < 6e-4 for u in expected for (_, a), (_, b) in zip(got[u], expected[u]))


def test_knn_items(shared):  # noqa: ANN001
    for weighting in ("plain", "cosine", "bm25"):
        model = O.ItemKNNModel(weighting, K=4).fit(shared)
        found = lists(model.recommend_to_items([11, 14], shared, 3), "target_item_id")
        assert all(t not in [i for i, _ in v] for t, v in found.items()) and len(found) == 2
    plain = lists(O.ItemKNNModel("plain", K=10).fit(shared).recommend_to_items([14], shared, 3, items_to_recommend=[12, 15]), "target_item_id")
    assert plain == {14: [(12, 2.0), (15, 1.0)]}


@pytest.mark.parametrize(("filter_viewed", "expected"), [
    (True, {10: [(15, 0.00788948), (13, 0.0039526)], 20: [(14, 0.00789337), (15, 0.00590922)]}), (False, {10: [(12, 0.00988546), (11, 0.00986199)], 20: [(12, 0.00791307), (11, 0.00789747)]}),
])
def test_ease(shared, filter_viewed, expected):  # noqa: ANN001
    reco = O.EASEModel(500.0).fit(shared).recommend([10, 20], shared, 2, filter_viewed)
    got = {(r["user_id"], r["rank"]): (r["item_id"], r["score"]) for r in reco.collect()}
    for u, own in expected.items():
        for rank, (item, score) in enumerate(own, 1):
            assert got[u, rank][0] == item and abs(got[u, rank][1] - score) < 1e-7
    items = lists(O.EASEModel(500.0).fit(shared).recommend_to_items([11], shared, 2), "target_item_id")
    assert 11 not in ids(items)[11] and len(items[11]) == 2


def dense_matrix() -> tuple[np.ndarray, list[int], list[int]]:
    users, items = sorted({u for u, _ in SHARED}), sorted({i for _, i in SHARED})
    x = np.zeros((len(users), len(items)))
    for u, i in SHARED:
        x[users.index(u), items.index(i)] = 1
    return x, users, items


def test_svd(shared):  # noqa: ANN001
    x, users, items = dense_matrix()
    u, s, v = np.linalg.svd(x, full_matrices=False)
    want = (u[:, :2] * s[:2]) @ v[:2]
    model = O.PureSVDModel(2, random_state=1).fit(shared)
    left, right = ({r["id"]: np.array(r["factors"]) for r in t.collect()} for t in model.get_vectors())
    got = np.array([[left[a] @ right[b] for b in items] for a in users])
    assert np.allclose(got, want, atol=1e-5)
    best = {a: sorted((i for i in items if (a, i) not in SHARED), key=lambda i: -want[users.index(a), items.index(i)])[:2] for a in (10, 20)}
    assert ids(lists(model.recommend([10, 20], shared, 2, True))) == best


@pytest.mark.parametrize("most", [factors.ROW_CELLS, 1])
def test_als_equals_dense_solution(shared, monkeypatch, most):  # noqa: ANN001
    monkeypatch.setattr(factors, "ROW_CELLS", most)  # 1: every row is spread over blocks
    x, users, items = dense_matrix()
    model = O.ALSModel(3, regularization=0.1, alpha=2.0, iterations=4, random_state=5).fit(shared)
    left, right = ({r["id"]: np.array(r["factors"]) for r in t.collect()} for t in model.get_vectors())
    p, q = np.array([left[u] for u in users]), np.array([right[i] for i in items])
    for j in range(len(items)):  # items were solved last
        c = 2.0 * x[:, j]
        a = p.T @ p + p.T @ (c[:, None] * p) + 0.1 * np.eye(3)
        assert np.allclose(np.linalg.solve(a, p.T @ ((1 + c) * (x[:, j] > 0))), q[j], atol=1e-8)
    assert np.allclose(gram_of(model.tables["users"], 3), p.T @ p)
    assert len(lists(model.recommend([10, 20], shared, 2, True))) == 2


@pytest.mark.parametrize("together", [True, False])
def test_als_keeps_explicit_features(spark, shared, together):  # noqa: ANN001
    users = spark.createDataFrame([(u, float(u), 1.0) for u in (10, 20, 30, 40)], "id long, a double, b double")
    items = spark.createDataFrame([(i, "f", str(i % 2)) for i in (11, 12, 13, 14, 15, 17)], "id long, feature string, value string")
    ds = Dataset.construct(shared.raw, users, make_dense_user_features=True, item_features_df=items, cat_item_features=("f",))
    model = O.ALSModel(2, iterations=2, random_state=1, fit_features_together=together).fit(ds)
    u, i = model.tables["users"].first(), model.tables["items"].first()
    assert len(u["factors"]) == len(i["factors"]) == 6
    place = slice(0, 2) if together else slice(2, 4)
    assert u["factors"][place] == [float(u["id"]), 1.0]
    assert sorted(i["factors"][4:]) == [0.0, 1.0]
    model.fit_partial(ds, 1)
    assert len(lists(model.recommend([10], ds, 3, False))[10]) == 3


def test_sgd_models_learn(spark):  # noqa: ANN001
    rng = np.random.default_rng(0)
    rows = [(u, int(rng.integers(0, 10)) + 10 * (u % 2), 1, "2021-01-01") for u in range(60) for _ in range(6)]
    ds = Dataset.construct(rows_of(spark, rows))
    for model in (O.BPRModel(8, iterations=15, learning_rate=0.1, random_state=1), O.LightFMModel(8, loss="warp", epochs=10, learning_rate=0.2, batch=8, random_state=1), O.LightFMModel(8, loss="bpr", epochs=15, learning_rate=0.2, batch=8, random_state=1)):
        reco = model.fit(ds).recommend(list(range(60)), ds, 5, False)
        right = reco.where((F.col("item_id") >= 10) == (F.col("user_id") % 2 == 1)).count() / reco.count()
        assert right > 0.8, type(model)
    logistic = O.LightFMModel(4, loss="logistic", epochs=1).fit(ds)
    assert len(lists(logistic.recommend([0, 999], ds, 3, True))) == 2  # a cold user gets the items of highest bias
    logistic.fit_partial(ds, 1)
    with pytest.raises(ValueError):
        O.LightFMModel(loss="x")


def test_bpr_users_stay_in_their_parts(spark, monkeypatch):  # noqa: ANN001
    """Small parts and chunks of items: only the items' parameters are on the driver, and the groups are still learned."""
    monkeypatch.setattr(sgd, "PART_CELLS", 20)
    monkeypatch.setattr(sgd, "CHUNK_ROWS", 7)
    monkeypatch.setattr(sgd, "MOST_NUMBERS", 200)  # 20 items of 9 numbers; users don't count
    rng = np.random.default_rng(0)
    rows = [(u, int(rng.integers(0, 10)) + 10 * (u % 2), 1, "2021-01-01") for u in range(60) for _ in range(6)]
    ds = Dataset.construct(rows_of(spark, rows))
    model = O.BPRModel(8, iterations=15, learning_rate=0.2, batch=8, random_state=1).fit(ds)
    reco = model.recommend(list(range(60)), ds, 5, False)
    assert reco.where((F.col("item_id") >= 10) == (F.col("user_id") % 2 == 1)).count() / reco.count() > 0.8
    assert model.tables["users"].count() == 60 and model.tables["items"].count() == 20


def test_lightfm_users_stay_in_their_parts(spark, monkeypatch):  # noqa: ANN001
    """Without features of users only the items' parameters travel; a partial fit goes on from the users' vectors."""
    for name, value in (("PART_CELLS", 20), ("CHUNK_ROWS", 7), ("MOST_NUMBERS", 200)):  # 20 items of 9 numbers; users don't count
        monkeypatch.setattr(sgd, name, value)
    rng = np.random.default_rng(0)
    rows = [(u, int(rng.integers(0, 10)) + 10 * (u % 2), 1, "2021-01-01") for u in range(60) for _ in range(6)]
    ds = Dataset.construct(rows_of(spark, rows))
    model = O.LightFMModel(8, loss="warp", epochs=15, learning_rate=0.2, batch=8, random_state=1).fit(ds)
    right = lambda: (r := model.recommend(list(range(60)), ds, 5, False)).where((F.col("item_id") >= 10) == (F.col("user_id") % 2 == 1)).count() / r.count()
    assert right() > 0.8 and model.tables["users"].count() == 60 and model.tables["items"].count() == 20
    before = {r["id"]: r["factors"] for r in model.tables["users"].collect()}
    model.fit_partial(ds, epochs=0)
    assert {r["id"]: r["factors"] for r in model.tables["users"].collect()} == before
    model.fit_partial(ds, epochs=1)
    assert {r["id"]: r["factors"] for r in model.tables["users"].collect()} != before and right() > 0.8


def test_warp_kos_reads_k_and_n(spark):  # noqa: ANN001
    scores = np.array([[0.1, 0.9, 0.5, 7.0], [3.0, 1.0, 2.0, 4.0], [2.0, 9.0, 9.0, 9.0]])
    assert kth_best(scores, np.array([3, 4, 1]), 2).tolist() == [2, 0, 0]  # places beyond a row's count are no draws
    assert kth_best(scores, np.array([3, 4, 1]), 9).tolist() == [0, 1, 0]
    rng = np.random.default_rng(0)
    rows = [(u, int(rng.integers(0, 10)) + 10 * (u % 2), 1, "2021-01-01") for u in range(60) for _ in range(6)]
    ds = Dataset.construct(rows_of(spark, rows))
    fit = lambda epochs=1, **own: O.LightFMModel(8, epochs=epochs, learning_rate=0.2, batch=8, random_state=1, **own).fit(ds)
    reco = fit(10, loss="warp-kos", k=2, n=4).recommend(list(range(60)), ds, 5, False)
    assert reco.where((F.col("item_id") >= 10) == (F.col("user_id") % 2 == 1)).count() / reco.count() > 0.8
    model, *others = [fit(loss="warp-kos", k=2, n=4), fit(loss="warp"), fit(loss="warp-kos", k=1, n=4), fit(loss="warp-kos", k=2, n=8)]
    assert all(not np.allclose(model.params["item"], o.params["item"]) for o in others)


def test_dssm(spark, shared):  # noqa: ANN001
    users = spark.createDataFrame([(u, "g", str(u % 3)) for u in (10, 20, 30, 40)], "id long, feature string, value string")
    items = spark.createDataFrame([(i, "f", str(i % 2)) for i in (11, 12, 13, 14, 15, 17)], "id long, feature string, value string")
    ds = Dataset.construct(shared.raw, users, ("g",), item_features_df=items, cat_item_features=("f",))
    found = lists(O.DSSMModel(8, max_epochs=2).fit(ds).recommend([10, 20], ds, 3, True))
    assert [s for _, s in found[10]] == sorted(s for _, s in found[10])  # distances: small ones first
    with pytest.raises(ValueError):
        O.DSSMModel().fit(shared)


def test_dssm_keeps_users_in_their_parts(spark, monkeypatch):  # noqa: ANN001
    from tidemark.operators.models import sgd

    rng = np.random.default_rng(0)
    ds_rows = rows_of(spark, [(u, int(rng.integers(0, 10)) * 2 + u % 2, 1, "2021-01-01") for u in range(300) for _ in range(6)])
    users = spark.createDataFrame([(u, "g", str(u % 2)) for u in range(302)], "id long, feature string, value string")  # two have features alone
    items = spark.createDataFrame([(i, "f", str(i % 2)) for i in range(22)], "id long, feature string, value string")  # so do two of these
    ds = Dataset.construct(ds_rows, users, ("g",), item_features_df=items, cat_item_features=("f",))
    monkeypatch.setattr(sgd, "MOST_NUMBERS", 1_000)  # the users' vectors alone have more
    monkeypatch.setattr(sgd, "PART_CELLS", 400)
    for name in ("numbered", "factor_table", "averaged_epoch"):  # these hold names, vectors and changes on the driver
        monkeypatch.setattr(sgd, name, None)
    model = O.DSSMModel(8, max_epochs=4, batch_size=32).fit(ds)
    people, things = ({r["id"]: r["factors"] for r in model.tables[x].collect()} for x in ("users", "items"))
    assert sorted(people) == list(range(302)) and sorted(things) == list(range(22))
    assert all(things[i] == things[i % 2] for i in things) and things[0] != things[1]  # equal features, equal vectors
    reco = model.recommend(list(range(300)), ds, 5, False)
    assert reco.count() == 1_500 and reco.where(F.col("item_id") % 2 == F.col("user_id") % 2).count() > 1_400
    assert lists(reco)[1] == lists(VectorRanker("euclidean", model.tables["users"], model.tables["items"]).rank(5).select(F.col("subject").alias("user_id"), F.col("object").alias("item_id"), "score", "rank"))[1]


def test_ranker_of_alike_objects(spark):  # noqa: ANN001
    kind = "id long, factors array<double>"
    left = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], kind)
    right = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], kind)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30, 3)], "s long, o long")
    allowed = spark.createDataFrame([(i,) for i in range(2, 60)], "id long")
    for more in ({}, {"filter_pairs": pairs}, {"filter_pairs": pairs, "whitelist": allowed}, {"exclude_self": True}):
        plain, alike = (VectorRanker("euclidean", left, right).rank(4, **more, alike=a).orderBy("subject", "rank").collect() for a in (False, True))
        assert plain == alike and len(plain) == 8


@pytest.mark.parametrize(("distance", "objects", "scores"), [
    ("dot", [2, 0, 1, 2, 1, 0], [296, 25, 12, 210, 10, 6]), ("cosine", [0, 2, 1, 1, 2, 0], [1, 0.5890328, 0.5366563, 1, 0.9344414, 0.5366563]),
    ("euclidean", [0, 1, 2, 1, 0, 2], [0, 4.58257569, 97.64220399, 2.23606798, 4.24264069, 98.41747812]),
])
def test_ranker(spark, distance, objects, scores):  # noqa: ANN001
    kind = "id long, factors array<double>"
    left = spark.createDataFrame([(0, [-4.0, 0.0, 3.0]), (1, [0.0, 1.0, 2.0])], kind)
    right = spark.createDataFrame([(0, [-4.0, 0.0, 3.0]), (1, [0.0, 2.0, 4.0]), (2, [1.0, 10.0, 100.0])], kind)
    got = VectorRanker(distance, left, right).rank(3).orderBy("subject", "rank").collect()
    assert [r["object"] for r in got] == objects and np.allclose([r["score"] for r in got], scores, atol=1e-4)
    pairs = spark.createDataFrame([(0, objects[0]), (1, 2)], "s long, o long")
    less = VectorRanker(distance, left, right).rank(3, pairs, spark.createDataFrame([(0,), (2,)], "id long"))
    assert less.count() == 2
    with pytest.raises(ValueError):
        VectorRanker(distance, left, right).rank(0)


def test_neighbour_lists(spark):  # noqa: ANN001
    kind = "id string, factors array<double>"
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 1.0]), ("e", [-1.0, 0.0])], kind)
    users = spark.createDataFrame([("u", [1.0, 0.05])], kind)
    i2i, u2i = ItemToItemAnnRecommender(items, index_top_k=4).fit(), UserToItemAnnRecommender(users, items, index_top_k=3).fit()
    assert i2i.get_item_list_for_item("a", 2) == ["b", "d"] and u2i.get_item_list_for_user("u", 2) == ["b", "a"] or u2i.get_item_list_for_user("u", 2) == ["a", "b"]
    assert i2i.get_item_list_for_item("a", 2, ["a", "c", "d"]) == ["d", "c"] and u2i.get_item_list_for_user("u", 2, ["c", "d"]) == ["d", "c"]
    allowed = spark.createDataFrame([(t, i) for t in "ab" for i in "abcd"], "target string, item_id string")
    got = {(r["target"], r["rank"]): r["item_id"] for r in i2i.get_item_list_for_item_batch(["a", "b"], 2, allowed).collect()}
    assert got == {("a", 1): "d", ("a", 2): "c", ("b", 1): "d", ("b", 2): "c"}  # the batch's own items are left out


def test_triplets(spark, shared):  # noqa: ANN001
    got = triplets(shared, 1).collect()
    assert len(got) == 4 and all((r["user_id"], r["positive"]) in SHARED and r["negative"] in {i for _, i in SHARED} for r in got)
    with pytest.raises(ValueError):
        triplets(Dataset.construct(shared.raw.withColumn("weight", F.lit(0.0))))


def test_recommend_from_scores(spark):  # noqa: ANN001
    scores = spark.createDataFrame([(0, 4.0), (1, 1.0), (2, 3.0), (3, 4.0)], "item_id long, score double")
    items = lambda **kw: [r["item_id"] for r in recommend_from_scores(scores, 2, **kw).collect()]
    black = spark.createDataFrame([(0,)], "item_id long")
    assert items() == [0, 3] and items(blacklist=black) == [3, 2] and items(whitelist=black) == [0] and items(ascending=True) == [1, 2]


def test_unsupported_targets(shared):  # noqa: ANN001
    model = O.EASEModel().fit(shared)
    with pytest.raises(ValueError, match="cold"):
        model.recommend([10, 99], shared, 2, True)
    with pytest.warns(UserWarning, match="cold"):
        assert len(lists(model.recommend([10, 99], shared, 2, True, on_unsupported_targets="warn"))) == 1
    assert len(lists(model.recommend([10, 99], shared, 2, True, on_unsupported_targets="ignore"))) == 1
    with pytest.raises(ValueError):
        model.recommend([10], shared, 2, True, on_unsupported_targets="x")


def test_configs_and_persistence(spark, shared, tmp_path):  # noqa: ANN001
    model = O.PopularModel("sum_weight", period=WEEK, inverse=True)
    config = model.get_config(simple_types=True)
    assert config["period"] == {"days": 7, "seconds": 0, "microseconds": 0} and config["popularity"] == "sum_weight"
    assert O.model_from_config(config).get_config() == model.get_config()
    assert O.model_from_params(model.get_params(simple_types=True)).get_config() == model.get_config()
    with pytest.raises(ValueError):
        O.PopularModel.from_config({"unknown": 1})
    with pytest.raises(TypeError):
        O.EASEModel.from_config(config)
    makers = [O.PopularModel(), O.EASEModel(10.0), O.ItemKNNModel(), O.PureSVDModel(2), O.SASRecModel(n_factors=8, n_blocks=1, n_heads=2, epochs=1, session_max_len=4), O.RandomModel(1)]
    for n, one in enumerate(makers):
        one.fit(shared)
        before = lists(one.recommend([10, 20], shared, 2, False))
        one.save(f"{tmp_path}/{n}", spark)
        again = O.load_model(f"{tmp_path}/{n}", spark)
        assert again.get_config() == one.get_config()
        assert lists(again.recommend([10, 20], shared, 2, False)) == before or isinstance(one, O.RandomModel)
    with pytest.raises(TypeError):
        O.EASEModel.load(f"{tmp_path}/0", spark)


def test_cross_validation(spark):  # noqa: ANN001
    rows = [(10, 11, 101), (10, 12, 102), (10, 11, 103), (20, 12, 101), (20, 11, 102), (20, 14, 103), (30, 11, 101), (30, 12, 102), (40, 11, 101), (40, 12, 102)]
    df = spark.createDataFrame([(u, i, 1.0, t, k) for k, (u, i, t) in enumerate(rows)], "user_id long, item_id long, weight double, datetime long, _row_id long")
    splitter = LastNSplitter(1, 2, filter_cold_items=False, filter_already_seen=False)
    kinds = {"precision@2": M.Precision(2), "recall@1": M.Recall(1)}
    got = cross_validate(Dataset.construct(df), splitter, kinds, {"popular": O.PopularModel()}, 2, False)
    assert got["metrics"] == [{"model": "popular", "i_split": 0, "precision@2": 0.5, "recall@1": 0.5}, {"model": "popular", "i_split": 1, "precision@2": 0.375, "recall@1": 0.25}]
    assert [(s["i_split"], s["train"], s["test"]) for s in got["splits"]] == [(0, 2, 2), (1, 6, 4)]
    ref = cross_validate(Dataset.construct(df), splitter, kinds | {"same": M.Intersection(1)}, {"popular": O.PopularModel(), "random": O.RandomModel(1)}, 2, False, ref_models=["popular"])
    assert {m["model"] for m in ref["metrics"]} == {"random"} and all("same_popular" in m for m in ref["metrics"])


def test_two_stages(spark):  # noqa: ANN001
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(1)
    rows = [(u, int(i), 1, f"2021-01-{d + 1:02d}") for u in range(30) for d, i in enumerate(rng.choice(12, 6, replace=False))]
    ds = Dataset.construct(rows_of(spark, rows))

    class Features(CandidateFeatureCollector):
        def get_item_features(self, items, dataset):  # noqa: ANN001, ANN202
            return dataset.raw.groupBy("item_id").agg(F.count("*").alias("n"))

    make = lambda m: CandidateRankingModel([CandidateGenerator(O.PopularModel(), 5, True, True, 0.0, 6), CandidateGenerator(O.PopularModel("mean_weight"), 5, True, False)], LastNSplitter(1), Reranker(m), PerUserNegativeSampler(2, 1), Features())
    model = make(LogisticRegression(maxIter=3))
    train = model.get_train_with_targets_for_reranker(ds)
    assert set(train.columns) == {"user_id", "item_id", "PopularModel_1_rank", "PopularModel_1_score", "PopularModel_2_rank", "target", "n"}
    assert train.where("target = 0").groupBy("user_id").count().where("count > 2").count() == 0
    model.fit(ds)
    found = lists(model.recommend(list(range(30)), ds, 3, True))
    assert len(found) == 30 and all(len(v) == 3 for v in found.values())
    assert len(lists(make(LinearRegression()).fit(ds).recommend([1], ds, 2, True))[1]) == 2
    generator = CandidateGenerator(O.PopularModel(), 2, True, True)
    with pytest.raises(NotFittedForStageError):
        generator.generate_candidates(ds.hot("user_id"), ds, True, for_train=True)
    with pytest.raises(ValueError):
        CandidateRankingModel([generator], LastNSplitter(1, 2), Reranker(None))


def test_negatives_are_kept_when_few(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, i, int(i == 0)) for i in range(4)] + [(2, i, 0) for i in range(2)], "user_id long, item_id long, target int")
    got = PerUserNegativeSampler(2, 7).sample_negatives(df)
    assert {r["user_id"]: r["count"] for r in got.groupBy("user_id").count().collect()} == {1: 3, 2: 2}


def numeric_check(f, x: np.ndarray) -> None:  # noqa: ANN001
    t = Tensor(x.copy())
    f(t).backward()
    for at in np.ndindex(*x.shape):
        d = np.zeros(x.shape)
        d[at] = 1e-6
        slope = (f(Tensor(x + d)).data - f(Tensor(x - d)).data) / 2e-6
        assert abs(slope - t.grad[at]) < 1e-5


def test_gradients():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(3, 4)), rng.normal(size=(4, 3))
    for act in (ag.sigmoid, ag.silu, ag.relu, ag.gelu, ag.softplus, ag.softmax, ag.log_softmax):
        numeric_check(lambda t, act=act: (act(t) * Tensor(w.T)).sum(), x)
    numeric_check(lambda t: (ag.layer_norm(t, Tensor(w[:, 0]), Tensor(w[:, 1])) * Tensor(w.T)).sum(), x)
    numeric_check(lambda t: (ag.unit(t) * Tensor(w.T)).sum(), x)
    numeric_check(lambda t: ((t @ Tensor(w)) @ t).rows(np.array([0, 2, 2])).sum(), x)
    numeric_check(lambda t: ag.log_softmax(t).pick(np.array([1, 0, 3])).sum(), x)
    items, y, neg = rng.normal(size=(6, 4)), np.array([[1, 0, 3]]), np.array([[[2, 4], [1, 1], [5, 2]]])
    for kind in ("softmax", "BCE", "gBCE", "sampled_softmax"):
        numeric_check(lambda t, kind=kind: loss_of(kind, t.reshape(1, 3, 4), Tensor(items), y, np.ones((1, 3)), None if kind == "softmax" else neg, 1, 0.2), x)


def test_heavy_users_are_shared_out(spark, monkeypatch):  # noqa: ANN001
    """Neighbours and the Gram matrix don't depend on how a heavy user's pairs are dealt."""
    rows = [(1, i, 1 + i % 3, "2021-01-01") for i in range(25)] + [(u, i, 1, "2021-01-01") for u in range(2, 9) for i in range(u % 3, 25, u)]
    ds = Dataset.construct(rows_of(spark, rows))

    def fitted() -> tuple:
        knn, ease = O.ItemKNNModel("cosine", 5).fit(ds), O.EASEModel(1.0).fit(ds)
        return sorted(map(tuple, knn.tables["similar"].collect())), {r[0]: r[1] for r in ease.tables["rows"].collect()}

    usual = fitted()
    monkeypatch.setattr(neighbours, "HEAVY", 4)
    near, weights = fitted()
    assert near == usual[0]
    assert all(np.allclose(weights[i], usual[1][i]) for i in usual[1])


def test_sessions(spark):  # noqa: ANN001
    rows = [(1, 11, 1, "2021-01-03"), (1, 12, 2, "2021-01-01"), (1, 13, 1, "2021-01-02"), (1, 14, 1, "2021-01-03"), (2, 11, 1, "2021-01-01")]
    df = Dataset.construct(rows_of(spark, rows)).raw
    got = {r["user_id"]: (r["items"], r["weights"]) for r in sessions(df, 3).collect()}
    assert got == {1: ([13, 11, 14], [1.0, 1.0, 1.0]), 2: ([11], [1.0])}
    assert [r["user_id"] for r in sessions(df, 3, 2).collect()] == [1]
    assert left_padded([[1, 2], [1, 2, 3, 4]], 3).tolist() == [[0, 1, 2], [2, 3, 4]]
    assert time_buckets(np.array([[0.0, 1.0, 1000.0]]))[0, 0].tolist() == [0, 0, int(np.log(1000) / 0.301)]


@pytest.mark.parametrize("kind", [O.SASRecModel, O.BERT4RecModel, O.HSTUModel, O.LiGRModel])
def test_sequence_models_learn_order(spark, kind):  # noqa: ANN001
    """Items follow each other in a ring; the next one is what a fitted model puts first."""
    rows = [(u, (u + d) % 6 + 100, 1, f"2021-01-{d + 1:02d}") for u in range(60) for d in range(5)]
    ds = Dataset.construct(rows_of(spark, rows))
    model = kind(n_factors=16, n_blocks=1, n_heads=2, session_max_len=6, epochs=40, batch_size=32, lr=0.02, mask_prob=0.4).fit(ds)
    context = spark.createDataFrame([(u, datetime(2021, 1, 6)) for u in range(6)], "user_id long, datetime timestamp")
    reco = model.recommend(list(range(6)), ds, 1, False, context=context)
    right = sum(r["item_id"] == (r["user_id"] + 5) % 6 + 100 for r in reco.collect())
    assert right >= (6 if kind is not O.BERT4RecModel else 4), right
    assert len(lists(model.recommend_to_items([100], ds, 2), "target_item_id")[100]) == 2
    if kind is O.HSTUModel:
        with pytest.raises(ValueError, match="context"):
            kind().recommend([1], ds, 1, False)


def in_parts(monkeypatch, tokens=5, sessions=25):  # noqa: ANN001, ANN201
    for name, value in (("WHOLE_TOKENS", tokens), ("POOL_TOKENS", 64), ("LARGE_PART_SESSIONS", sessions), ("PART_SESSIONS", sessions), ("CHUNK_TOKENS", 4)):
        monkeypatch.setattr(sequential, name, value)


@pytest.mark.parametrize(("kind", "extra"), [(O.SASRecModel, 1), (O.HSTUModel, 1), (O.LiGRModel, 1), (O.BERT4RecModel, 2)])
def test_parts_train_the_tokens_they_meet(spark, monkeypatch, kind, extra):  # noqa: ANN001
    """Of a large catalog, no part gets or returns more than what it meets, the order is learned all the same, and ids that
    fall into one part alone come out as that part made them."""
    in_parts(monkeypatch)
    rows = [(u, (u + d) % 6 + 100, 1, f"2021-01-{d + 1:02d}") for u in range(60) for d in range(5)]
    ds = Dataset.construct(rows_of(spark, rows))
    own = {"n_factors": 16, "n_blocks": 1, "n_heads": 2, "session_max_len": 6, "batch_size": 8, "lr": 0.02, "mask_prob": 0.4, "loss": "sampled_softmax", "n_negatives": 8}
    model = kind(**own, epochs=10 if extra == 1 else 25).fit(ds)
    assert model.net.table.dtype == np.float32 and model.net.table.shape == (6 + extra, 16) and "item" not in model.net.p
    context = spark.createDataFrame([(u, datetime(2021, 1, 6)) for u in range(6)], "user_id long, datetime timestamp")
    reco = model.recommend(list(range(6)), ds, 1, False, context=context)
    assert sum(r["item_id"] == (r["user_id"] + 5) % 6 + 100 for r in reco.collect()) >= (5 if extra == 1 else 4)  # masked items teach less
    assert (kind(**own, epochs=2).fit(ds).net.table == kind(**own, epochs=2).fit(ds).net.table).all()


def test_sequence_parts_are_replaceable(spark, tmp_path):  # noqa: ANN001
    rows = [(u, (u + d) % 6 + 100, 1, f"2021-01-{d + 1:02d}") for u in range(60) for d in range(5)]
    ds = Dataset.construct(rows_of(spark, rows))
    small = {"n_factors": 16, "n_blocks": 1, "n_heads": 2, "session_max_len": 6, "batch_size": 32, "lr": 0.02}
    model = O.SASRecModel(**small, epochs=30, similarity="cosine", hold_out=leave_one_out, dropout_rate=0.1).fit(ds)
    # The held-out item follows from those before, so the loss is below that of a guess among six by cosine.
    assert 0 < model.validation_loss < np.log(6)
    assert O.SASRecModel(**small, epochs=1).fit(ds).validation_loss is None
    model.save(f"{tmp_path}/model")
    assert O.SASRecModel.load(f"{tmp_path}/model", spark).hold_out is leave_one_out

    def first_item(rng, shape, first, n_items):  # noqa: ANN001, ANN202
        assert n_items == 6
        return np.full(shape, first)

    def vectors(**more):  # noqa: ANN003, ANN202
        fitted = O.SASRecModel(**small, epochs=2, loss="BCE", n_negatives=2, **more).fit(ds)
        return fitted.net.items().data

    drawn, usual = vectors(negative_sampler=first_item), vectors()
    assert (drawn == vectors(negative_sampler=first_item)).all() and not np.allclose(drawn, usual)
    assert O.HSTUModel().similarity == "cosine" and O.SASRecModel().similarity == "dot"
    for wrong in ({"similarity": "euclidean"}, {"dropout_rate": 1.0}, {"use_ids": False, "use_categories": False}):
        with pytest.raises(ValueError):
            O.SASRecModel(**wrong)
    net = Network("sasrec", 4, 2, 4, 1, 1, 0, np.array([[0, 0], [1, 0], [0, 1], [0, 1]]), use_ids=False)
    assert (net.items().data[2] == net.items().data[3]).all()


def test_reports(spark, shared, tmp_path):  # noqa: ANN001
    reco = O.PopularModel().fit(shared).recommend([10, 20, 30], shared, 2, False)
    data = spark.createDataFrame([(11, "a", 1.0), (12, "b", 2.0)], "item_id long, title string, score double")
    storage = ReportStorage.from_raw({"one": reco, "two": reco}, shared.raw.select("user_id", "item_id"), data, {"first": 10}, 1)
    assert len(storage.request_names) == 2 and storage.model_names == ["one", "two"] and "score_item_data" in storage.reco.columns
    storage.save(f"{tmp_path}/report")
    assert ReportStorage.load(spark, f"{tmp_path}/report").request_names == storage.request_names
    with pytest.raises(ValueError):
        ReportStorage.from_raw(reco.withColumn("model", F.lit("x")), shared.raw, data)
    table = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 2.0)], "model string, i_split int, ndcg double")
    report = MetricsReport.construct(table, spark.createDataFrame([("a", "x")], "model string, kind string"))
    assert report.fold_ids == [0, 1] and {r["model"]: (r["kind"], r["ndcg"]) for r in report.average().collect()} == {"a": ("x", 2.0), "b": (None, 2.0)}
    with pytest.raises(ValueError):
        MetricsReport.construct(table.where("not (model = 'a' and i_split = 1)"))


def test_products_in_blocks_and_rounds(spark, shared, monkeypatch):  # noqa: ANN001
    """Neighbours don't depend on blocks, on rounds or on rows that are dealt to several blocks, and no pair is joined in Spark."""
    rng = np.random.default_rng(4)
    rows = [(u, int(i), int(rng.integers(1, 4)), "2021-01-01") for u in range(40) for i in {0, 1, *rng.integers(0, 30, 8)}]
    ds = Dataset.construct(rows_of(spark, rows))
    named = Dataset.construct(rows_of(spark, rows).withColumns({"item_id": F.concat(F.lit("i"), F.lpad(F.col("item_id").cast("string"), 3, "0")), "user_id": F.concat(F.lit("u"), F.col("user_id").cast("string"))}))

    def fitted(ds: Dataset, hide: bool) -> tuple:
        model = O.ItemKNNModel("tfidf", 5).fit(ds)
        reco = model.recommend(ds.hot("user_id"), ds, 4, hide)
        assert "Join" not in model.tables["similar"]._jdf.queryExecution().optimizedPlan().toString() or ds is named
        plain = lambda v: int(str(v).lstrip("ui"))
        return sorted((plain(a), plain(b), c) for a, b, c in model.tables["similar"].collect()), sorted((plain(r[0]), plain(r[1]), round(r[2], 5), r[3]) for r in reco.collect())

    usual = [fitted(ds, hide) for hide in (True, False)]
    assert len(usual[0][1]) == 160 and not {(u, i) for u, i, *_ in usual[0][1]} & {(u, i) for u, i, *_ in rows}
    assert fitted(named, True) == usual[0]
    monkeypatch.setattr(products, "BLOCK_TERMS", 60)  # most rows are hot
    monkeypatch.setattr(products, "ROUND_TERMS", 1_500)
    assert [fitted(ds, hide) for hide in (True, False)] == usual


@pytest.mark.parametrize("distance", list(Distance))
def test_nearest_equals_brute_force(distance):  # noqa: ANN001
    rng = np.random.default_rng(7)
    for q, c in ((rng.normal(size=(40, 5)), rng.normal(size=(9_000, 5))), (np.round(rng.normal(size=(40, 2))), np.round(rng.normal(size=(300, 2)))), (rng.normal(size=(9, 3)), 1_000 + rng.normal(size=(50, 3)))):
        hidden = np.unique(rng.integers(0, len(q) * len(c), len(q) * len(c) // 3))
        row, column, score = nearest(q, c, 7, distance, hidden, np.bincount(hidden // len(c), minlength=len(q)))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10) if distance is Distance.COSINE else x for x in (q, c))
        for i in range(len(q)):
            s = np.round(-np.sqrt(((b - a[i]) ** 2).sum(1)) if distance is Distance.EUCLIDEAN else (b * a[i]).sum(1), 12)
            s[hidden[hidden // len(c) == i] % len(c)] = -np.inf
            want = np.lexsort((np.arange(len(c)), -s))[:7]
            assert column[row == i].tolist() == want.tolist() and np.allclose(score[row == i], s[want], atol=1e-11)


@pytest.mark.parametrize("distance", list(Distance))
def test_search_takes_little_more_memory_than_the_objects(distance):  # noqa: ANN001
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(50, 16)), rng.normal(size=(200_000, 16)).astype(np.float32)
    tracemalloc.start()
    got = nearest(q, Catalog(c, distance), 5, distance, np.zeros(0, np.int64), np.zeros(len(q), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * c.nbytes  # beside the objects: lengths, their order and a block
    want = nearest(q, c.astype(float), 5, distance, np.zeros(0, np.int64), np.zeros(len(q), np.int64))
    assert (got[1] == want[1]).all() and (got[2] == want[2]).all()


@pytest.mark.parametrize("names", [[5, 3, 9, 3, -2, 70, 8], ["b", "a", "é", "a", "ab", "B"]])
def test_ids_are_numbered_and_vectors_written_in_tasks(spark, names):  # noqa: ANN001
    values = spark.createDataFrame([(x,) for x in names], "x " + ("long" if isinstance(names[0], int) else "string")).repartition(3)
    table, n = in_order(values, 2)
    by_bytes = sorted(set(names), key=lambda x: x if isinstance(x, int) else x.encode())
    assert n == len(by_bytes) and {r["x"]: r["i"] for r in table.collect()} == {x: i + 2 for i, x in enumerate(by_bytes)}
    vectors = np.arange(2.0 * (n + 2)).reshape(-1, 2).astype(np.float32)
    found = {r["id"]: (r["factors"], r["bias"]) for r in vectors_of(table, vectors, np.arange(n + 2.0)).collect()}
    assert found == {x: ([2.0 * i + 4, 2.0 * i + 5], i + 2.0) for i, x in enumerate(by_bytes)}
    assert in_order(values.limit(0))[1] == 0


def test_rows_are_solved_together(spark, monkeypatch):  # noqa: ANN001
    """Rows of all lengths that are solved together come out as one by one; those that are spread, too."""
    rng = np.random.default_rng(3)
    cells = [(r, int(c), float(rng.integers(-2, 4))) for r in range(40) for c in rng.permutation(60)[: 1 + r % 30]]
    y = rng.normal(size=(60, 4))
    fixed = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, factors array<double>")
    table = spark.createDataFrame(cells, "row long, col long, weight double")
    for most, at_a_time in ((50_000, 100), (7, 100), (7, 16_384)):
        monkeypatch.setattr(factors, "ROW_CELLS", most)
        monkeypatch.setattr(factors, "SOLVED_CELLS", at_a_time)
        got = {r["id"]: r["factors"] for r in factors.half_step(factors.blocked(table), fixed, y.T @ y, 0.5, 2.0).collect()}
        assert sorted(got) == list(range(40))
        for row, own in got.items():
            a, b = y.T @ y + 0.5 * np.eye(4), np.zeros(4)
            for _, c, w in (x for x in cells if x[0] == row):
                a, b = a + abs(2 * w) * np.outer(y[c], y[c]), b + (1 + 2 * w if w > 0 else 0) * y[c]
            assert np.allclose(np.linalg.solve(a, b), own)


def test_svd_sums_travel_in_chunks(shared, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(factors, "CHUNK_ITEMS", 2)  # the sums of six items
    x, users, items = dense_matrix()
    left, right = ({r["id"]: np.array(r["factors"]) for r in t.collect()} for t in O.PureSVDModel(3, random_state=1).fit(shared).get_vectors())
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose([[left[a] @ right[b] for b in items] for a in users], (u[:, :3] * s[:3]) @ v[:3], atol=1e-5)


@pytest.mark.parametrize("distance", [Distance.DOT, Distance.COSINE])
def test_alike_subjects_meet_few_objects(distance, monkeypatch):  # noqa: ANN001
    """Subjects close to few directions are not multiplied with all objects, and lists are those of brute force."""
    rng = np.random.default_rng(5)
    q = np.concatenate([v + 0.01 * rng.normal(size=(2_048, 16)) for v in 2 * rng.normal(size=(3, 16))])[rng.permutation(3 * 2_048)]
    c, met, block = rng.normal(size=(50_000, 16)), [], Catalog.block
    monkeypatch.setattr(Catalog, "block", lambda self, *a: met.append(len(out := block(self, *a))) or out)
    row, column, score = nearest(q, c, 5, distance, np.zeros(0, np.int64), np.zeros(len(q), np.int64))
    assert sum(met) < 3 * len(c) / 4
    one = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) if distance is Distance.COSINE else x
    for i in range(0, len(q), 500):
        s = np.round(one(c) @ one(q)[i], 12)
        assert column[row == i].tolist() == np.lexsort((np.arange(len(c)), -s))[:5].tolist()
    assert (np.diff(row) >= 0).all()


def test_cells_return_what_a_list_can_hold(spark, monkeypatch):  # noqa: ANN001
    """The lists stay, ties included, and cells return fewer pairs where the best objects for the mean subject are known."""
    rng = np.random.default_rng(6)
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, factors array<double>")
    subjects, objects = table(np.r_[1 + 0.1 * rng.normal(size=(60, 3)), np.zeros((1, 3)), -np.ones((1, 3))]), table(np.round(rng.normal(size=(900, 3)), 1))
    monkeypatch.setattr(rank, "OBJECT_NUMBERS", 1)  # blocks of 256
    found = []
    for seeds in (40, 1_000):
        monkeypatch.setattr(rank, "SEEDS", seeds)
        lists = VectorRanker("dot", subjects, objects).rank(5)
        found.append((sorted(map(tuple, lists.collect())), found_pairs(lists)))
    assert found[0][0] == found[1][0] and len(found[0][0]) == 62 * 5 and found[0][1] < found[1][1] / 2


def found_pairs(lists):  # noqa: ANN001, ANN201
    """Rows that the cells of a ranking returned."""
    plan = lists._jdf.queryExecution().optimizedPlan()
    while "FlatMapCoGroups" not in plan.nodeName():
        plan = plan.children().head()
    spark = lists.sparkSession
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count()


@pytest.mark.parametrize("kind", [O.SASRecModel, O.BERT4RecModel, O.LiGRModel])
def test_lists_continue_the_sessions_of_the_fit(spark, monkeypatch, kind):  # noqa: ANN001
    """The history is read and sorted once for a fit and its lists; those are the lists of sessions made anew."""
    rows = [(u, (u * d) % 7 + 100, 1, f"2021-01-{d + 1:02d}") for u in range(20) for d in range(1 + u % 9)] + [(50, 999, 1, "2021-01-01"), (51, 103, 1, "2021-01-01")]
    ds, again = (Dataset.construct(rows_of(spark, rows)) for _ in range(2))
    model = kind(n_factors=8, n_blocks=1, n_heads=2, session_max_len=4, epochs=1, train_min_user_interactions=3).fit(ds)
    calls = []
    monkeypatch.setattr(sequential, "sessions", lambda *a: calls.append(a) or sessions(*a))
    users = [*range(15), 50, 51]
    assert lists(model.recommend(users, ds, 3, False)) == lists(model.recommend(users, again, 3, False))
    assert len(calls) == 1 and calls[0][0] is not ds.raw


def test_positions_without_a_target_cost_nothing(spark, monkeypatch):  # noqa: ANN001
    in_parts(monkeypatch)
    rows = [(u, (u + d) % 6 + 100, 1, f"2021-01-{d + 1:02d}") for u in range(60) for d in range(5)]
    model, seen = O.BERT4RecModel(n_factors=8, n_blocks=1, n_heads=2, session_max_len=6, batch_size=8, mask_prob=0.2, loss="sampled_softmax", n_negatives=3), []
    model.n_items, net = 6, Network("bert4rec", 8, 6, 8, 1, 2, 0, None, True, False)
    tokens = np.array([[(u + d) % 6 + 2 for d in range(6)] for u, *_ in rows])
    monkeypatch.setattr(sequential, "loss_of", lambda kind, states, items, y, *a: seen.append((states.shape[:2], y.size, int((y != 0).sum()))) or loss_of(kind, states, items, y, *a))
    model.train(net, ag.Adam(net.p, 0.01), {"items": tokens, "weights": np.ones(tokens.shape), "times": np.ones(tokens.shape)}, 1, np.random.default_rng(1), np.arange(2, 8))
    assert seen and all(size == targets and shape == (1, targets) for shape, size, targets in seen)


def test_svd_item_side_stays_where_it_is(shared, monkeypatch):  # noqa: ANN001
    """The item side is made orthonormal in slices without a copy, and passes in single precision and by columns find the same factors."""
    a = np.random.default_rng(4).normal(size=(100_000, 12)) @ np.random.default_rng(5).normal(size=(12, 12))
    whole, size = a.copy(), a.nbytes
    monkeypatch.setattr(factors, "SLICE_ITEMS", 3_001)
    tracemalloc.start()
    factors.orthonormal(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size / 4 and np.allclose(a.T @ a, np.eye(12)) and np.allclose(a @ (a.T @ whole), whole)
    for name, value in (("SLICE_ITEMS", 4), ("SINGLE_NUMBERS", 0), ("CHUNK_ITEMS", 2)):
        monkeypatch.setattr(factors, name, value)
    x, users, items = dense_matrix()
    left, right = ({r["id"]: np.array(r["factors"]) for r in t.collect()} for t in O.PureSVDModel(3, random_state=1).fit(shared).get_vectors())
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose([[left[a] @ right[b] for b in items] for a in users], (u[:, :3] * s[:3]) @ v[:3], atol=1e-5)
