"""Metrics on the reference fixtures' facts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators.metrics.base import debias_border, make_confusions, outer_merge_reco
from tidemark.plans.metrics import calc_merged_metrics, calc_metrics, calc_per_user, metric_table
from tidemark.sources.features import SparseFeatures
from tidemark.sources.idmap import IdMap

RECO = "user_id long, item_id long, rank int"
PAIR = "user_id long, item_id long"


@pytest.fixture(scope="module")
def batch(spark):  # noqa: ANN001
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "reco": make([(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 1), (5, 1, 2)], RECO), "interactions": make([(1, 1), (1, 2), (2, 2), (4, 1), (5, 1)], PAIR),
        "prev_interactions": make([(1, 1), (1, 2), (1, 1), (2, 1)], PAIR), "catalog": list(range(10)),
        "ref_reco": {"one": make([(1, 1, 1), (1, 3, 2), (2, 1, 1), (3, 1, 3), (5, 2, 2)], RECO), "two": make([(1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 1, 1), (5, 1, 1)], RECO)},
    }


# Metrics and what the reference gives for the batch.
EXPECTED = {
    "prec@1": (M.Precision(1), 0.25), "prec@2": (M.Precision(2), 0.375), "rprec@2": (M.Precision(2, r_precision=True), 0.5), "rec@1": (M.Recall(1), 0.125), "acc@1": (M.Accuracy(1), 0.825),
    "hit@1": (M.HitRate(1), 0.25), "map@1": (M.MAP(1), 0.125), "map@2": (M.MAP(2), 0.375), "ndcg@1": (M.NDCG(1, log_base=3), 0.25), "pauc@1": (M.PartialAUC(1), 0.25), "pauc@2": (M.PartialAUC(2), 0.375),
    "pap@1": (M.PAP(1), 0.25), "pap@2": (M.PAP(2), 0.375), "mrr@1": (M.MRR(1), 0.25), "miuf@3": (M.MeanInvUserFreq(3), 0.125), "arp@2": (M.AvgRecPopularity(2), 2.75), "ser@3": (M.Serendipity(3), 0.0),
    "suff@2": (M.SufficientReco(2), 0.25), "unrep@2": (M.UnrepeatedReco(2), 1.0), "cov_users@2": (M.CoveredUsers(2), 0.75), "cov@2": (M.CatalogCoverage(2, normalize=True), 0.2),
}


def test_batch(spark, batch):  # noqa: ANN001
    features = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "item_id long, feature_1 int, feature_2 int")
    kinds = {n: m for n, (m, _) in EXPECTED.items()} | {"ild@3": M.IntraListDiversity(3, M.PairwiseHammingDistanceCalculator(features)), "same": M.Intersection(2, 2)}
    got = calc_metrics(kinds, **batch)
    want = {n: v for n, (_, v) in EXPECTED.items()} | {"ild@3": 0.25, "same_one": 0.375, "same_two": 0.75}
    assert set(got) == set(want)
    assert all(math.isclose(got[n], v, abs_tol=1e-6) for n, v in want.items()), {n: (got[n], v) for n, v in want.items() if not math.isclose(got[n], v, abs_tol=1e-6)}


@pytest.mark.parametrize(("metric", "missing"), [(M.Precision(1), "interactions"), (M.MeanInvUserFreq(1), "prev_interactions"), (M.Accuracy(1), "catalog"), (M.Intersection(1), "ref_reco"), (M.CatalogCoverage(1, normalize=True), "catalog")])
def test_missing_inputs(batch, metric, missing):  # noqa: ANN001
    with pytest.raises(ValueError, match=missing):
        calc_metrics({"m": metric}, **{k: v for k, v in batch.items() if k != missing})


def test_custom_metrics_are_refused(batch):  # noqa: ANN001
    class Own(M.MetricAtK):
        pass

    with pytest.warns(UserWarning, match="Custom"):
        assert calc_metrics({"own": Own(1)}, **batch) == {}
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            M.Recall(bad)
    with pytest.raises(KeyError):
        calc_metrics({"m": M.Recall(1)}, batch["reco"].drop("rank"), batch["interactions"])


def per_user(table, name: str) -> list:  # noqa: ANN001
    return [r[name] for r in table.orderBy("user_id").collect()]




def test_auc_fills_rank_gaps(spark):  # noqa: ANN001
    reco = spark.createDataFrame([(1, 1, 1), (2, 7, 1), (2, 1, 3)], RECO)
    test = spark.createDataFrame([(1, 1), (1, 5), (2, 1), (2, 1), (3, 4)], PAIR)
    merged = {(r["user_id"], r["rank"]): r["__test_positive"] for r in outer_merge_reco(reco, test).collect()}
    assert merged[2, 2] is False and merged[2, 3] is True and merged[2, 1] is False
    got = calc_per_user({"a": M.PartialAUC(3), "b": M.PAP(1), "x": M.PartialAUC(2, insufficient_handling="exclude")}, reco, test)
    assert per_user(got, "a") == [0.5, 1 / 3, 0.0]
    assert per_user(got, "x") == [None, 0.0, None]
    with pytest.raises(ValueError):
        metric_table({"r": M.PAP(3, insufficient_handling="raise")}, reco, test)


def test_repeated_interactions(spark):  # noqa: ANN001
    reco = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)], RECO)
    test = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 1)], PAIR)
    got = per_user(calc_per_user({"m": M.MAP(3)}, reco, test), "m")
    assert got[1] == 1.0 and math.isclose(got[0], 3.5 / 3)  # a repeated row counts in the running sum, not as a term
    assert per_user(calc_per_user({"m": M.PartialAUC(2)}, reco, test), "m") == [1.0, 1.0]


def test_f1_and_mcc(spark):  # noqa: ANN001
    reco = spark.createDataFrame([(1, 1, 1), (1, 9, 2), (2, 1, 1), (2, 2, 2), (3, 9, 1)], RECO)
    test = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (4, 5)], PAIR)
    got = calc_per_user({"f": M.F1Beta(2, beta=2**0.5), "m": M.MCC(2), "k": M.MAP(2, divide_by_k=True)}, reco, test, catalog=list(range(10)))
    f1 = lambda tp, liked: 3 * (tp / 2) * (tp / liked) / (2 * tp / 2 + tp / liked) if tp else 0.0
    assert all(map(math.isclose, per_user(got, "f"), [f1(1, 2), f1(2, 3), 0.0, 0.0]))

    def mcc(tp: int, liked: int) -> float:
        fp, fn = 2 - tp, liked - tp
        tn = 10 - 2 - fn
        below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
        return (tp * tn - fp * fn) / below**0.5

    assert all(map(math.isclose, per_user(got, "m"), [mcc(1, 2), mcc(2, 3), mcc(0, 1), mcc(0, 1)]))


def test_ndcg_against_the_best_possible(spark):  # noqa: ANN001
    reco = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3)], RECO)
    test = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], PAIR)
    got = calc_per_user({"a": M.NDCG(3, divide_by_achievable=True), "b": M.NDCG(3)}, reco, test)
    assert all(map(math.isclose, per_user(got, "a"), [1.0, 0.5, 0.0]))
    assert math.isclose(per_user(got, "b")[0], (1 + 1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5))


def test_serendipity_and_popularity(spark):  # noqa: ANN001
    kind = "user_id string, item_id string, rank int"
    reco = spark.createDataFrame([("u1", "i1", 1), ("u1", "i2", 2), ("u2", "i2", 1), ("u2", "i3", 2), ("u3", "i3", 1), ("u4", "i2", 1), ("u4", "i3", 2)], kind)
    test = spark.createDataFrame([("u1", "i1"), ("u1", "i2"), ("u2", "i2"), ("u2", "i3"), ("u3", "i2"), ("u4", "i2")], "user_id string, item_id string")
    prev = spark.createDataFrame([("u1", "i1"), ("u1", "i2"), ("u2", "i1"), ("u2", "i2"), ("u3", "i1")], "user_id string, item_id string")
    catalog = ("i1", "i2", "i3", "i4")
    one = calc_per_user({"s": M.Serendipity(1)}, reco, test, prev, catalog)
    two = calc_per_user({"s": M.Serendipity(2), "p": M.AvgRecPopularity(2, normalize=True)}, reco, test, prev, catalog)
    assert per_user(one, "s") == [0, 0.25, 0, 0.25] and per_user(two, "s") == [0, 0.5, 0, 0.125]
    assert all(map(math.isclose, per_user(two, "p"), [0.5, 0.2, 0.0, 0.2]))


def test_deep_data_quality(spark):  # noqa: ANN001
    reco = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 1, 1), (3, 1, 5)], RECO)
    got = calc_per_user({"s": M.SufficientReco(3, deep=True), "u": M.UnrepeatedReco(3, deep=True), "v": M.UnrepeatedReco(3)}, reco)
    assert per_user(got, "s") == [1.0, 1 / 3, 0.0] and per_user(got, "u") == [2 / 3, 1.0, None] and per_user(got, "v") == [0.0, 1.0, None]


def test_debias(spark):  # noqa: ANN001
    rows = list(zip([1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5, 5, 6, 7, 8], [1, 2, 1, 1, 2, 3, 4, 5, 6, 1, 1, 2, 3, 1, 1, 1]))
    df = spark.createDataFrame(rows, PAIR)
    config = M.DebiasConfig(random_state=32)
    assert debias_border(df, config).first()[0] == 5
    got = M.debias_interactions(df, config)
    counts = {r["item_id"]: r["count"] for r in got.groupBy("item_id").count().collect()}
    assert counts == {1: 5, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1} and got.count() == 13
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.debias_interactions(df, config).collect()))
    reco = df.withColumn("rank", F.lit(1))
    both = calc_metrics({"d": M.HitRate(1, debias_config=config), "p": M.HitRate(1)}, reco, df)
    assert both == {"d": 1.0, "p": 1.0} and M.debias_interactions(df.limit(0), config).collect() == []


def test_distances(spark):  # noqa: ANN001
    pairs = spark.createDataFrame([("i1", "i2"), ("i1", "i9"), ("i2", "i2")], "item_a string, item_b string")
    dense = M.PairwiseHammingDistanceCalculator(spark.createDataFrame([("i1", 1, "a"), ("i2", 2, "a")], "item_id string, x int, y string"))
    assert sorted(map(tuple, dense.distances(pairs).collect())) == [("i1", "i2", 1.0), ("i1", "i9", None), ("i2", "i2", 0.0)]
    ids = IdMap.from_dict(spark, {"i1": 0, "i2": 1, "i3": 2})
    flat = spark.createDataFrame([("i1", "f", "a"), ("i2", "f", "b"), ("i2", "g", "c")], "id string, feature string, value string")
    sparse = M.SparsePairwiseHammingDistanceCalculator(SparseFeatures.from_flatten(flat, ids, ("f", "g")), ids)
    more = pairs.unionByName(spark.createDataFrame([("i1", "i3")], "item_a string, item_b string"))
    assert sorted(map(tuple, sparse.distances(more).collect())) == [("i1", "i2", 3.0), ("i1", "i3", 1.0), ("i1", "i9", None), ("i2", "i2", 0.0)]


def test_single_metrics(batch):  # noqa: ANN001
    reco, test, prev, catalog, refs = (batch[k] for k in ("reco", "interactions", "prev_interactions", "catalog", "ref_reco"))
    assert M.Precision(2).calc(reco, test) == 0.375 and math.isclose(M.Accuracy(1).calc(reco, test, catalog), 0.825) and M.AvgRecPopularity(2).calc(reco, prev) == 2.75
    assert M.Serendipity(3).calc(reco, test, prev, catalog) == 0 and M.CatalogCoverage(2, normalize=True).calc(reco, catalog) == 0.2 and M.SufficientReco(2).calc(reco) == 0.25
    assert M.Intersection(2, 2).calc(reco, refs["one"]) == 0.375
    assert per_user(M.Recall(2).calc_per_user(reco, test), "value") == [1.0, 0.0, 0.0, 1.0]


def test_merged_metrics(batch):  # noqa: ANN001
    merged = M.merge_reco(batch["reco"], batch["interactions"])
    got = calc_merged_metrics({"p": M.Precision(2), "m": M.MAP(1), "a": M.Accuracy(1)}, merged, batch["catalog"])
    assert got["p"] == 0.375 and got["m"] == 0.125 and math.isclose(got["a"], 0.825)
    with pytest.raises(ValueError, match="catalog"):
        calc_merged_metrics({"a": M.MCC(1)}, merged)
    rows = {r["user_id"]: (r["liked"], r["tp"], r["fp"], r["fn"]) for r in make_confusions(batch["reco"], batch["interactions"], 2).collect()}
    assert rows == {1: (2, 2, 0, 0), 2: (1, 0, 2, 1), 4: (1, 0, 2, 1), 5: (1, 1, 1, 0)}


def test_empty_tables(spark):  # noqa: ANN001
    reco, pair = spark.createDataFrame([], RECO), spark.createDataFrame([], PAIR)
    got = calc_metrics({n: m for n, (m, _) in EXPECTED.items()}, reco, pair, pair, [1, 2])
    assert all(v is None or v == 0 for v in got.values()) and len(got) == len(EXPECTED)
