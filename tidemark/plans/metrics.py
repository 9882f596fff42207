"""Planner of metric batches: every family is one pass over one per-user table, however many metrics it holds."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.runtime import cut, small, table_of
from tidemark.operators.metrics import kinds as M
from tidemark.operators.metrics.base import DebiasConfig, MetricAtK, auc_lists, check_reco, debias_interactions, hit_lists, hit_lists_of
from tidemark.schema import Columns

Metrics = Mapping[str, MetricAtK]


def _of(metrics: Metrics, kind: type) -> dict:
    return {n: m for n, m in metrics.items() if isinstance(m, kind)}


def _n_catalog(catalog: object) -> int | None:
    if catalog is None:
        return None
    if isinstance(catalog, int):
        return catalog
    return catalog.select(catalog.columns[0]).distinct().count() if isinstance(catalog, DataFrame) else len(list(catalog))  # type: ignore[call-overload]


def _configs(metrics: Metrics) -> dict[DebiasConfig | None, dict[str, MetricAtK]]:
    out: dict[DebiasConfig | None, dict[str, MetricAtK]] = {}
    for n, m in metrics.items():
        out.setdefault(m.debias_config, {})[n] = m  # type: ignore[attr-defined]
    return out


def _debiased(interactions: DataFrame, config: DebiasConfig | None) -> DataFrame:
    return interactions if config is None else debias_interactions(interactions, config)


def hit_table(metrics: Metrics, reco: DataFrame, interactions: DataFrame, n_catalog: int | None) -> DataFrame:
    """Per test user: a column for each metric of one debias config."""
    lists = hit_lists(reco, interactions, max(m.k for m in metrics.values()))
    return lists.select(Columns.User, *[m.value(n_catalog).alias(n) for n, m in metrics.items()])  # type: ignore[attr-defined]


def auc_table(metrics: Metrics, reco: DataFrame, interactions: DataFrame) -> DataFrame:
    lists = auc_lists(reco, interactions)
    columns = []
    for n, m in metrics.items():
        how = str(getattr(m.insufficient_handling, "value", m.insufficient_handling))  # type: ignore[attr-defined]
        value = m.value()  # type: ignore[attr-defined]
        if how == "exclude":
            value = F.when(~m.insufficient(), value)  # type: ignore[attr-defined]
        elif how == "raise":
            if not lists.where(m.insufficient()).isEmpty():  # type: ignore[attr-defined]
                raise ValueError(f"Some users have fewer than k={m.k} false positives and test items beyond their lists")
        elif how != "ignore":
            raise ValueError(f"Unknown `insufficient_handling` {how!r}")
        columns.append(value.alias(n))
    return lists.select(Columns.User, *columns)


def item_novelty(prev_interactions: DataFrame) -> DataFrame:
    """item_id, novelty = -log2(users of the item / users), and n_users, the value of an item without users being log2(users)."""
    pairs = prev_interactions.select(*Columns.UserItem).distinct()
    users = pairs.agg(F.countDistinct(Columns.User).alias("n_users"))
    return pairs.groupBy(Columns.Item).agg(F.count("*").alias("n")).crossJoin(F.broadcast(users)).select(Columns.Item, (-F.log2(F.col("n") / F.col("n_users"))).alias("novelty"))  # users is one row


def reco_table(metrics: Metrics, reco: DataFrame, prev: DataFrame | None, test: DataFrame | None, n_catalog: int | None) -> DataFrame:
    """Per user: novelty, popularity, serendipity and data quality metrics, from one aggregate over enriched recommendations.
    A user whose list a metric doesn't cover has null there, and is left out of its mean."""
    check_reco(reco)
    k_max = max(m.k for m in metrics.values())
    # Data quality and novelty look at users whose every rank is beyond k, too.
    rows = reco.select(*Columns.UserItem, F.col(Columns.Rank).cast("int").alias("r"))
    rank = F.col("r")
    aggregates: list[Column] = []
    final: list[Column] = []
    if prev is not None and any(isinstance(m, (M.MeanInvUserFreq, M.AvgRecPopularity, M.Serendipity)) for m in metrics.values()):
        counts = prev.groupBy(Columns.Item).agg(F.count("*").alias("pop"), F.countDistinct(Columns.User).alias("pop_users"))
        # Distinct popularities are few next to items; only they meet in one task to be ranked.
        levels = counts.groupBy("pop").agg(F.count("*").alias("__c")).select("pop", F.dense_rank().over(Window.orderBy(F.col("pop").desc())).alias("pop_rank"))
        counts = counts.join(F.broadcast(levels), "pop")
        totals = prev.agg(F.count("*").alias("total"), F.countDistinct(Columns.User).alias("n_users"))
        rows = rows.join(small(counts), Columns.Item, "left").crossJoin(F.broadcast(totals))  # one row
    if any(isinstance(m, M.Serendipity) for m in metrics.values()):
        assert test is not None
        rows = rows.join(test.select(*Columns.UserItem).distinct().withColumn("rel", F.lit(1)), Columns.UserItem, "left")
    first = F.row_number().over(Window.partitionBy(*Columns.UserItem).orderBy("r"))
    if any(isinstance(m, M.UnrepeatedReco) for m in metrics.values()):
        rows = rows.withColumn("__first", (first == 1).cast("int"))
    covered = max((m.k for m in metrics.values() if isinstance(m, M.Serendipity)), default=0)
    for n, m in metrics.items():
        inside = rank <= m.k
        if isinstance(m, M.MeanInvUserFreq):
            value = -F.log2(F.coalesce("pop_users", F.lit(1)) / F.col("n_users"))
            aggregates.append(F.avg(F.when(inside, value)).alias(n))
            final.append(F.col(n))
        elif isinstance(m, M.AvgRecPopularity):
            value = F.coalesce("pop", F.lit(0)).cast("double")
            aggregates.append(F.avg(F.when(inside, value / F.col("total") if m.normalize else value)).alias(n))
            final.append(F.col(n))
        elif isinstance(m, M.Serendipity):
            size = F.lit(float(n_catalog or 0))
            own = (size + 1 - rank) / size
            anyone = F.when(F.col("pop_rank").isNotNull(), (size + 1 - F.col("pop_rank")) / size).otherwise(0.0)
            value = F.greatest(own - anyone, F.lit(0.0)) * F.coalesce("rel", F.lit(0))
            aggregates += [F.sum(F.when(inside, value)).alias(n), F.max(F.when(rank <= covered, 1)).alias(f"__in_{n}")]
            final.append(F.when(F.col(f"__in_{n}") == 1, F.coalesce(F.col(n), F.lit(0.0)) / m.k).alias(n))
        elif isinstance(m, M.SufficientReco):
            aggregates.append(F.count(F.when(inside, 1)).alias(n))
            share = F.least(F.lit(1.0), F.col(n) / m.k)
            final.append((share if m.deep else (F.col(n) >= m.k).cast("double")).alias(n))
        elif isinstance(m, M.UnrepeatedReco):
            aggregates += [F.sum(F.when(inside, F.col("__first"))).alias(n), F.count(F.when(inside, 1)).alias(f"__n_{n}")]
            share = F.col(n) / F.col(f"__n_{n}")
            final.append(F.when(F.col(f"__n_{n}") > 0, share if m.deep else (F.col(n) == F.col(f"__n_{n}")).cast("double")).alias(n))
    return rows.groupBy(Columns.User).agg(*aggregates).select(Columns.User, *final)


def diversity_table(metrics: Metrics, reco: DataFrame) -> DataFrame:
    """Per user with a recommendation up to the largest k: mean distances of the pairs of his items; 0 without a pair."""
    k_max = max(m.k for m in metrics.values())
    own = reco.where(F.col(Columns.Rank) <= k_max).select(*Columns.UserItem, F.col(Columns.Rank).cast("int").alias("r"))
    # A list has at most k_max items, so a user's pairs come from one short array and no self-join shuffles.
    lists = own.groupBy(Columns.User).agg(F.sort_array(F.collect_list(F.struct("r", Columns.Item))).alias("l"))
    users = lists.select(Columns.User)
    pairs = lists.select(Columns.User, F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x.item_id as item_a, y.item_id as item_b, y.r as r))))")).alias("p"))
    pairs = pairs.select(Columns.User, "p.item_a", "p.item_b", "p.r")
    out = users
    by_calculator: dict[int, dict[str, M.IntraListDiversity]] = {}
    for n, m in metrics.items():
        by_calculator.setdefault(id(m.distance_calculator), {})[n] = m  # type: ignore[attr-defined,assignment]
    for group in by_calculator.values():
        calculator = next(iter(group.values())).distance_calculator
        assert calculator is not None
        found = calculator.distances(pairs).groupBy(Columns.User).agg(*[F.avg(F.when(F.col("r") <= m.k, F.col("distance"))).alias(n) for n, m in group.items()])
        out = out.join(found, Columns.User, "left").na.fill(0.0, subset=list(group))
    return out


def covered_table(metrics: Metrics, reco: DataFrame, interactions: DataFrame) -> DataFrame:
    test = interactions.select(Columns.User).distinct()
    best = reco.groupBy(Columns.User).agg(F.min(Columns.Rank).alias("best"))
    both = test.join(best, Columns.User, "left")
    return both.select(Columns.User, *[F.coalesce((F.col("best") <= m.k).cast("double"), F.lit(0.0)).alias(n) for n, m in metrics.items()])


def intersection_metrics(metrics: Metrics, ref_reco: DataFrame | Mapping[str, DataFrame]) -> dict[str, tuple[M.Intersection, DataFrame]]:
    """A result for each metric and reference list; results of a dict carry the reference's name."""
    if isinstance(ref_reco, DataFrame):
        return {n: (m, ref_reco) for n, m in metrics.items()}  # type: ignore[misc]
    return {f"{n}_{ref}": (m, table) for n, m in metrics.items() for ref, table in ref_reco.items()}  # type: ignore[misc]


def intersection_table(metric: M.Intersection, reco: DataFrame, ref: DataFrame, name: str) -> DataFrame:
    """Share of a user's first k items that the first ref_k of the reference hold."""
    own = reco.where(F.col(Columns.Rank) <= metric.k).select(*Columns.UserItem)
    return hit_table({name: M.Recall(k=metric.ref_k or metric.k)}, ref, own, None)


def _needs(value: object, what: str, metric: str) -> None:
    if value is None:
        raise ValueError(f"For {metric} metrics it's necessary to set '{what}'")


def tables(
    metrics: Metrics, reco: DataFrame, interactions: DataFrame | None = None, prev_interactions: DataFrame | None = None, catalog: object = None,
    ref_reco: DataFrame | Mapping[str, DataFrame] | None = None,
) -> list[tuple[list[str], DataFrame]]:
    """(metric names, per-user table) of each family that the batch needs. Means skip nulls."""
    out: list[tuple[list[str], DataFrame]] = []
    n_catalog = None
    kinds = list(metrics.values())
    if any(isinstance(m, (M.Accuracy, M.MCC)) for m in kinds):
        _needs(catalog, "catalog", "classification")
    if any(isinstance(m, M.Serendipity) for m in kinds):
        _needs(catalog, "catalog", "serendipity")
    if catalog is not None:
        n_catalog = _n_catalog(catalog)
    if hits := _of(metrics, M.HitMetric):
        _needs(interactions, "interactions", "classification and ranking")
        for config, group in _configs(hits).items():
            out.append((list(group), hit_table(group, reco, _debiased(interactions, config), n_catalog)))  # type: ignore[arg-type]
    if auc := _of(metrics, M.AUCMetric):
        _needs(interactions, "interactions", "AUC")
        for config, group in _configs(auc).items():
            out.append((list(group), auc_table(group, reco, _debiased(interactions, config))))  # type: ignore[arg-type]
    enriched = {n: m for n, m in metrics.items() if isinstance(m, (M.MeanInvUserFreq, M.AvgRecPopularity, M.Serendipity, M.SufficientReco, M.UnrepeatedReco))}
    for kind, what in ((M.MeanInvUserFreq, "novelty"), (M.AvgRecPopularity, "popularity"), (M.Serendipity, "serendipity")):
        if _of(enriched, kind):
            _needs(prev_interactions, "prev_interactions", what)
    if _of(enriched, M.Serendipity):
        _needs(interactions, "interactions", "serendipity")
    if enriched:
        out.append((list(enriched), reco_table(enriched, reco, prev_interactions, interactions, n_catalog)))
    if ild := _of(metrics, M.IntraListDiversity):
        out.append((list(ild), diversity_table(ild, reco)))
    if covered := _of(metrics, M.CoveredUsers):
        _needs(interactions, "interactions", "cross data quality")
        out.append((list(covered), covered_table(covered, reco, interactions)))  # type: ignore[arg-type]
    if same := _of(metrics, M.Intersection):
        _needs(ref_reco, "ref_reco", "intersection")
        for name, (m, ref) in intersection_metrics(same, ref_reco).items():  # type: ignore[arg-type]
            out.append(([name], intersection_table(m, reco, ref, name)))
    return out


def calc_per_user(metrics: Metrics, reco: DataFrame, interactions: DataFrame | None = None, prev_interactions: DataFrame | None = None, catalog: object = None, ref_reco: object = None) -> DataFrame:
    """user_id and a column for each metric; users that no family covers for a metric have null there."""
    found = [t for _, t in tables(metrics, reco, interactions, prev_interactions, catalog, ref_reco)]  # type: ignore[arg-type]
    return reduce(lambda a, b: a.join(b, Columns.User, "full_outer"), found)


def family(metric: MetricAtK) -> type:
    """The kind of table that a metric's values come from: metrics of one family share it."""
    kinds = (M.HitMetric, M.AUCMetric, M.IntraListDiversity, M.CoveredUsers, M.Intersection, M.CatalogCoverage)
    return next((k for k in kinds if isinstance(metric, k)), MetricAtK)


def metric_table(metrics: Metrics, reco: DataFrame, interactions: DataFrame | None = None, prev_interactions: DataFrame | None = None, catalog: object = None, ref_reco: object = None) -> DataFrame:
    """Table metric, value. A batch of several families reads its inputs several times, so their narrow tables are written
    once (checkpoints); the rest is lazy."""
    for n, m in metrics.items():
        if type(m).__module__ != M.__name__:
            warnings.warn("Custom metrics are not supported.", stacklevel=2)
    known = {n: m for n, m in metrics.items() if type(m).__module__ == M.__name__}
    parts = []
    catalog = _n_catalog(catalog)
    if len({family(m) for m in known.values()}) > 1:
        reco = cut(reco.select(*Columns.UserItem, Columns.Rank))
        interactions = None if interactions is None else cut(interactions)
        prev_interactions = None if prev_interactions is None else cut(prev_interactions.select(*Columns.UserItem))
    for names, table in tables(known, reco, interactions, prev_interactions, catalog, ref_reco):  # type: ignore[arg-type]
        means = table.agg(*[F.avg(n).alias(n) for n in names])
        entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
        parts.append(means.select(F.inline(entries)))
    if coverage := _of(known, M.CatalogCoverage):
        if any(m.normalize for m in coverage.values()):
            _needs(catalog, "catalog", "catalog")
        n_catalog = _n_catalog(catalog) or 1
        items = reco.groupBy(Columns.Item).agg(F.min(Columns.Rank).alias("best"))
        counts = items.agg(*[F.count(F.when(F.col("best") <= m.k, 1)).alias(n) for n, m in coverage.items()])
        entries = F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(f"`{n}`") / (n_catalog if m.normalize else 1)).cast("double").alias("value")) for n, m in coverage.items()])
        parts.append(counts.select(F.inline(entries)))
    if not parts:
        return SparkSession.getActiveSession().createDataFrame([], "metric string, value double")  # type: ignore[union-attr]
    return reduce(DataFrame.unionByName, parts)


def calc_metrics(metrics: Metrics, reco: DataFrame, interactions: DataFrame | None = None, prev_interactions: DataFrame | None = None, catalog: object = None, ref_reco: object = None) -> dict[str, float]:
    """Values by metric name."""
    return {r["metric"]: r["value"] for r in metric_table(metrics, reco, interactions, prev_interactions, catalog, ref_reco).collect()}


# Families by name, over the intermediates that callers may already have.


def calc_merged_metrics(metrics: Metrics, merged: DataFrame, catalog: object = None) -> dict[str, float]:
    """Classification and ranking metrics of merged rows (user_id, item_id, rank). Debiasing thins out the merged rows."""
    if any(m.needs_catalog for m in metrics.values()):  # type: ignore[attr-defined]
        _needs(catalog, "catalog", "classification")
    out: dict[str, float] = {}
    for config, group in _configs(metrics).items():
        lists = hit_lists_of(_debiased(merged, config), max(m.k for m in group.values()))
        row = lists.agg(*[F.avg(m.value(_n_catalog(catalog))).alias(n) for n, m in group.items()]).first()  # type: ignore[attr-defined]
        out |= {n: row[n] for n in group}
    return out


calc_classification_metrics = calc_merged_metrics
calc_ranking_metrics = calc_merged_metrics


def calc_auc_metrics(metrics: Metrics, reco: DataFrame, interactions: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco, interactions)


def calc_novelty_metrics(metrics: Metrics, reco: DataFrame, prev_interactions: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco, prev_interactions=prev_interactions)


def calc_popularity_metrics(metrics: Metrics, reco: DataFrame, prev_interactions: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco, prev_interactions=prev_interactions)


def calc_diversity_metrics(metrics: Metrics, reco: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco)


def calc_serendipity_metrics(metrics: Metrics, reco: DataFrame, interactions: DataFrame, prev_interactions: DataFrame, catalog: object) -> dict[str, float]:
    return calc_metrics(metrics, reco, interactions, prev_interactions, catalog)


def calc_catalog_metrics(metrics: Metrics, reco: DataFrame, catalog: object) -> dict[str, float]:
    return calc_metrics(metrics, reco, catalog=catalog)


def calc_cross_dq_metrics(metrics: Metrics, reco: DataFrame, interactions: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco, interactions)


def calc_reco_dq_metrics(metrics: Metrics, reco: DataFrame) -> dict[str, float]:
    return calc_metrics(metrics, reco)


def calc_intersection_metrics(metrics: Metrics, reco: DataFrame, ref_reco: DataFrame | Mapping[str, DataFrame]) -> dict[str, float]:
    return calc_metrics(metrics, reco, ref_reco=ref_reco)


def users_table(spark: SparkSession, users: Iterable | DataFrame) -> DataFrame:
    return table_of(spark, users, Columns.User)
