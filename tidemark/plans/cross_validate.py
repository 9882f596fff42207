"""Cross-validation: models over folds, every metric of a fold in one batch."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.runtime import cut
from tidemark.operators.metrics.base import MetricAtK
from tidemark.operators.models.base import ModelBase
from tidemark.operators.splits import Splitter
from tidemark.plans.metrics import metric_table
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset
from tidemark.sources.interactions import get_context


def cross_validate_table(
    dataset: Dataset, splitter: Splitter, metrics: dict[str, MetricAtK], models: dict[str, ModelBase], k: int, filter_viewed: bool, items_to_recommend: DataFrame | Iterable | None = None,
    ref_models: Iterable[str] | None = None, validate_ref_models: bool = False, on_unsupported_targets: str = "warn", prefer_warm_inference_over_cold: bool = True,
) -> DataFrame:
    """model, i_split, metric, value. Fold tables and recommendations, which models and metrics read several times, are written
    as checkpoints, which go when nothing refers to them; catalog and popularity come from the fold's train rows. Users and items without train rows keep their features,
    and so are warm, unless prefer_warm_inference_over_cold is off."""
    refs = list(ref_models or [])
    parts = []
    for fold in splitter.split(dataset):
        i = fold.info[Columns.Split]
        train, test = cut(fold.train), cut(fold.test.select(*dataset.raw.columns))
        own = dataset.with_interactions(train, prefer_warm_inference_over_cold)
        catalog = train.select(Columns.Item).distinct().count()
        users = test.select(Columns.User).distinct()
        context = get_context(test) if any(getattr(m, "require_recommend_context", False) for m in models.values()) else None
        recos = {}
        for name, model in models.items():
            model.fit(own)
            recos[name] = cut(model.recommend(users, own, k, filter_viewed, items_to_recommend, on_unsupported_targets=on_unsupported_targets, context=context))
        ref_reco = {n: recos[n] for n in refs} or None
        for name, reco in recos.items():
            if name in refs and not validate_ref_models:
                continue
            values = metric_table(metrics, reco, test, train, catalog, ref_reco)
            parts.append(values.select(F.lit(name).alias(Columns.Model), F.lit(i).alias(Columns.Split), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(dataset: Dataset, splitter: Splitter, metrics: dict[str, MetricAtK], models: dict[str, ModelBase], k: int, filter_viewed: bool, **options: object) -> dict:
    """{'splits': fold infos with sizes, 'metrics': one dict for each model and fold}."""
    splits = [f.stats() for f in splitter.split(dataset)]
    rows = cross_validate_table(dataset, splitter, metrics, models, k, filter_viewed, **options).collect()  # type: ignore[arg-type]
    found: dict[tuple, dict] = {}
    for r in rows:
        found.setdefault((r[Columns.Split], r[Columns.Model]), {Columns.Model: r[Columns.Model], Columns.Split: r[Columns.Split]})[r["metric"]] = r["value"]
    return {"splits": splits, "metrics": list(found.values())}
